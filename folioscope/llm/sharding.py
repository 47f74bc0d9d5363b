"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt to partitions by a hash. How many rows of each partition go to
each shard is drawn from the multivariate hypergeometric law with the exact
margins (partition sizes and shard sizes), as in parallel random permutation
(Gustedt, "Randomized permutations in a coarse grained parallel environment",
2003). Each partition then permutes its rows and deals them out by these
counts, rows are exchanged, and each shard permutes again. Every step on rows is
a DataFrame expression; only the counts, whose number is bounded by the number
of partitions, pass the driver.

Random order comes from hashes of a row and the seed, so repeated tasks agree.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count

PART_BYTES = 8 << 20
#: Partitions for each shard at least, so that small inputs are spread too.
PARTS_A_SHARD = 4
#: Most partitions of the matrix; beyond it they grow.
MOST_PARTS = 1 << 14


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` from ``good + bad`` without return, by inversion.

    Weights follow from their ratios, 1 at the mode, and are divided by their
    own sum, so no factorial of a large number loses digits: the law holds up to
    the rounding of doubles, about 1e-12, and a tail of less than 1e-30.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))
    reach = int(16 * spread) + 64
    up = np.arange(mode + 1, min(high, mode + reach) + 1, dtype=np.float64)
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)
    above = np.cumprod((good - up + 1) / up * ((draws - up + 1) / (bad - draws + up)))
    below = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    ends = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + min(int(np.searchsorted(ends, rng.random() * ends[-1], side="right")), len(ends) - 1)


def matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with these row and column sums, as a uniform shuffle would have them."""
    if sum(parts) != sum(shards):
        raise ValueError("partitions and shards hold different numbers of rows")
    rng, left, out = random.Random(seed), list(shards), []
    for n in parts:
        row, total = [], sum(left)
        for j, m in enumerate(left):
            total -= m
            take = hypergeometric(rng, m, total, n)
            row.append(take)
            n -= take
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def _random(seed: int, what: str, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(f"{seed} {what}"), *columns)


def shuffled(df: DataFrame, columns: list[str], shards: int = 16, seed: int = 11, part_bytes: int = PART_BYTES, parts: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in it), uniformly at random.

    ``columns`` tell rows apart (an id and, where ids repeat, more); rows alike
    in all of them, nulls included, are interchangeable. Shard sizes differ by
    one row at most, the first shards are the larger ones. The same rows, seed
    and number of ``parts`` give the same shards; without ``parts`` their number
    follows from the size of the input. Null and very long values are dealt like
    others. An empty table stays empty. Columns of ``df`` named ``shard`` or
    ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    df = df.drop("shard", "slot")
    spark = df.sparkSession
    names = [f"c{i}" for i in range(len(df.columns))]
    slim = df.toDF(*names)
    keys = [F.col(n) for n, c in zip(names, df.columns, strict=True) if c in columns]
    parts = parts or max(PARTS_A_SHARD * shards, bucket_count(df, part_bytes, MOST_PARTS))
    dealt = slim.withColumn("_part", F.pmod(_random(seed, "part", keys), F.lit(parts)).cast("int"))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    wanted = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(sizes)
    counts = matrix([sizes[p] for p in order], wanted, seed)
    ends = [[p, [sum(row[: j + 1]) for j in range(shards)]] for p, row in zip(order, counts, strict=True)]
    # One row for each partition, at most MOST_PARTS: a proven bound.
    ends_df = F.broadcast(spark.createDataFrame(ends, "_part int, _ends array<long>"))
    # Local permutation, then the first rows to shard 0, the next to shard 1, and so on.
    first = Window.partitionBy("_part").orderBy(_random(seed, "first", keys), *keys)
    placed = dealt.withColumn("_rank", F.row_number().over(first).cast("long")).join(ends_df, "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
    # Second permutation: the order of a new random number in the shard. The shard's rows go to as
    # many ranges of that number as there were partitions for a shard, so no task has a whole shard.
    ranges = max(1, parts // shards)
    second = placed.withColumn("_second", _random(seed, "second", keys))
    ranged = second.withColumn("_range", F.floor((F.shiftrightunsigned("_second", 33)) * ranges / (1 << 31)).cast("int"))
    # _second is compared as signed, its ranges as unsigned: sort by the same view of it.
    view = F.shiftrightunsigned("_second", 1)
    inside = Window.partitionBy("shard", "_range").orderBy(view, F.col("_second"), *keys)
    # Number of rows in the ranges before, from at most shards * ranges counts.
    filled = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = filled.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "_range", "_before")
    out = ranged.withColumn("_place", F.row_number().over(inside) - 1).join(F.broadcast(before), ["shard", "_range"]).withColumn("slot", (F.col("_before") + F.col("_place")).cast("long"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)], "shard", "slot")
