"""The next row in descending order of an id, without putting all rows in one order in one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, quoted
from .minhash import let

#: Most ranges; beyond it they grow, and their sorts spill.
MOST_BOUNDS = 1 << 16
BUCKET_BYTES = 4 << 20
_LEAST = -(1 << 63)


def _array(values: list[int]) -> Column:
    return F.lit(np.array(values, np.int64))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are <= key, by halving."""
    at, step = F.lit(0), 1
    while step * 2 <= len(bounds):
        step *= 2
    array = _array(bounds)

    def down(at: Column, step: int) -> Column:
        if not step:
            return at
        return let(at, lambda a: down(F.when(F.coalesce(F.get(array, a + (step - 1)) <= key, F.lit(False)), a + step).otherwise(a), step // 2))

    return down(at, step) if bounds else at


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Ascending keys that exist in ``ids (key)``, the greatest as the last one: of ``n`` ranges at most.

    Quantiles pass through doubles, so for great ids they need not exist; the
    greatest key of each range between them does.
    """
    inner = min(MOST_BOUNDS, n) - 1
    shares = [(i + 1) / (inner + 1) for i in range(inner)]
    found = ids.agg(F.percentile_approx("key", shares, max(20_000, 4 * inner)).alias("some")).first()["some"] if shares else None
    # At most MOST_BOUNDS rows, one for each range.
    part = _range_of(F.col("key"), sorted({int(x) + 1 for x in found or [] if int(x) < (1 << 63) - 1}))
    return sorted(r["most"] for r in ids.groupBy(part.alias("part")).agg(F.max("key").alias("most")).collect())


def with_next(df: DataFrame, id_col: str, order: list[str], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``next``, a struct of the row that follows in descending ``id_col``; the first one follows the last.

    Rows with one id follow by ``order``, null ids come last. Rows are dealt to
    ranges of ids that end with an id that exists: the head of a range is known by
    its id, so it is also dealt to the range above, whose last row it follows. One
    exchange of the rows; what passes the driver is at most ``MOST_BOUNDS`` ids.
    Rows that share an id are in one range. An empty table stays empty. A column
    of ``df`` named ``next`` is replaced. Ids must be integers.
    """
    df = df.drop("next")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    bounds = _bounds(df.select(key.alias("key")), bucket_count(df, bucket_bytes)) or [0]
    # Ranges are (bound before, own bound]: as many bounds as are less than the key lie before it.
    part = _range_of(F.col("key"), [b + 1 for b in bounds[:-1]])
    row = F.struct(*[F.col(quoted(c)) for c in df.columns])
    keyed = df.select(key.alias("key"), row.alias("row")).withColumn("part", part.cast("int"))
    above = F.when(F.get(_array(bounds), F.col("part")) == F.col("key"), F.pmod(F.col("part") + 1, F.lit(len(bounds))))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("copy")), F.struct(above.alias("part"), F.lit(1).alias("copy")))
    dealt = keyed.withColumn("place", F.explode(F.filter(places, lambda p: p["part"].isNotNull()))).select("key", "row", "place.part", "place.copy")
    inside = Window.partitionBy("part").orderBy("copy", F.desc("key"), *[F.col("row").getField(c) for c in order])
    out = dealt.withColumn("next", F.lead("row").over(inside)).where("copy = 0")
    return out.select("row.*", "next")
