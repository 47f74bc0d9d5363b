"""Fusion of ranked lists by reciprocal ranks, with the threshold algorithm: no list is sorted to its end.

A row's score is the sum of 1 / (C + rank) over the lists that hold it. Each list
is read to a depth; the ranks that the rows seen there have in the other lists are
counted in one pass without an order. A row that no list has shown has at most the
sum of 1 / (C + depth + 1), so once the k-th best of the seen rows reaches that,
no other can be among the k best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Usual constant of reciprocal ranks.
C = 60
#: Depth that reading starts from, in rows for each wanted one, and its growth.
START, GROWTH = 4, 4


@dataclass(frozen=True)
class Ranked:
    """A list in descending order of ``score``, equal ones by ascending ``id``: its first rows, and all of them in no order, as ``id, score``."""

    best: Callable[[int], DataFrame]
    all: Callable[[], DataFrame]


def by_score(scored: DataFrame) -> Ranked:
    """The list of all rows of ``scored (id, score)``."""
    slim = scored.select("id", "score")
    return Ranked(lambda depth: slim.orderBy(F.desc("score"), "id").limit(depth), lambda: slim)


def _better(ids: np.ndarray, scores: np.ndarray):
    """How many rows of a task go before each of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(ids), np.int64)
        for b in batches:
            there, own = b.column("score").to_numpy(), b.column("id").to_numpy()
            order = np.sort(there)
            above = np.searchsorted(order, scores, side="right")
            n += len(order) - above
            for i in np.flatnonzero(above > np.searchsorted(order, scores, side="left")):
                n[i] += ((there == scores[i]) & (own < ids[i])).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)), pa.int32()), pa.array(n)], ["i", "n"])

    return run


def ranks(scored: DataFrame, ids: list[int]) -> dict[int, int]:
    """The ranks (from 1) that some rows have among all of ``scored``, those that are in it: counted, not sorted."""
    found = scored.where(F.col("id").isin(ids)).collect()
    if not found:
        return {}
    names = [r["id"] for r in found]
    counts = scored.select("id", "score").mapInArrow(_better(np.array(names, np.int64), np.array([r["score"] for r in found], np.float64)), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {names[r["i"]]: r["n"] + 1 for r in counts}


def fused(spark: SparkSession, lists: list[Ranked], k: int, start: int = START) -> DataFrame:
    """``rank, id, score`` and ``rank_1, rank_2, ...`` (null where a list does not hold the row) of the ``k`` best rows, equal scores by ascending id.

    Scores and ids are not null. What reaches the driver are ``len(lists)`` times the depth,
    which depends on ``k`` and on how far the lists differ. Empty lists give no row.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    depth = start * k
    while True:
        heads = [[(r["id"], n) for n, r in enumerate(x.best(depth).collect(), 1)] for x in lists]
        seen = sorted({i for h in heads for i, _ in h})
        places = []
        for x, h in zip(lists, heads, strict=True):
            known = dict(h)
            unknown = [i for i in seen if i not in known]
            # A list that is shorter than the depth has no other rows.
            places.append(known | (ranks(x.all(), unknown) if unknown and len(h) == depth else {}))
        rows = sorted((-sum(1 / (C + p[i]) for p in places if i in p), i) for i in seen)
        most = sum(1 / (C + depth + 1) for h in heads if len(h) == depth)
        # A row not seen yet may tie and have a lesser id.
        if most == 0 or len(rows) >= k and -rows[k - 1][0] > most:
            break
        depth *= GROWTH
    out = [(n, i, -s, *(p.get(i) for p in places)) for n, (s, i) in enumerate(rows[:k], 1)]
    return spark.createDataFrame(out, "rank int, id long, score double, " + ", ".join(f"rank_{j + 1} long" for j in range(len(lists))))
