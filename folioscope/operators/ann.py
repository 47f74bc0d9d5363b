"""Approximate vector search: lists around centres, and exact scores in the lists nearest to a query.

Centres are fitted on a bounded sample (``Settings.sample``, the rows with the
least hash of their id); every row is put in the list of its nearest centre. A
search reads the ``probes`` lists nearest to the query, which partition the
table, and scores their rows exactly. With all lists it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import top_k, top_k_batch


@dataclass(frozen=True)
class Settings:
    #: Most rows that the centres are fitted on.
    sample: int = 20_000
    lists: int = 64
    rounds: int = 12
    #: Share of the true ``k`` nearest that searches of the sample must find; from it the number of probed lists follows.
    recall: float = 0.95
    k: int = 10
    #: Most rows of the sample that are searched for that.
    trials: int = 500


@dataclass(frozen=True)
class Lists:
    """Unit centres, and how many of the nearest lists a search reads."""

    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The lists that a search for each row of ``vectors`` reads."""
        return np.argsort(-(np.atleast_2d(vectors) @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(index: DataFrame, id_col: str, vector_col: str = "embedding", settings: Settings = Settings()) -> Lists:
    """Centres by spherical k-means, fewer than ``lists`` if there are few rows; the same for the same rows."""
    s = settings
    rows = index.select(id_col, F.col(vector_col).alias("v")).where("v is not null").orderBy(F.xxhash64(id_col), id_col).limit(s.sample).collect()
    if not rows:
        return Lists(np.zeros((1, 1)), 1)
    x = _unit(np.array([r["v"] for r in rows], np.float64))
    centres = x[: min(s.lists, max(1, len(x) // 8))].copy()
    for _ in range(s.rounds):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        filled = np.bincount(at, minlength=len(centres)) > 0
        centres[filled] = _unit(sums[filled])
    return Lists(centres, _probes(x, centres, s))


def _probes(x: np.ndarray, centres: np.ndarray, s: Settings) -> int:
    """The fewest lists that reach the wanted recall on the sample."""
    asked = x[: s.trials]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, : s.k]
    home = np.argmax(x @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    seen = np.bincount(np.take_along_axis(place, home[best], 1).ravel(), minlength=len(centres)).cumsum() / best.size
    return int(np.searchsorted(seen, s.recall)) + 1 if seen[-1] >= s.recall else len(centres)


def _lists(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, centres.shape[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names], pa.array(np.argmax(_unit(x) @ centres.T, axis=1), pa.int32())], [*b.schema.names, "list"])

    return run


def listed(index: DataFrame, lists: Lists, vector_col: str = "embedding") -> DataFrame:
    """Every row of ``index`` with its ``list``; a row without a vector is in none and goes."""
    columns = [c for c in index.columns if c != vector_col]
    slim = index.where(F.col(vector_col).isNotNull()).select(*columns, F.col(vector_col).alias("v"))
    schema = T.StructType([*slim.schema.fields, T.StructField("list", T.IntegerType())])
    return slim.mapInArrow(_lists(lists.centres), schema).withColumnRenamed("v", vector_col)


def search(table: DataFrame, lists: Lists, vector: Sequence[float], k: int, id_cols: Sequence[str], vector_col: str = "embedding", unit: bool = True) -> DataFrame:
    """As :func:`retrieval.top_k`, over the rows of the nearest lists: a filter that prunes partitions by ``list``."""
    some = table.where(F.col("list").isin(lists.nearest(np.asarray(vector, np.float64))[0].tolist())).drop("list")
    return top_k(some, vector, k, id_cols, vector_col, unit)


def search_batch(table: DataFrame, lists: Lists, queries: DataFrame, k: int, id_cols: Sequence[str], **more) -> DataFrame:
    """As :func:`retrieval.top_k_batch`, each query over the rows of its own nearest lists."""
    return top_k_batch(table, queries, k, id_cols, lists=lists.nearest, **more)
