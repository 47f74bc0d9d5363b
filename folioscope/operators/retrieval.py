"""Exact vector top-k, for one query and for a table of queries.

Scores are the cosine, as (1 + cos) / 2; ties go by ascending id. A vector of
another dimension is an error, not a null score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import checked, dot, norm, score
from ..sources.tables import scratch_path

#: Queries of a batch that go to all tasks together, and rows that meet them in one product: 4 MB of scores.
QUERY_BLOCK, ROW_BLOCK = 512, 1 << 10


def cosine(a: Column, b: Column, unit: bool) -> Column:
    return dot(a, b) if unit else dot(a, b) / (norm(a) * norm(b))


def top_k(index: DataFrame, vector: Sequence[float], k: int, id_cols: Sequence[str], vector_col: str = "embedding", unit: bool = True, after: tuple | None = None) -> DataFrame:
    """The ``k`` nearest rows, with ``rank`` (from 1) and ``retrieval_score``.

    The vector is a literal of the plan; each task keeps its best ``k``, and
    the k rows alone are ordered and numbered. ``after``: score and ids of the
    last row of a page; only rows behind it count, so a later page does not
    keep those before. Ranks start anew on each page.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    query = F.array(*[F.lit(float(x)) for x in vector])
    near = score(cosine(checked(F.col(vector_col), len(vector)), query, unit))
    scored = index.withColumn("retrieval_score", near)
    if after is not None:
        behind, same = F.col("retrieval_score") < after[0], F.col("retrieval_score") == after[0]
        for c, x in zip(id_cols, after[1:], strict=True):
            behind, same = behind | same & (F.col(c) > x), same & (F.col(c) == x)
        scored = scored.where(behind)
    best = scored.orderBy(F.desc("retrieval_score"), *id_cols).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("retrieval_score"), *id_cols)))


def _products(vectors: np.ndarray, names: list, k: int, unit: bool, lists: np.ndarray | None = None):
    """``lists``: those that each query reads; rows come with theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = vectors.shape
        # The best scores and their rows of each query in this task, of at most k and one batch.
        best, rows, held = np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64), None
        for b in (b.slice(at, ROW_BLOCK) for b in batches for at in range(0, b.num_rows, ROW_BLOCK)):
            column = b.column("v")
            if column.null_count or any(x != size for x in set(pc.list_value_length(column).to_pylist())):
                raise ValueError("query and index differ in dimension")
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, size)
            if not unit:
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = np.round((1 + vectors @ x.T) / 2, 12)
            if lists is not None:
                near[~(lists[:, :, None] == b.column("list").to_numpy()[None, None, :]).any(1)] = -np.inf
            ids = b.drop_columns(["v"] if lists is None else ["v", "list"])
            held = pa.Table.from_batches([ids]) if held is None else pa.concat_tables([held, pa.Table.from_batches([ids])])
            # Twelve digits: equal vectors tie whatever their place in a product.
            near = np.concatenate([best, near], axis=1)
            at = np.concatenate([rows, np.tile(np.arange(held.num_rows - b.num_rows, held.num_rows), (n, 1))], axis=1)
            if near.shape[1] > k:
                # First all that reach the k-th score, then of these the k best with ties in the order of ids.
                least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
                order = np.argsort(-near, axis=1, kind="stable")[:, : int((near >= least).sum(1).max())]
                near, at = np.take_along_axis(near, order, 1), np.take_along_axis(at, order, 1)
                rank = np.empty(held.num_rows, np.int64)
                rank[pc.sort_indices(held, [(c, "ascending") for c in held.column_names], null_placement="at_start").to_numpy()] = np.arange(held.num_rows)
                order = np.lexsort((rank[at], -near), axis=1)[:, :k]
                near, at = np.take_along_axis(near, order, 1), np.take_along_axis(at, order, 1)
            best = near
            kept = np.unique(at)
            held, rows = held.take(pa.array(kept)), np.searchsorted(kept, at)
        if held is not None:
            q = np.repeat(np.arange(n), best.shape[1])
            out = held.take(pa.array(rows.ravel())).combine_chunks()
            found = pa.table([pa.array([names[i] for i in q]), *out.columns, pa.array(best.ravel())], ["_q", *out.column_names, "retrieval_score"])
            yield from found.filter(pc.is_finite(found["retrieval_score"])).to_batches()

    return run


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, id_cols: Sequence[str], query_id: str = "query_id", vector_col: str = "embedding", query_col: str = "query_vector", unit: bool = True, block: int = QUERY_BLOCK, lists: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """For each row of ``queries (query_id, query_vector)`` its ``k`` nearest rows of ``index``: ``query_id``, the ``id_cols``, ``retrieval_score`` and ``rank``.

    Every query looks at all rows: that is what exact search means. Queries are
    taken in blocks of ``block`` vectors, the bound of what the driver holds and of
    what goes to the tasks; a block meets ``ROW_BLOCK`` rows of the index in one matrix
    product, and each task hands on the k best of a query before the exchange by
    query. With more than one block, what each hands on is written. ``lists`` gives
    the lists that queries read, of an index with ``list`` (:mod:`ann`).
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    numbered = queries.select(F.col(query_id).alias("_q"), F.col(query_col).alias("_v"))
    slim = index.select(*id_cols, F.col(vector_col).alias("v"), *(["list"] if lists else []))
    fields = [numbered.schema["_q"], *[index.schema[c] for c in id_cols], T.StructField("retrieval_score", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    wide, asked = None, []

    def scored() -> DataFrame:
        if len({len(r["_v"]) for r in asked}) > 1:
            raise ValueError("queries differ in dimension")
        vectors = np.array([r["_v"] for r in asked], np.float64)
        if not unit:
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        read = lists(vectors) if lists else None
        some = slim if read is None else slim.where(F.col("list").isin(np.unique(read).tolist()))
        return some.mapInArrow(_products(vectors, [r["_q"] for r in asked], k, unit, read), schema)

    def put() -> None:
        """Results of a block: written when more than one block has to come, so that a plan holds one block of queries."""
        nonlocal wide, asked
        found = scored()
        if path is None:
            wide = found
        else:
            found.write.mode("append").parquet(path)
        asked = []

    # The driver holds one block of queries at a time, partition by partition.
    path = None
    for r in numbered.toLocalIterator():
        if len(asked) == block:
            path = path or scratch_path(index.sparkSession, "nearest")
            put()
        asked.append(r)
    if asked:
        put()
    if path is not None:
        wide = index.sparkSession.read.schema(schema).parquet(path)
    if wide is None:
        wide = index.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("_q").orderBy(F.desc("retrieval_score"), *id_cols)
    return wide.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("_q", query_id)
