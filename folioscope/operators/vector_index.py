"""A stored index for approximate vector search.

Rows are put in lists around centres, whose number grows with the root of the
rows: centres of groups are fitted on a bounded sample, and the lists of each group
on rows of that group, group by group in tasks. Beside its vector a row keeps a code, the
nearest of 256 points in each run of a few dimensions of what is left when the
centre of its list is taken away. A search scores the codes of the lists nearest to
the query, which are partitions, and takes exact scores of the best candidates alone.

Lists also have counts of their rows by attribute. With a filter, lists are
taken in order of nearness until they hold as many rows that match as a search
without a filter looks at, so rare values make it read further.

How many lists a search reads, and how many candidates it scores, is measured when the
index is fitted: on sampled rows as queries, against exact search over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import dot, score
from .retrieval import top_k, top_k_batch

#: Most lists; beyond it they hold more rows. With their centres they go to all tasks: 64 MB at 1024 dimensions.
MOST_LISTS = 1 << 14
#: Rows of a group that its lists are fitted on, and rows of that sample for each list.
GROUP_ROWS, LIST_ROWS = 1 << 13, 48
#: Points of a run of dimensions.
POINTS = 256
#: Queries of a batch that go to all tasks together.
QUERY_BLOCK = 256


@dataclass(frozen=True)
class Shape:
    #: Most rows that group centres and codes are fitted on.
    sample: int = 20_000
    rounds: int = 10
    #: Dimensions of a code.
    run: int = 4
    #: Share of the ``k`` nearest that sampled queries must find; ``trials`` of them are asked.
    recall: float = 0.98
    k: int = 10
    trials: int = 200


@dataclass(frozen=True)
class Codebook:
    """Unit centres of groups and of lists (sorted by group), points of codes, and how far a search goes."""

    groups: np.ndarray
    group_of: np.ndarray
    centres: np.ndarray
    points: np.ndarray
    rows: int
    probes: int = 1
    #: Candidates that are scored exactly, for each row asked for.
    depth: int = 10

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All lists in order of nearness to each vector."""
        return np.argsort(-(np.atleast_2d(vectors) @ self.centres.T), axis=1, kind="stable")

    def assigned(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest centre of the two nearest groups."""
        u = _unit(x)
        near = u @ self.groups.T
        two = np.argsort(-near, axis=1, kind="stable")[:, :2]
        best, at = np.full(len(u), -np.inf), np.zeros(len(u), np.int64)
        for g in np.unique(two):
            rows = np.flatnonzero((two == g).any(1))
            lists = np.flatnonzero(self.group_of == g)
            found = u[rows] @ self.centres[lists].T
            k = np.argmax(found, axis=1)
            value = found[np.arange(len(rows)), k]
            better = value > best[rows]
            best[rows[better]], at[rows[better]] = value[better], lists[k[better]]
        return at

    def _runs(self, x: np.ndarray) -> np.ndarray:
        """Rows cut to runs, the last one filled with zeros."""
        parts, _, run = self.points.shape
        return np.pad(x, ((0, 0), (0, parts * run - x.shape[1]))).reshape(len(x), parts, run)

    def coded(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = self._runs(x - self.centres[lists])
        out = np.empty(left.shape[:2], np.uint8)
        for j, points in enumerate(self.points):
            out[:, j] = np.argmin((points * points).sum(1) - 2 * left[:, j] @ points.T, axis=1)
        return out

    def tables(self, vectors: np.ndarray) -> np.ndarray:
        """Products of each query's runs with all points."""
        return np.einsum("qjr,jpr->qjp", self._runs(vectors), self.points).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _means(x: np.ndarray, n: int, rounds: int, unit: bool) -> np.ndarray:
    """At most ``n`` centres of the distinct rows of ``x`` by k-means, on the sphere if ``unit``; the same for the same rows."""
    kinds = np.unique(x, axis=0)
    order = np.random.default_rng(7).permutation(len(kinds))
    out = kinds[order[:n]].astype(np.float64)
    for _ in range(rounds):
        at = np.argmin((out * out).sum(1) - 2 * x @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, at, x)
        n_rows = np.bincount(at, minlength=len(out))
        there = n_rows > 0
        out[there] = sums[there] / n_rows[there, None]
        if unit:
            out = _unit(out)
    return out


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * size:
        raise ValueError(f"vectors do not all have {size} dimensions")
    return flat.astype(np.float64).reshape(len(column), size)


def _rows(column: pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """The vectors of a column that reached the driver."""
    n = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, size if size is not None else -1) if n else np.zeros((0, size or 1))


def _grouped(send, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_vectors(b.column("embedding"), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.argmax(x @ send.value.T, axis=1), pa.int32()), b.column("h"), b.column("embedding")], ["grp", "h", "embedding"])

    return run


def _list_centres(rounds: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        centres = _means(x, max(1, round(group["share"].iloc[0])), rounds, True)
        return pd.DataFrame({"grp": group["grp"].iloc[0], "centre": list(centres)})

    return run


def _entries(send):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = send.value
        for b in batches:
            x = _vectors(b.column("embedding"), book.size)
            lists = book.assigned(x)
            codes = book.coded(x, lists)
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists, pa.int32())], [*names, "code", "list"])

    return run


def _candidates(send, k: int):
    """For each query the ``k`` rows of a task with the greatest products of codes, in the lists that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, bases, reads = send.value
        n, parts = tables.shape[:2]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def cut(q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            near, ids, lists = (np.concatenate(x) for x in zip(*found[q]))
            order = np.lexsort((ids, -near))[:k]
            return near[order], ids[order], lists[order]

        for b in batches:
            ids, lists = b.column("id").to_numpy(), b.column("list").to_numpy()
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts)
            for one in np.unique(lists):
                at = np.flatnonzero(lists == one)
                for q in reads.get(int(one), ()):
                    near = bases[q, one] + tables[q][np.arange(parts), codes[at]].sum(1, dtype=np.float64)
                    found.setdefault(q, []).append((near, ids[at], lists[at]))
                    held[q] = held.get(q, 0) + len(at)
                    if held[q] > 4 * k + 4096:
                        found[q] = [cut(q)]
                        held[q] = len(found[q][0][0])
        for q in found:
            near, ids, lists = cut(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids), pa.array(lists, pa.int32()), pa.array(near)], ["q", "id", "list", "near"])

    return run


class VectorIndex:
    """An index of rows ``id, embedding`` and attribute columns, in a folder: generations of a codebook with the entries of each batch."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "chunk_id", attributes: Sequence[str] = ("department", "language_code"), shape: Shape = Shape()):
        self.spark, self.path, self.id_col, self.attributes, self.shape = spark, path.rstrip("/"), id_col, list(attributes), shape
        self._book: tuple[int, Codebook] | None = None

    # What is stored.

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def generation(self) -> int | None:
        """The latest generation that is whole: its codebook is written last."""
        if not self._exists(f"{self.path}/codebook"):
            return None
        return self.spark.read.parquet(f"{self.path}/codebook").agg(F.max("generation")).first()[0]

    def codebook(self) -> Codebook | None:
        g = self.generation()
        if g is None:
            return None
        if self._book is None or self._book[0] != g:
            r = self.spark.read.parquet(f"{self.path}/codebook").where(F.col("generation") == g).first()
            size = r["size"]
            array = lambda name: np.frombuffer(r[name], np.float64)
            self._book = g, Codebook(array("groups").reshape(-1, size), np.frombuffer(r["group_of"], np.int64), array("centres").reshape(-1, size), array("points").reshape(-1, r["points_each"], r["run"]), r["rows"], r["probes"], r["depth"])
        return self._book[1]

    def _put(self, g: int, book: Codebook) -> None:
        row = (book.size, book.points.shape[1], book.points.shape[2], book.rows, book.probes, book.depth, bytearray(book.groups.tobytes()), bytearray(book.group_of.astype(np.int64).tobytes()), bytearray(book.centres.tobytes()), bytearray(book.points.tobytes()))
        schema = "size int, points_each int, run int, rows long, probes int, depth int, groups binary, group_of binary, centres binary, points binary"
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codebook/generation={g}")
        self._book = g, book

    def _table(self, name: str, g: int, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/generation={g}")

    def _schema(self) -> T.StructType:
        attributes = [T.StructField(a, T.StringType()) for a in self.attributes]
        return T.StructType([T.StructField("id", T.LongType()), *attributes, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.BinaryType()), T.StructField("batch", T.StringType()), T.StructField("list", T.IntegerType())])

    def entries(self) -> DataFrame:
        return self._table("entries", self.generation(), self._schema())

    def counts(self) -> DataFrame:
        """``list, attributes, n`` of each batch."""
        return self._table("counts", self.generation(), T.StructType([T.StructField("list", T.IntegerType()), *[T.StructField(a, T.StringType()) for a in self.attributes], T.StructField("n", T.LongType()), T.StructField("batch", T.StringType())]))

    # Writing.

    def _slim(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.select(F.col(self.id_col).cast("long").alias("id"), *keys, *[F.col(a).cast("string").alias(a) for a in self.attributes], F.col("embedding").cast("array<float>").alias("embedding"))

    def _write(self, g: int, book: Codebook, rows: DataFrame, batch: str | None) -> None:
        """Entries and counts of one batch, or of all batches of ``rows`` at once."""
        slim = self._slim(rows, *([] if batch else ["batch"]))
        send = self.spark.sparkContext.broadcast(book)
        schema = T.StructType([*slim.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())])
        at, keys = (f"generation={g}/batch={batch}", []) if batch else (f"generation={g}", ["batch"])
        # Rows of a list lie together, and a list with very many rows is split.
        dealt = slim.mapInArrow(_entries(send), schema).hint("rebalance", *[F.col(c) for c in [*keys, "list"]])
        dealt.sortWithinPartitions(*keys, "list", "id").write.mode("overwrite").partitionBy(*keys, "list").parquet(f"{self.path}/entries/{at}")
        stored = self.spark.read.schema(T.StructType([f for f in self._schema() if keys or f.name != "batch"])).parquet(f"{self.path}/entries/{at}")
        stored.groupBy(*keys, "list", *self.attributes).agg(F.count("*").alias("n")).write.mode("overwrite").partitionBy(*keys).parquet(f"{self.path}/counts/{at}")

    def append(self, rows: DataFrame, batch: str) -> bool:
        """Put a batch into the lists that there are; a batch that runs again replaces itself. False if nothing is fitted."""
        g = self.generation()
        if g is None:
            return False
        self._write(g, self.codebook(), rows, batch)
        return True

    def fit(self, rows: DataFrame) -> Codebook | None:
        """A new generation with all of ``rows``, which have a ``batch``; None if there are no rows."""
        s, g = self.shape, (self.generation() or 0) + 1
        slim = self._slim(rows)
        n = slim.count()
        if not n:
            return None
        sample = slim.orderBy(F.xxhash64("id"), "id").limit(s.sample).select("id", "embedding").toArrow()
        x = _rows(sample["embedding"])
        lists = min(MOST_LISTS, max(1, math.isqrt(n)))
        groups = _means(_unit(x), math.isqrt(lists), s.rounds, True)
        size = x.shape[1]
        # Enough rows for the centres of each list, and no more of a group than one task can take.
        share = min(1.0, LIST_ROWS * lists / n)
        h = F.xxhash64("id", F.lit("lists"))
        some = slim.where(F.abs(h % (1 << 20)) < max(1, math.ceil(share * (1 << 20)))).select(h.alias("h"), "embedding")
        near = some.mapInArrow(_grouped(self.spark.sparkContext.broadcast(groups), size), "grp int, h long, embedding array<float>")
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("h"))).where(F.col("place") <= GROUP_ROWS)
        sizes = near.groupBy("grp").agg((F.count("*") / F.lit(float(share * n)) * lists).alias("share"))
        found = ranked.join(F.broadcast(sizes), "grp").groupBy("grp").applyInPandas(_list_centres(s.rounds), "grp int, centre array<double>").toArrow()
        centres, group_of = _rows(found["centre"], size), found["grp"].to_numpy().astype(np.int64)
        order = np.lexsort((centres[:, 0], group_of))
        centres, group_of = centres[order], group_of[order]
        # A group that the second sample does not meet has its own centre as a list.
        bare = np.setdiff1d(np.arange(len(groups)), group_of)
        centres, group_of = np.vstack([centres.reshape(-1, size), groups[bare]]), np.concatenate([group_of, bare])
        book = Codebook(groups, group_of, centres, np.zeros((-(-size // s.run), 1, s.run)), n)
        left = book._runs(x - centres[book.assigned(x)])
        points = [_means(left[:, j], POINTS, s.rounds, False) for j in range(left.shape[1])]
        # Runs with few distinct values repeat their last point, so that all have as many.
        most = max(map(len, points))
        book = replace(book, points=np.stack([np.vstack([p, np.repeat(p[-1:], most - len(p), axis=0)]) for p in points]))
        self._write(g, book, rows, None)
        book = self._measured(g, book, slim, sample["id"].to_pylist()[: s.trials], x[: s.trials])
        self._put(g, book)
        return book

    def _measured(self, g: int, book: Codebook, slim: DataFrame, asked: list[int], x: np.ndarray) -> Codebook:
        """The fewest lists and candidates with which ``asked`` rows find enough of their nearest over all rows."""
        s = self.shape
        queries = self.spark.createDataFrame(list(zip(asked, x.tolist(), strict=True)), "query_id long, query_vector array<float>")
        exact = top_k_batch(slim, queries, s.k, ["id"]).select("query_id", "id")
        lists = self._table("entries", g, self._schema()).select("id", "list").join(F.broadcast(exact), "id").collect()
        order = {i: np.argsort(o) for i, o in zip(asked, book.order(x), strict=True)}
        places = np.sort([order[r["query_id"]][r["list"]] for r in lists])
        book = replace(book, probes=int(places[math.ceil(s.recall * len(places)) - 1]) + 1)
        true = {(r["query_id"], r["id"]) for r in lists}
        read = len({(r["query_id"], r["id"]) for r in lists if order[r["query_id"]][r["list"]] < book.probes})
        for _ in range(5):
            got = self._batch(self._table("entries", g, self._schema()), book, queries, s.k, None)
            hits = sum((r["query_id"], r["id"]) in true for r in got.select("query_id", "id").collect())
            if hits >= 0.99 * read:
                break
            book = replace(book, depth=2 * book.depth)
        return book

    # Searching.

    def _lists(self, book: Codebook, vectors: np.ndarray, where: Column | None, counts: DataFrame) -> list[np.ndarray]:
        """The lists that each query reads: the nearest, with a filter as many as hold enough rows that match."""
        order = book.order(vectors)
        if where is None:
            return [o[: book.probes] for o in order]
        # A row for each list: bounded by MOST_LISTS.
        there = counts.groupBy("list").agg(F.sum("n").alias("n"), F.sum(F.when(where, F.col("n"))).alias("match")).collect()
        n, match = np.zeros(len(book.centres)), np.zeros(len(book.centres))
        for r in there:
            n[r["list"]], match[r["list"]] = r["n"], r["match"] or 0
        out = []
        for o in order:
            enough = np.searchsorted(match[o].cumsum(), n[o[: book.probes]].sum()) + 1
            out.append(np.array([i for i in o[: max(enough, book.probes)] if match[i]], np.int64))
        return out

    def _near(self, entries: DataFrame, book: Codebook, vectors: np.ndarray, lists: list[np.ndarray], k: int, where: Column | None) -> DataFrame:
        reads: dict[int, list[int]] = {}
        for q, some in enumerate(lists):
            for i in some.tolist():
                reads.setdefault(i, []).append(q)
        send = self.spark.sparkContext.broadcast((book.tables(vectors), vectors @ book.centres.T, reads))
        rows = entries.where(F.col("list").isin(sorted(reads)))
        if where is not None:
            rows = rows.where(where)
        return rows.select("id", "code", "list").mapInArrow(_candidates(send, k), "q int, id long, list int, near double")

    def search(self, vector: Sequence[float], k: int, where: Column | None = None, batches: DataFrame | None = None) -> DataFrame:
        """``id_col, retrieval_score, rank`` of the ``k`` nearest rows that the index finds, of those that match ``where`` (over attributes).

        ``batches (batch)`` are those that count. Ties go by ascending id.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        book = self.codebook()
        if len(vector) != book.size:
            raise ValueError(f"expected {book.size} dimensions, found {len(vector)}")
        entries, counts = self.entries(), self.counts()
        if batches is not None:
            entries, counts = (x.join(F.broadcast(batches), "batch", "left_semi") for x in (entries, counts))
        x = np.array([vector], np.float64)
        lists = self._lists(book, x, where, counts)
        near = self._near(entries, book, x, lists, book.depth * k, where).orderBy(F.desc("near"), "id").limit(book.depth * k).collect()
        # The candidates reach the scan of the vectors as filters.
        some = entries.where(F.col("list").isin(sorted({r["list"] for r in near})) & F.col("id").isin([r["id"] for r in near])).select("id", "embedding")
        return top_k(some, vector, k, ["id"]).select(F.col("id").alias(self.id_col), "retrieval_score", "rank")

    def _batch(self, entries: DataFrame, book: Codebook, queries: DataFrame, k: int, where: Column | None, counts: DataFrame | None = None) -> DataFrame:
        out, asked = None, []

        def block() -> DataFrame:
            x = np.array([r["query_vector"] for r in asked], np.float64)
            if x.ndim != 2 or x.shape[1] != book.size:
                raise ValueError(f"queries do not all have {book.size} dimensions")
            near = self._near(entries, book, x, self._lists(book, x, where, counts), book.depth * k, where)
            best = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))).where(F.col("place") <= book.depth * k)
            # QUERY_BLOCK rows of one vector.
            names = F.broadcast(self.spark.createDataFrame([(q, r["query_id"], r["query_vector"]) for q, r in enumerate(asked)], "q int, query_id long, query_vector array<float>"))
            # Neither vectors nor candidates go by way of the driver; all blocks read one exchange of the vectors.
            scored = entries.select("id", "list", "embedding").join(best.select("q", "id", "list").hint("merge"), ["list", "id"]).join(names, "q")
            return scored.select("query_id", "id", score(dot(F.col("embedding"), F.col("query_vector"))).alias("retrieval_score"))

        for r in queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<float>").alias("query_vector")).toLocalIterator():
            asked.append(r)
            if len(asked) == QUERY_BLOCK:
                out = block() if out is None else out.unionByName(block())
                asked = []
        if asked:
            out = block() if out is None else out.unionByName(block())
        if out is None:
            out = self.spark.createDataFrame([], "query_id long, id long, retrieval_score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "id")
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search_batch(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """``query_id, id_col, retrieval_score, rank`` for each row of ``queries (query_id, query_vector)``, block by block."""
        return self._batch(self.entries(), self.codebook(), queries, k, where, self.counts()).withColumnRenamed("id", self.id_col)
