"""What several operators share: the shared folder, bucket counts, words, Arrow columns."""

from __future__ import annotations

import ctypes
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids are compared as 64-bit integers; a null id sorts behind every other.
NULL_ID = np.iinfo(np.int64).max


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and all runs on this machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table made by :func:`written` that nothing lazy reads any more."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        shutil.rmtree(at.path, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables on the way to a result; they go when the result is written, which alone stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out, _ = written(df, name)
        self.clear()
        return out

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that ``df`` reads, each counted once for each scan.

    The planner knows them without a job. Its estimate for the whole plan is of
    no use: it multiplies the sides of a join and shrinks with every column left
    out. Rows that come from the driver have no size, so their strings are counted.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > 1 << 60:
        strings = [F.coalesce(F.octet_length(F.col(quoted(f.name))), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
        size = df.select(F.sum(sum(strings, F.lit(16)).cast("long")).alias("n")).first()["n"] or 0
    return size


#: Most buckets of an exchange; beyond it they grow.
MOST_BUCKETS = 1 << 20


def bucket_count(df: DataFrame, bytes_each: int, most: int = MOST_BUCKETS) -> int:
    """How many buckets of about ``bytes_each`` the input makes, ``most`` at most.

    Only the parallelism depends on it, never a result.
    """
    return min(most, max(1, math.ceil(input_bytes(df) / bytes_each)))


#: A key with more than this part of all rows is hot, so there are at most so many hot keys.
HOT = 1 << 10


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str = "n", how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and says in ``rows`` how many of ``left`` have it.

    The row of a hot key goes to all tasks (at most ``HOT`` rows: a proven bound), so its many
    rows stay where they are; all others are exchanged by key. ``left`` is read
    twice, so it should be a table. ``how``: inner or left. Null keys match nothing.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot = right.where(F.col(rows) * HOT > total)
    cold = right.where(F.col(rows) * HOT <= total)
    some = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    if how == "left":
        # Rows without a key are dealt out by their other values instead of meeting in one task.
        none = rest.where(F.col(key).isNull())
        rest = rest.where(F.col(key).isNotNull()).join(cold, key, "left")
        for c in cold.columns:
            if c != key:
                none = none.withColumn(c, F.lit(None).cast(cold.schema[c].dataType))
        rest = rest.unionByName(none.select(rest.columns))
    else:
        rest = rest.join(cold, key)
    return some.unionByName(rest).drop(rows)


def quoted(name: str) -> str:
    """A column's name as an expression that takes it literally."""
    return f"`{name.replace('`', '``')}`"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``id long, text string, rest struct`` of any table; with :func:`unkeyed` no name can clash. Ids must be integers."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"ids must be integers, and {id_col} is {kind.simpleString()}")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), rest.alias("rest")), others


def unkeyed(df: DataFrame, columns: list[str], id_col: str, text_col: str, others: list[str], more: dict | None = None) -> DataFrame:
    """Back to the caller's columns, in their order, with ``more`` behind them."""
    at = {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    out = [(F.col("id") if c == id_col else F.col("text") if c == text_col else at[c]).alias(c) for c in columns]
    return df.select(*out, *[v.alias(k) for k, v in (more or {}).items()])


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each row, empty for null."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024, give_back: bool = True) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so that Python holds the objects of one slice only; afterwards memory goes back.

    ``give_back=False`` is for workers that keep what they learned from task to task.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    if give_back:
        release()


def release() -> None:
    """Give freed memory back to the system: a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.int64()).fill_null(NULL_ID).to_numpy()


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that their order is as good as random."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


#: Odd factor of the rolling hash over words.
FACTOR = 0x9E3779B97F4A7C15


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on, by joining runs of doubling length."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    run, length, out, done = h, 1, None, 0
    while True:
        if n & length:
            if out is None:
                out = run
            else:
                m = len(h) - (done + length) + 1
                out = out[:m] * np.uint64(pow(FACTOR, length, 1 << 64)) + run[done : done + m]
            done += length
        if done == n:
            return out
        m = len(run) - length
        run = run[:m] * np.uint64(pow(FACTOR, length, 1 << 64)) + run[length : length + m]
        length *= 2


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a number; ``h`` is not empty."""
    # Bits by position: bit i of the fingerprint is bit i % 8 of little-endian byte i // 8.
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])
