"""Target-distribution importance resampling: documents are drawn by how much their n-grams look like a target's.

Hashed runs of one to three words are counted in both tables; a document's weight
is the sum of its features' gains, and adding Gumbel noise to weights and taking
the greatest draws without return in proportion to them.

A long text would keep one task busy, so it is cut at word boundaries into chunks
that are dealt out. A chunk owns the features that start in it and carries the
next n - 1 words, so that those of its last words are whole. Counts of features
are summed over chunks, and weights of chunks by document.

CRC-32 is linear, so a run's checksum follows from those of its words: tables say
what a word's length does to the checksum of what is before it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, sliced, texts, unkeyed, written

#: Longest runs of words, buckets, documents of the draw in a hundred, words that a drawn document has at least.
RUNS, BUCKETS, PERCENT, LEAST_WORDS = 3, 10_000, 5, 20
#: Bytes of a chunk; longer texts are cut.
CHUNK = 1 << 16
#: Words that are looked at together.
BLOCK = 1 << 16
#: Drawn rows of a range, and most ranges; beyond it they grow.
RANGE_ROWS, MOST_RANGES = 1_000, 10_000
#: Accuracy of the quantile that a draw starts from; the draw itself is exact.
ACCURACY = 10_000

#: A-Z are lower-cased; all of ASCII but letters and digits stands between words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
_START = re.compile(rb" [^ ]")
#: The reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
#: Words up to this length go by table.
_TABLED = 48


def _tables() -> np.ndarray:
    """``[length, byte of the checksum, its value]``: what a checksum becomes when so many bytes follow, before these are added."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
    out = np.zeros((_TABLED + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _TABLED + 2):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


_MOVED = _tables()


def _followed(before: np.ndarray, words: list[bytes], crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of what ``before`` stands for, a space, and the word at the same place."""
    n = np.minimum(length + 1, _TABLED + 1)
    out = crc.copy()
    for k in range(4):
        out ^= _MOVED[n, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(length > _TABLED):
        out[i] = zlib.crc32(b" " + words[i], int(before[i]))
    return out


#: Checksum of a space, moved by so many bytes.
_SPACE = np.bitwise_xor.reduce([_MOVED[:, k, (zlib.crc32(b" ") >> 8 * k) & 255] for k in range(4)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def features(words: list[bytes], ends: np.ndarray, runs: int = RUNS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: the buckets, and the places of the words where they start. ``ends``: where each text ends in ``words``."""
    if not words:
        return
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(words))
    # A word behind a space: linear, so the space's part is added.
    spaced = crc ^ _SPACE[np.minimum(length, _TABLED + 1)]
    run = crc
    for k in range(1, runs + 1):
        at = np.flatnonzero(left >= k)
        yield (run[at] % np.uint32(buckets)).astype(np.int64), at
        if k < runs:
            n = len(run) - 1
            run = _followed(run[:n], words[k:], spaced[k:], length[k:])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """Rows of a batch with their words together: first row, row behind the last, words, where each ends, how many it owns."""
    words: list[bytes] = []
    ends, owns, at = [], [], 0
    carried = batch.column("carried").to_pylist()
    for i, t in enumerate(texts(batch.column("words"))):
        words += words_of(t)
        ends.append(len(words))
        owns.append(len(words) - (ends[-2] if len(ends) > 1 else 0) - carried[i])
        if len(words) >= BLOCK:
            yield at, i + 1, words, np.array(ends), np.array(owns)
            words, ends, owns, at = [], [], [], i + 1
    if ends:
        yield at, batch.num_rows, words, np.array(ends), np.array(owns)


def _owned(ends: np.ndarray, owns: np.ndarray, n: int) -> np.ndarray:
    """Which words start the features of their chunk."""
    size = np.diff(ends, prepend=0)
    return np.arange(n) - np.repeat(ends - size, size) < np.repeat(owns, size)


def _counts(runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in sliced(batches):
            for _, _, words, ends, owns in _blocks(b):
                own = _owned(ends, owns, len(words))
                for bucket, at in features(words, ends, runs, buckets):
                    total += np.bincount(bucket[own[at]], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])

    return run


def _weights(gains, runs: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            gain, out = gains.value, []
            for _, _, words, ends, owns in _blocks(b):
                n, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                own = _owned(ends, owns, len(words))
                for bucket, at in features(words, ends, runs, buckets):
                    n[at] += 1
                    weight[at] += gain[bucket]
                starts = np.concatenate([[0], ends])
                sums = [np.concatenate([[0], np.cumsum(x * own)])[starts] for x in (n, weight)]
                out.append([owns, *(np.diff(s) for s in sums)])
            found = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            kept = [c for c in b.schema.names if c not in ("words", "carried")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in found)], [*kept, "n_words", "n_features", "weight"])

    return run


def chunks(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """A text's chunks, lower-cased and with spaces between words, and how many words each carries."""
    text = text.translate(_LETTERS)
    more = re.compile(rb"(?:[^ ]+ *){0,%d}" % carry)
    at = 0
    while at < len(text):
        found = _START.search(text, at + size - 1)
        end = found.start() + 1 if found else len(text)
        behind = more.match(text, end).end()
        yield text[at:behind], len(text[end:behind].split())
        at = end


def _chunked(size: int, carry: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            row, rest, id_, text = b.column("row")[0].as_py(), b.column("rest"), b.column("id"), b.column("text")
            for k, (words, carried) in enumerate(chunks(texts(text)[0], size, carry)):
                yield pa.RecordBatch.from_arrays([pa.array([row]), id_, *([text if k == 0 else pa.nulls(1, pa.string())] if keep_text else []), rest, pa.array([words], pa.binary()), pa.array([carried], pa.int32())], ["row", "id", *(["text"] if keep_text else []), "rest", "words", "carried"])

    return run


def _parts(slim: DataFrame, runs: int, chunk: int, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """Short texts where they are, and the chunks of long ones, dealt out."""
    rest = slim.schema["rest"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = slim.where(size <= chunk).select("id", *(["text"] if keep_text else []), "rest", F.col("text").cast("binary").alias("words"), F.lit(0).alias("carried"))
    long = slim.where(size > chunk).withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text", "rest")
    cut = long.mapInArrow(_chunked(chunk, runs - 1, keep_text), f"row long, id long, {'text string, ' if keep_text else ''}rest {rest}, words binary, carried int")
    return short, cut.repartition("row", F.xxhash64("words"))


def counted(docs: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, chunk: int = CHUNK) -> np.ndarray:
    """How many features all texts have in each bucket; ``buckets`` numbers reach the driver, whatever the input."""
    slim = docs.select(F.lit(None).cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(None).cast("int").alias("none")).alias("rest"))
    parts = [p.select("words", "carried").mapInArrow(_counts(runs, buckets), "bucket long, n long") for p in _parts(slim, runs, chunk, False)]
    out = np.zeros(buckets, np.int64)
    for r in parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of the ratio of smoothed shares, rounded down."""
    k = len(source)
    s, t = float(int(source.sum()) + k), float(int(target.sum()) + k)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(id_: Column, seed: int) -> Column:
    """Gumbel noise, a thousand times and rounded down, by a hash of the id; a null id counts as an empty one."""
    head = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256).substr(1, 8)
    h = F.conv(head, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _drawn(table: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may be among the ``k`` greatest with their ``place`` (from 1), and all others.

    A quantile that is a little too low, checked by a count, leaves few rows; these
    are sorted by ranges and numbered from what the ranges before them hold.
    """
    fit = table.where("fit")
    total, margin = fit.count(), 2 / ACCURACY
    while True:
        share = 1 - k / total - margin
        bound = fit.agg(F.percentile_approx("score", share, ACCURACY)).first()[0] if share > 0 else fit.agg(F.min("score")).first()[0]
        n = fit.where(F.col("score") >= bound).count()
        if n >= k:
            break
        margin *= 2
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    near = F.col("fit") & (F.col("score") >= bound)
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    sorted_ = table.where(near).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The upper bits of this number are those of the partition, the lower ones count in it.
    placed, _ = written(sorted_.withColumn("at", F.monotonically_increasing_id()), "drawn")
    before, offsets = 0, []
    for r in placed.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    # At most MOST_RANGES rows: a proven bound.
    starts = F.broadcast(table.sparkSession.createDataFrame(offsets, "part long, before long"))
    placed = placed.withColumn("part", F.shiftright("at", 33)).join(starts, "part")
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at"), table.where(~near)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = 42, chunk: int = CHUNK, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight, score`` and ``rank`` behind its columns.

    ``rank`` is 1, 2, ... for the ``percent`` hundredths (rounded down) of the rows
    with at least ``least_words`` words that have the greatest scores, by score and
    then the lesser id, null last; null for all others, so
    ``where("rank is not null")`` is the sample. Null and empty texts have no
    features and weight 0. Repeated rows count and are drawn each for itself; those
    of one id and score are drawn in no stated order. An empty table stays
    empty, an empty target gives the gains of zero counts. Texts of any length are
    counted whole, in chunks. Columns of ``docs`` with the names of the added ones
    are replaced; with ``keep_text=False`` the text is not returned. Ids must be
    integers or null.
    """
    added = ["n_words", "n_features", "weight", "score", "rank"]
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    spark: SparkSession = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(counted(docs, text_col, runs, buckets, chunk), counted(target, target_col, runs, buckets, chunk)))
    slim, others = keyed(docs, id_col, text_col)
    rest = slim.schema["rest"].dataType.simpleString()
    short, cut = _parts(slim, runs, chunk, keep_text)
    kept = f"id long, {'text string, ' if keep_text else ''}rest {rest}"
    run, sums = _weights(gain, runs, buckets), ["n_words", "n_features", "weight"]
    short = short.mapInArrow(run, f"{kept}, n_words long, n_features long, weight long")
    # All chunks of a row have its id and its other columns; the first one has the text.
    whole = cut.mapInArrow(run, f"row long, {kept}, n_words long, n_features long, weight long").groupBy("row").agg(*[F.first(c, ignorenulls=c == "text").alias(c) for c in short.columns if c not in sums], *[F.sum(c).alias(c) for c in sums])
    both = short.unionByName(whole.drop("row")).withColumn("score", F.col("weight") + _noise(F.col("id"), seed)).withColumn("fit", F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id())
    table, _ = written(both, "weighed")
    k = percent * table.where("fit").count() // 100
    nothing = F.lit(None).cast("long")
    if k:
        placed, other = _drawn(table, k)
        out = placed.withColumn("rank", F.when(F.col("place") <= k, F.col("place"))).drop("place").unionByName(other.withColumn("rank", nothing))
    else:
        out = table.withColumn("rank", nothing)
    if not keep_text:
        out = out.withColumn("text", F.lit(None).cast("string"))
    return unkeyed(out, [c for c in docs.columns if keep_text or c != text_col], id_col, text_col, others, {c: F.col(c) for c in added})
