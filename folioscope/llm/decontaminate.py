"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is what a task reads next, up to ``SHARD_WORDS`` words. Words that no
phrase has cannot lie inside an occurrence, so they end a run, and runs shorter
than the shortest phrase are left out; what stays is numbered, indexed, searched
backwards for all phrases at once, and located by sampled positions. Occurrences
merge to removal spans. One pass over the documents, no shuffle.

The phrases go to all tasks, as one array of word numbers and the places where
distinct phrases start. They are taken in blocks of at most ``BLOCK_BYTES`` of
benchmark text: one pass for each, written before the next begins, so that
driver and workers hold the phrases of one block at a time, about ten times its
text at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, mixed, rolled, sliced, texts, unkeyed, written
from .common import remove as delete
from .fmindex import FMIndex

BLOCK_BYTES = 8 << 20
SHARD_WORDS = 400_000
#: Phrases that are searched at once.
PHRASES = 1 << 18

#: Bytes that end a word are made spaces; A-Z are lower-cased.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


@dataclass(frozen=True)
class OfLength:
    """The distinct phrases of one length: where each starts, and its items from ``offsets[i]`` on."""

    size: int
    starts: np.ndarray
    offsets: np.ndarray
    items: np.ndarray


class Phrases:
    """Windows of the items, by length, as places in a row of word numbers; and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        name = {x: i for i, x in enumerate(self.names)}
        rows, owner, sizes = [], [], []
        for item, text in items:
            w = words_of(text)
            if w:
                rows.append(np.fromiter((self.number.setdefault(x, len(self.number) + 1) for x in w), np.int32, len(w)))
                owner.append(name[item])
                sizes.append(min(window, len(w)))
        self.flat = np.concatenate([np.zeros(0, np.int32), *rows])
        length = np.array([len(r) for r in rows], np.int64)
        first = np.cumsum(length) - length
        self.by_length = [self._of(n, first, length, np.array(owner, np.int32), np.array(sizes)) for n in sorted(set(sizes))]
        self.shortest = min(sizes, default=0)

    def _of(self, size: int, first: np.ndarray, length: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> OfLength:
        own = np.flatnonzero(sizes == size)
        times = length[own] - size + 1
        starts = np.repeat(first[own] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        item = np.repeat(owner[own], times)
        _, at, same = np.unique(rolled(mixed(self.flat.astype(np.uint64)), size)[starts], return_index=True, return_inverse=True)
        if any((self.flat[starts + o] != self.flat[starts[at][same] + o]).any() for o in range(size)):
            at = same = np.arange(len(starts))  # two phrases with one hash: none are put together
        pairs = np.unique(same.astype(np.int64) * len(self.names) + item)
        return OfLength(size, starts[at], np.searchsorted(pairs // len(self.names), np.arange(len(at) + 1)), (pairs % len(self.names)).astype(np.int32))

    def hits(self, docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
        """For each document (start, end, item) of each occurrence."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        get = self.number.get
        runs, owner, at = [], [], []
        for d, words in enumerate(docs):
            if len(words) < self.shortest or not self.shortest:
                continue
            x = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(x > 0, prepend=False, append=False)).reshape(-1, 2)
            for a, b in edge[edge[:, 1] - edge[:, 0] >= self.shortest].tolist():
                runs.append(x[a:b])
                owner.append(d)
                at.append(a)
        if not runs:
            return out
        # Numbers of this shard only, so that the wavelet matrix has few levels; 1 ends a run.
        flat = np.concatenate([np.r_[r, 0] for r in runs])
        kinds = np.unique(flat)
        there = np.zeros(len(self.number) + 1, bool)
        there[kinds] = True
        index = FMIndex(np.searchsorted(kinds, flat) + 1)
        ends = np.cumsum([len(r) + 1 for r in runs])
        for of in self.by_length:
            which = np.arange(len(of.starts))
            for o in range(of.size):
                which = which[there[self.flat[of.starts[which] + o]]]
            for part in np.array_split(which, len(which) // PHRASES + 1):
                phrases = self.flat[of.starts[part][:, None] + np.arange(of.size)]
                lo, hi = index.search(np.searchsorted(kinds, phrases) + 1)
                times = hi - lo
                rows = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                places = index.locate(rows)
                run = np.searchsorted(ends, places, side="right")
                for p, r, k in zip(places.tolist(), run.tolist(), np.repeat(part, times).tolist(), strict=True):
                    start = at[r] + p - int(ends[r] - len(runs[r]) - 1)
                    out[owner[r]] += [(start, start + of.size, i) for i in of.items[of.offsets[k] : of.offsets[k + 1]].tolist()]
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` from which the words of ``spans``, and what lies between them, are cut."""
    if not spans:
        return text
    plain, at, edges = text.translate(_WORD), 0, []
    for w in plain.split():
        at = plain.index(w, at)
        edges.append((at, at + len(w)))
        at += len(w)
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : edges[a][0]])
        last = edges[b - 1][1]
    return b"".join([*kept, text[last:]])


_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _searches(phrases, shard_words: int, remove: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        for b in sliced(batches):
            data = texts(b.column("text"))
            found, docs, size = [], [], 0

            def close():
                for words, hits in zip(docs, p.hits(docs), strict=True):
                    found.append({"n_words": len(words), "spans": [{"start": a, "end": z} for a, z in merged([h[:2] for h in hits])], "items": [p.names[i] for i in sorted({h[2] for h in hits})]})
                docs.clear()

            for t in data:
                docs.append(words_of(t))
                size += len(docs[-1])
                if size >= shard_words:
                    close()
                    size = 0
            close()
            before = b.column("found").to_pylist()
            if any(x is not None for x in before):
                found = [_joined(x, y) for x, y in zip(before, found, strict=True)]
            text = b.column("text")
            if remove and any(x["spans"] for x in found):
                text = pa.array([cut(t, [(s["start"], s["end"]) for s in x["spans"]]) for t, x in zip(data, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), text, b.column("rest"), pa.array(found, _FOUND)], ["id", "text", "rest", "found"])

    return run


def _joined(x: dict | None, y: dict) -> dict:
    if x is None:
        return y
    spans = merged([(s["start"], s["end"]) for s in x["spans"] + y["spans"]])
    return {"n_words": y["n_words"], "spans": [{"start": a, "end": z} for a, z in spans], "items": sorted({*x["items"], *y["items"]})}


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS, remove: bool = False) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items`` (sorted as strings), ``spans`` (removal spans, in words) and ``contaminated``.

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased. An item's windows are ``window`` words, an item of
    fewer is one window, one of none has none. With ``remove`` the spans are cut
    from the text. Null and empty texts have no words, null items have no name
    and are searched as the empty one, repeated rows are each reported, items
    that repeat a name count as one. Texts of any length are read whole: a shard
    ends behind a text, not in it. An empty table on either side finds
    nothing. Ids of documents must be integers. Columns of ``docs`` with the names of the added ones are replaced.
    """
    added = ["n_words", "n_hit", "items", "spans", "contaminated"]
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    spark = docs.sparkSession
    slim, others = keyed(docs, id_col, text_col)
    rest = slim.schema["rest"].dataType.simpleString()
    out = slim.withColumn("found", F.lit(None).cast(_FOUND_SQL))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("length(text) > 0")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    last = None
    for i in range(blocks):
        some = [(r["item"], r["text"].encode()) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).toLocalIterator()]
        phrases = spark.sparkContext.broadcast(Phrases(some, window))
        out = out.mapInArrow(_searches(phrases, shard_words, remove and i == blocks - 1), f"id long, text string, rest {rest}, found {_FOUND_SQL}")
        if i < blocks - 1:
            out, path = written(out, "found")
            phrases.destroy()
            if last:
                delete(spark, last)
            last = path
    out = out.select("id", "text", "rest", "found.*").withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
    return unkeyed(out, docs.columns, id_col, text_col, others, {"n_words": F.col("n_words"), "n_hit": F.col("n_hit"), "items": F.col("items"), "spans": F.col("spans"), "contaminated": F.col("n_hit") > 0})


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
