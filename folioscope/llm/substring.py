"""Exact substring deduplication by seed and extend.

A window is ``length`` consecutive words of one document; every window whose
words also start earlier is a repeat, and the words of repeats go.

1. Seeds. Winnowing (Schleimer, Wilkerson and Aiken, 2003) takes from each
   window the least hash of its ``seed``-word grams, so equal windows have equal
   anchors. Each bucket of documents sends its distinct anchors, and an anchor
   that two buckets or two places have is a seed.
2. Join and extension. Each place of a seed goes to the part of its anchor, with
   the hashes of the words that lie within a window's reach on both sides. There
   matches are extended word by word to the left and to the right; where both
   sides together make ``length`` words, the places that agree so far are grouped,
   their words are compared one by one with those of the earliest, and all but
   that one are repeats. Of places of a bucket that agree in all these words only
   the first is sent. An anchor that very many buckets have is not joined in one
   part: each of its extensions goes to a part of its own words.
3. Overlapping repeats join to maximal repeats, and their words are cut.

Documents are dealt to buckets by id and text; texts too short for a window go
nowhere. Every exchange carries packed numbers; the texts are exchanged once, and
the plan reuses that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FACTOR, hashes, ids, input_bytes, keyed, mixed, release, rolled, texts, unkeyed

BUCKET_BYTES = 2 << 20
#: An anchor of more buckets is hot.
HOT_BUCKETS = 64
def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(x)], strict=True)) if len(x) else []


class Bucket:
    """The documents of a bucket in ascending id order, and the hashes of their words in a row."""

    def __init__(self, table: pa.Table, length: int, seed: int, hashed: bool = True):
        self.table = table
        id_ = ids(table.column("id"))
        data = texts(table.column("text"))
        self.order = sorted(range(len(data)), key=lambda i: (id_[i], data[i]))
        self.ids = id_[self.order] if len(data) else np.zeros(0, np.int64)
        self.texts = [data[i] for i in self.order]
        self.length = length
        # Equal rows are handled as the first of them.
        new = [i == 0 or self.ids[i] != self.ids[i - 1] or self.texts[i] != self.texts[i - 1] for i in range(len(data))]
        self.first = np.maximum.accumulate(np.where(new, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        words = [t.split() if own or not hashed else [] for t, own in zip(self.texts, new, strict=True)]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        if not hashed:
            return
        self.hash = np.concatenate([hashes(w) for w in words]) if words else np.zeros(0, np.uint64)
        n = max(0, len(self.hash) - length + 1)
        # A window counts if its document does not end within it.
        self.valid = np.zeros(n, bool)
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            if b - a >= length:
                self.valid[a : b - length + 1] = True
        self.grams = mixed(rolled(self.hash, seed))
        wide = length - seed + 1
        self.anchor, step = self.grams, 1
        while step < wide:
            # Least of the next 2 * step, or of just ``wide`` in the end.
            by = min(step, wide - step)
            self.anchor = np.minimum(self.anchor[: max(0, len(self.anchor) - by)], self.anchor[by:])
            step += by
        self.wide = wide

    def anchors(self) -> np.ndarray:
        """The places of grams that are the anchor of a window."""
        picked = np.zeros(len(self.grams), bool)
        n = len(self.valid)
        for o in range(self.wide):
            picked[o : o + n] |= (self.grams[o : o + n] == self.anchor) & self.valid
        return np.flatnonzero(picked)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and whether each has two places or more here."""
        values, times = np.unique(self.grams[self.anchors()], return_counts=True)
        return values, times > 1


_HASHES = "part int, bucket int, data binary"
_REPEATS = "bucket int, rows binary, places binary, bits binary"


def _by_part(anchor: np.ndarray, parts: int) -> np.ndarray:
    """The part of each anchor. Anchors are least hashes, so most are small; scrambled again they spread evenly."""
    return (mixed(anchor + np.uint64(FACTOR)) % np.uint64(parts)).astype(np.int64)


def _anchors(length: int, seed: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        values, _ = Bucket(table, length, seed).places()
        part, bucket = _by_part(values, parts), table.column("bucket")[0].as_py()
        order = np.argsort(part, kind="stable")
        values, part = values[order], part[order]
        cut = _runs(part)
        release()
        return pa.table([pa.array([int(part[a]) for a, _ in cut], pa.int32()), pa.array([bucket] * len(cut), pa.int32()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary())], ["part", "bucket", "data"])

    return run


def _seeds(table: pa.Table) -> pa.Table:
    """Of the anchors of one part, those that several buckets have, for each of these; and which are hot."""
    blobs, bucket = table.column("data").to_pylist(), table.column("bucket").to_numpy()
    values = np.frombuffer(b"".join(blobs), np.uint64)
    owner = np.repeat(bucket, [len(x) // 8 for x in blobs])
    order = np.lexsort((values, owner))
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    times = times[at[order]]
    order, times = order[times > 1], times[times > 1]
    values, owner, hot = values[order], owner[order], times > HOT_BUCKETS
    cut = _runs(owner)
    return pa.table([pa.array([int(owner[a]) for a, _ in cut], pa.int32()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([hot[a:b].tobytes() for a, b in cut], pa.binary())], ["bucket", "data", "hot"])


class Places:
    """Places of seeds, with the words within reach: how many there are on either side, and their hashes outwards."""

    def __init__(self, anchor, left, right, words, id_, doc, place):
        self.anchor, self.left, self.right, self.words, self.id, self.doc, self.place = anchor, left, right, words, id_, doc, place

    def __len__(self) -> int:
        return len(self.anchor)

    def take(self, i: np.ndarray) -> Places:
        return Places(*[x[i] for x in (self.anchor, self.left, self.right, self.words, self.id, self.doc, self.place)])

    @property
    def reach(self) -> int:
        return self.words.shape[1] // 2

    def clipped(self) -> Places:
        """Each place once for each extension to a whole window, with the words of that window alone."""
        w = self.reach
        some = []
        for n in range(w + 1):
            p = self.take(np.flatnonzero((self.left >= n) & (self.right >= w - n)))
            words = p.words.copy()
            words[:, n:w] = 0
            words[:, w + w - n :] = 0
            some.append(Places(p.anchor, np.full(len(p), n, np.uint8), np.full(len(p), w - n, np.uint8), words, p.id, p.doc, p.place))
        return Places(*[np.concatenate(x) for x in zip(*[(p.anchor, p.left, p.right, p.words, p.id, p.doc, p.place) for p in some], strict=True)])

    def keys(self) -> np.ndarray:
        """A hash of anchor and words, and of where they end."""
        h = self.anchor + self.left * np.uint64(64) + self.right
        for c in self.words.T:
            h = h * np.uint64(FACTOR) + c
        return mixed(h)

    def whole(self) -> np.ndarray:
        """The extensions that make a window, as packed bits by the words on the left."""
        n = np.arange(self.reach + 1)
        return np.packbits((self.left[:, None] >= n) & (self.right[:, None] >= self.reach - n), axis=1)


def _first_alike(key: np.ndarray, rows: np.ndarray, id_: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row the position of the earliest one with the same words; ``key`` is a hash of them."""
    order = np.lexsort((start, id_, key))
    k = key[order]
    first = np.empty(len(k), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]][: len(k)], np.arange(len(k)), 0))]
    if (rows == rows[first]).all():
        return first
    # Two sequences of words with one hash: by the words alone.
    same = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)
    return _first_alike(same, np.zeros((len(rows), 0), rows.dtype), id_, start)


_SENT = "part int, bucket int, anchors binary, sides binary, words binary, ids binary, rows binary, places binary, bits binary"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]


def _places(length: int, seed: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            b = Bucket(left, length, seed)
            values, twice = b.places()
            sent = np.frombuffer(b"".join(right.column("data").to_pylist()), np.uint64)
            hot = sent[np.frombuffer(b"".join(right.column("hot").to_pylist()), bool)]
            at = b.anchors()
            at = at[np.isin(b.grams[at], np.union1d(values[twice], sent))]
            doc = np.searchsorted(b.ends, at, side="right")
            w = length - seed
            before, behind = np.minimum(w, at - b.starts[doc]), np.minimum(w, b.ends[doc] - at - seed)
            j = np.arange(w)
            near = np.concatenate([at[:, None] - 1 - j, at[:, None] + seed + j], axis=1)
            there = np.concatenate([j < before[:, None], j < behind[:, None]], axis=1)
            short = b.hash.astype(np.uint32)
            words = np.where(there, short[np.clip(near, 0, max(0, len(short) - 1))], 0).astype(np.uint32) if len(at) else np.zeros((0, 2 * w), np.uint32)
            p = Places(b.grams[at], before.astype(np.uint8), behind.astype(np.uint8), words, b.ids[doc], doc.astype(np.int32), (at - b.starts[doc]).astype(np.int32))
            is_hot = np.isin(p.anchor, hot)
            bucket = left.column("bucket")[0].as_py()
            for own, by_words in ((p.take(np.flatnonzero(~is_hot)), False), (p.take(np.flatnonzero(is_hot)).clipped(), True)):
                if not len(own):
                    continue
                # Places alike in all these words are repeats of the first of them; those of rows under its id and place are no repeats.
                key = own.keys()
                first = _first_alike(key, np.c_[own.words, own.left, own.right, own.anchor.view(np.uint32).reshape(-1, 2)], own.id, own.place)
                known = (own.id != own.id[first]) | (own.place != own.place[first])
                if known.any():
                    k = own.take(np.flatnonzero(known))
                    out.append((-1 - bucket % parts, bucket, b"", b"", b"", b"", k.doc.tobytes(), k.place.tobytes(), k.whole().tobytes()))
                keep = np.flatnonzero(~known)
                part = _by_part(key[keep] if by_words else own.anchor[keep], parts)
                order = np.argsort(part, kind="stable")
                keep, part = keep[order], part[order]
                for a, z in _runs(part):
                    s = own.take(keep[a:z])
                    out.append((int(part[a]), bucket, s.anchor.tobytes(), s.left.tobytes() + s.right.tobytes(), s.words.tobytes(), s.id.tobytes(), s.doc.tobytes(), s.place.tobytes(), b""))
        release()
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 7)
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], _SENT_NAMES)

    return run


def extended(p: Places) -> np.ndarray:
    """Of each place the extensions to a window whose words start earlier, a column for each number of words on the left.

    Matches grow from the anchor by one word at a time: a hash of the first n
    words on a side comes from that of n - 1. Places that agree on both sides are
    then compared with the earliest, word by word.
    """
    w = p.reach
    late = np.zeros((len(p), w + 1), bool)
    left, right = [p.anchor], [np.zeros(len(p), np.uint64)]
    for n in range(w):
        left.append(left[-1] * np.uint64(FACTOR) + p.words[:, n])
        right.append(right[-1] * np.uint64(FACTOR) + p.words[:, w + n])
    ends = p.anchor.view(np.uint32).reshape(-1, 2)
    for n in range(w + 1):
        i = np.flatnonzero((p.left >= n) & (p.right >= w - n))
        if len(i) < 2:
            continue
        key = mixed(mixed(left[n][i]) + right[w - n][i])
        # Only keys that two places have can be repeats.
        kinds, at, times = np.unique(key, return_inverse=True, return_counts=True)
        some = times[at] > 1
        i, key = i[some], key[some]
        rows = np.c_[ends[i], p.words[i, :n], p.words[i, w : w + w - n]]
        start = p.place[i] - n
        first = _first_alike(key, rows, p.id[i], start)
        late[i, n] = (p.id[i] != p.id[i][first]) | (start != start[first])
    return late


def _earliest(length: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        """Of the windows of one part all but the earliest of each kind, for their buckets."""
        every = table.to_pylist()
        rows = [r for r in every if not r["bits"]]
        out = [(r["bucket"], r["rows"], r["places"], r["bits"]) for r in every if r["bits"]]
        if rows:
            joined = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
            sides = [np.frombuffer(r["sides"], np.uint8).reshape(2, -1) for r in rows]
            side = np.concatenate(sides, axis=1)
            p = Places(joined("anchors", np.uint64), side[0], side[1], joined("words", np.uint32).reshape(len(side[0]), 2 * (length - seed)), joined("ids", np.int64), joined("rows", np.int32), joined("places", np.int32))
            bucket = np.repeat([r["bucket"] for r in rows], [s.shape[1] for s in sides])
            late = extended(p)
            found = np.flatnonzero(late.any(1))
            found = found[np.argsort(bucket[found], kind="stable")]
            for a, z in _runs(bucket[found]):
                i = found[a:z]
                out.append((int(bucket[i[0]]), p.doc[i].tobytes(), p.place[i].tobytes(), np.packbits(late[i], axis=1).tobytes()))
        release()
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), *[pa.binary()] * 3))], ["bucket", "rows", "places", "bits"])

    return run


def cut_text(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words marked in ``gone`` and the white space before them."""
    kept, at, words = [], 0, text.split()
    for w, off in zip(words, gone.tolist(), strict=True):
        a = text.index(w, at)
        if not off:
            kept.append(text[at:a] if kept else b"")
            kept.append(w)
        at = a + len(w)
    return b"".join(kept)


def _cut(length: int, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Bucket(left, length, 1, hashed=False)
        # Rows of a bucket are numbered in one order at every time.
        joined = lambda c, kind: np.frombuffer(b"".join(right.column(c).to_pylist()), kind)
        doc, place, wide = joined("rows", np.int32), joined("places", np.int32).astype(np.int64), -(-(length - seed + 1) // 8)
        which, n_left = np.nonzero(np.unpackbits(joined("bits", np.uint8).reshape(-1, wide), axis=1))
        doc, start = doc[which], place[which] - n_left
        order = np.argsort(doc, kind="stable")
        doc, start = doc[order], start[order]
        lo, hi = np.searchsorted(doc, b.first), np.searchsorted(doc, b.first, side="right")
        out_text, removed, joined, spans = [], [], [], []
        for t, n, x, z in zip(b.texts, b.sizes.tolist(), lo.tolist(), hi.tolist(), strict=True):
            own = start[x:z]
            if not len(own):
                out_text.append(t)
                removed.append(0)
                joined.append(b" ".join(t.split()))
                spans.append([])
                continue
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, own, 1)
            np.add.at(change, own + length, -1)
            gone = np.cumsum(change)[:n] > 0
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            words = t.split()
            out_text.append(cut_text(t, gone))
            removed.append(int(gone.sum()))
            joined.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
        release()
        table = b.table.take(pa.array(b.order, pa.int64()))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table([table.column("id"), pa.array(out_text, pa.binary()).cast(pa.string()), table.column("rest"), pa.array(b.sizes), pa.array(removed, pa.int64()), pa.array(joined, pa.binary()).cast(pa.string()), pa.array(spans, span)], ["id", "text", "rest", "n_words", "n_removed", "kept", "spans"])

    return run


#: Buckets grow with the fourth root of the input beyond this size, up to ``MOST_BUCKET_BYTES``.
GROWS_FROM, MOST_BUCKET_BYTES = 4 << 30, 16 << 20
#: Buckets whose places go to one part, on the average.
BUCKETS_A_PART = 4


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, seed: int = 8, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with the text cut, and ``n_words, n_removed, kept`` (words joined by one space) and ``spans`` (maximal repeats, in words).

    Words are runs of other than ASCII white space, unchanged. Windows count as
    the same if the 64-bit hash of their seed is, and the 32-bit hash of each
    other word: 448 bits for 20 words around a seed of 8. A window is a repeat if the same words start earlier: in a smaller id,
    or earlier in the same one. Null and empty texts have no words; texts of any
    length are read whole. Rows that repeat an id count as one document: of equal
    windows at one start none is a repeat of the other. Rows with a null id come
    last, and as one document. A text without repeats stays as it is. An
    empty table stays empty. Columns of ``docs`` with the names of the added
    ones are replaced. Ids must be integers.
    """
    if not 1 <= seed <= length or length - seed > 250:
        raise ValueError("seed must be from 1 to length, and at most 250 words less")
    added = ["n_words", "n_removed", "kept", "spans"]
    docs = docs.drop(*[c for c in added if c not in (id_col, text_col)])
    slim, others = keyed(docs, id_col, text_col)
    size = input_bytes(docs)
    bucket_bytes = max(bucket_bytes, min(MOST_BUCKET_BYTES, int(bucket_bytes * (size / GROWS_FROM) ** 0.25)))
    n = max(1, -(-size // bucket_bytes))
    parts = -(-n // BUCKETS_A_PART)
    # A text of fewer bytes than ``length`` words and the spaces between them has no window.
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < 2 * length - 1
    long = slim.where(~short).withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).select("bucket", "id", "text", "rest")
    own = long.groupBy("bucket")
    seeds = own.applyInArrow(_anchors(length, seed, parts), _HASHES).groupBy("part").applyInArrow(_seeds, "bucket int, data binary, hot binary")
    sent = own.cogroup(seeds.groupBy("bucket")).applyInArrow(_places(length, seed, parts), _SENT)
    repeats = sent.groupBy("part").applyInArrow(_earliest(length, seed), _REPEATS)
    rest = slim.schema["rest"].dataType.simpleString()
    spans = "array<struct<start:int,end:int>>"
    out = own.cogroup(repeats.groupBy("bucket")).applyInArrow(_cut(length, seed), f"id long, text string, rest {rest}, n_words long, n_removed long, kept string, spans {spans}")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda x: x != "")
    bare = slim.where(short).withColumn("words", words).select("id", F.coalesce("text", F.lit("")).alias("text"), "rest", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("words", " ").alias("kept"), F.array().cast(spans).alias("spans"))
    return unkeyed(out.unionByName(bare), docs.columns, id_col, text_col, others, {c: F.col(c) for c in added})
