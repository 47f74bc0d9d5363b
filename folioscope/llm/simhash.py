"""SimHash near-duplicates by multi-index hashing.

Fingerprints that differ in at most ``distance`` of 64 bits agree, in at least
one of ``segments`` segments, up to floor(distance / segments) bits (Norouzi et
al., "Fast exact search in Hamming space with multi-index hashing", 2014). Each
distinct fingerprint goes into one table for each segment under its own value
and asks under the values of the small ball around it; what meets under a value
is verified on all 64 bits. All steps work on distinct fingerprints, so a group
of copies counts once, and a group of near copies has at most as many members
as the Hamming ball. How many segments there are follows from the number of
fingerprints, so that few strangers meet under a value; the links do not depend
on it. A value's members give a spanning forest of their links, never all
pairs. Fingerprints and links stay in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import Scratch, hot_join, keyed, majority, sliced, texts, written
from .components import components

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(whole, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    h = np.fromiter([digest(whole[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, n - shingle + 1)
    return majority(h)


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fp = np.fromiter((fingerprint(t, shingle, seed) for t in texts(b.column("text"))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id, fp`` (the 64 bits as a long) for each row; null or empty texts have 0."""
    slim, _ = keyed(docs.select(id_col, text_col), id_col, text_col)
    return slim.select("id", "text").mapInArrow(_fingerprints(shingle, seed), "id long, fp long")


def ball(width: int, radius: int) -> list[int]:
    """The masks of up to ``radius`` of ``width`` bits, 0 first."""
    return [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def spans(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segments_for(n: int, distance: int) -> int:
    """The number of segments that is cheapest for ``n`` fingerprints.

    A key costs its exchange; a comparison with what meets under it, about a
    hundredth of that.
    """

    def cost(segments: int) -> float:
        width = 64 // segments
        masks = len(ball(width, distance // segments))
        return segments * (1 + masks) / 2 * (1 + n * masks / 2**width / 100)

    return min(range(2, max(3, distance + 2)), key=cost)


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what ``distance`` connects, as positions: at most len(fp) - 1.

    Each member that is reached is compared with those not yet reached only, so a
    dense group costs few passes.
    """
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
            if near.any():
                found = left[near]
                out += [(int(at), int(x)) for x in found]
                queue += found.tolist()
                left = left[~near]
    return out


def _pairs(own: np.ndarray, distance: int) -> np.ndarray:
    """Positions of links that connect what ``distance`` connects, a row for each."""
    if len(own) <= 256:
        u, v = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= distance, 1))
        if len(u) <= 4 * len(own):
            return np.c_[u, v]
    return np.array(forest(own, distance), np.int64).reshape(-1, 2)


def _links(distance: int):
    def of(run: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links within the runs of equal ``run`` values."""
        cut = np.flatnonzero(run[1:] != run[:-1]) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(run)]
        size = ends - starts
        u, v = [], []
        two = starts[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        u.append(fp[near])
        v.append(fp[near + 1])
        for a, b in zip(starts[size > 2], ends[size > 2], strict=True):
            own = np.unique(fp[a:b])
            pairs = _pairs(own, distance)
            u.append(own[pairs[:, 0]])
            v.append(own[pairs[:, 1]])
        return np.concatenate(u), np.concatenate(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last key of a batch may go on in the next one."""
        keys, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

        def close(upto: int | None) -> Iterator[pa.RecordBatch]:
            """Links of all rows but those behind ``upto`` of the last batch, which stay."""
            last_key, last_fp = keys[-1], fps[-1]
            keys[-1], fps[-1] = last_key[:upto], last_fp[:upto]
            key, fp = np.concatenate(keys), np.concatenate(fps)
            keys[:], fps[:] = ([last_key[upto:]], [last_fp[upto:]]) if upto is not None else ([], [])
            if len(key) > 1:
                u, v = of(key, fp)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            if b.num_rows:
                keys.append(b.column("key").to_numpy())
                fps.append(b.column("fp").to_numpy().view(np.uint64))
                if at := int(np.searchsorted(keys[-1], keys[-1][-1])):
                    yield from close(at)
        yield from close(None)

    return run


def _keys(distance: int, segments: int):
    cuts = spans(segments)
    plans = [(j, low, width, np.array([m for m in ball(width, distance // segments)], np.uint64)) for j, (low, width) in enumerate(cuts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 12):
                fp = b.column("fp").to_numpy()[at : at + (1 << 12)].view(np.uint64)
                for j, low, width, masks in plans:
                    own = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    keys = own[:, None] ^ masks[None, :]
                    # Of two values that differ the smaller one asks, so a pair meets under the larger.
                    ask = keys >= own[:, None]
                    key = keys[ask] * np.uint64(segments) + np.uint64(j)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, ask.sum(1)).view(np.int64))], ["key", "fp"])

    return run


#: Keys of 16 bytes in a partition of the exchange.
PART_KEYS = 4 << 20


def links(distinct: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """Links ``u, v`` between the fingerprints of ``distinct (fp)`` that connect all those within ``distance``."""
    n = distinct.count()
    segments = segments or segments_for(n, distance)
    each = sum(1 + len(ball(width, distance // segments)) for _, width in spans(segments)) / 2
    keys = distinct.select("fp").mapInArrow(_keys(distance, segments), "key long, fp long")
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n * each / PART_KEYS))
    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links(distance), "u long, v long").distinct()


def _groups(own: DataFrame, scratch: Scratch, distance: int, segments: int | None) -> DataFrame:
    """``fp, least, n, root`` of each fingerprint in ``own (id, fp)``: its least id, its rows, and the name of its component."""
    distinct = scratch.written(own.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct, distance, segments), scratch=scratch)
    return scratch.written(distinct.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """``id, fp, component`` for each row: the least id that it reaches over fingerprints within ``distance``.

    Rows with a null id link like others but lend no name; a component of such
    rows alone has a null one. Repeated rows keep their number. Null texts count
    as empty, and texts without words all have fingerprint 0; texts of any length
    are read whole. An empty table gives an empty result. Other columns are not
    read. ``segments``: chosen by :func:`segments_for` if not given.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    named = _groups(own, scratch, distance, segments)
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("m"))
    by_fp = scratch.written(hot_join(named.select("fp", "n", "root"), names, "root", "m").select("fp", "n", "component"), "names")
    return scratch.result(hot_join(own, by_fp, "fp").select("id", "fp", "component"), "near")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, segments: int | None = None, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    A group is what links connect: fingerprints within ``distance``; with a
    ``similarity``, pairs with at least that Jaccard index of their distinct
    shingles (:mod:`resemblance`), verified on the whole sets. The row with the
    least id stays (null behind all), then the one with the least hash of all its
    columns. Rows decide, so an id that has several texts keeps those that are
    in groups of their own.
    """
    if similarity is not None:
        return resemblance.representatives(docs, id_col, text_col, shingle, similarity, lambda sets: links(sets, distance, segments))
    scratch = Scratch(docs.sparkSession)
    slim, others = resemblance.slim_of(docs, id_col, text_col)
    prints = slim.select("text", F.struct("id", "tie").alias("id")).mapInArrow(_fingerprints(shingle, 42), "id struct<id:long,tie:long>, fp long")
    own = scratch.written(prints.select("id.id", "id.tie", "fp"), "fingerprints")
    named = _groups(own, scratch, distance, segments)
    best, _ = written(hot_join(own, named.select("fp", "n", "root"), "fp").groupBy("root").agg(resemblance.least_row()), "best")
    scratch.paths.pop(0)  # own is read by the result
    scratch.clear()
    return resemblance.only(slim, own, best, docs.columns, id_col, text_col, others)
