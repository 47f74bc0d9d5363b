"""Near copies by resemblance: the Jaccard index of two texts' sets of word shingles.

Candidates are the links of the caller's SimHash search, and texts that agree in
all rows of one of ``BANDS`` bands of MinHash values: at resemblance 0.8
fingerprints of 64 bits differ in about ten, which no Hamming ball that can be
enumerated holds, while three in a million pairs of 0.8 share no band. What
meets, over any number of steps, is a candidate group, and in it resemblance is
computed from the whole sets, so nothing below the threshold is linked. All
steps work on distinct sets, so copies count once, and under a key each set is
linked to one other, never all pairs. A large group is compared block by block,
so a task holds two blocks of its texts, which are blocks of shingles, not of
texts. Inside, only sets that share one of their first shingles in the order of
rarity can reach the threshold, so the work follows the pairs that do.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hashes, hot_join, keyed, majority, mixed, release, rolled, sliced, texts, unkeyed, written
from .components import components

BANDS, ROWS = 32, 5
#: Shingles of a candidate group's distinct texts in a block; one text may have more.
BLOCK = 1 << 21
#: A group of many texts that would be one block is dealt to so many, of so many texts at least.
SPREAD, SPREAD_TEXTS = 16, 128
#: Least resemblance that the bands are made for.
LEAST = 0.8
#: Of the table that says which rows' texts are needed.
BITS = 23
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_FACTORS = np.random.default_rng(7).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    words = text.translate(_LOWER).split()
    return np.unique(mixed(rolled(hashes(words), min(shingle, len(words))))) if words else np.zeros(0, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set that is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1 << 10):
        np.minimum(least, (own[at : at + (1 << 10), None] * _FACTORS).min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mixed(key * _FACTORS[0] + row)
    return key


_MARKED = "id long, tie long, fp long, bits long, size long, keys array<long>"


def _marked(shingle: int):
    """Of each row the hash of its set, the SimHash of it, and the keys of the bands where the set is new in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = [shingles(t, shingle) for t in texts(b.column("text"))]
            fp = [xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
            bits = [majority(s) if len(s) else 0 for s in sets]
            first = dict(zip(reversed(fp), range(len(fp) - 1, -1, -1), strict=True))
            keys = [band_keys(s) if len(s) and first[f] == i else np.zeros(0, np.uint64) for i, (s, f) in enumerate(zip(sets, fp, strict=True))]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            columns = [b.column("id"), b.column("tie"), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, bits)], pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "tie", "fp", "bits", "size", "keys"])

    return run


def _marks(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with ``maybe``: false where no row of ``rows`` has its ``tie``.

    By a table of ``1 << BITS`` bits, so what is broadcast has at most 1 MB.
    """
    place = F.shiftrightunsigned("tie", 64 - BITS)
    bits = rows.select(place.alias("at")).distinct().groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    at = place.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, at.bitwiseAND(7))
    joined = df.withColumn("part", F.shiftright(place, 15)).join(F.broadcast(bits), "part", "left")
    return joined.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("part", "bits")


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set the first position that it reaches over links of at least ``threshold``.

    Of two sets that are linked, those shingles that are rarest overall say so: all but
    the last ``threshold`` of each set, in one order for all, have one in common.
    Sets meet under these, and a set is compared with a group only until one of it is linked.
    """
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    element = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    counts = np.bincount(element)
    # Numbers in the order of rarity; those of one set alone meet nothing.
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    alone = int((counts == 1).sum())
    mark = np.zeros(len(counts), bool)
    # Groups by number; the smaller one of two takes the other's.
    name, groups = np.arange(len(sets)), {i: [i] for i in range(len(sets))}

    def join(i: int, j: int) -> None:
        a, b = sorted((int(name[i]), int(name[j])), key=lambda g: len(groups[g]))
        if a != b:
            name[groups[a]] = b
            groups[b] += groups.pop(a)

    def linked(i: int, some: np.ndarray) -> np.ndarray:
        """Those of ``some`` that are linked to the marked set ``i``."""
        some = some[np.minimum(size[some], size[i]) >= threshold * np.maximum(size[some], size[i]) - 1e-9]
        if not len(some):
            return some
        before = np.cumsum(size[some]) - size[some]
        every = np.repeat(ends[some] - size[some] - before, size[some]) + np.arange(int(size[some].sum()))
        shared = np.add.reduceat(mark[element[every]], before, dtype=np.int64)
        return some[shared / (size[i] + size[some] - shared) >= threshold]

    under: dict[int, array] = {}
    tried = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        own = element[ends[i] - size[i] : ends[i]]
        n = int(size[i] - np.ceil(threshold * size[i] - 1e-9)) + 1
        first = np.sort(place[own])[:n]
        first = first[first >= alone].tolist()
        if not first:
            continue
        mark[own] = True
        seen = []
        for e in first:
            if e not in under:
                continue
            there = np.frombuffer(under[e], np.int64)
            new = there[~tried[there] & (name[there] != name[i])]
            del there  # a view keeps its array from growing
            step = 8
            while len(new):
                some, new = new[:step], new[step:]
                tried[some] = True
                seen.append(some)
                for j in linked(i, some).tolist():
                    join(i, j)
                new = new[name[new] != name[i]]
                step = min(1024, 8 * step)
        mark[own] = False
        for some in seen:
            tried[some] = False
        for e in first:
            under.setdefault(e, array("q")).append(i)
    least = {g: min(members) for g, members in groups.items()}
    return np.array([least[g] for g in name.tolist()], np.int64)


def _verified(shingle: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        order = np.argsort(fp)
        bodies = texts(table.column("text"))
        root = alike([shingles(bodies[i], shingle) for i in order], threshold)
        linked = root != np.arange(len(root))
        release()
        return pa.table({"u": pa.array(fp[order][linked]), "v": pa.array(fp[order][root][linked])})

    return run


def slim_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """``id, text, rest, tie`` of each row; ``tie`` is a hash of all but the id."""
    slim, others = keyed(docs, id_col, text_col)
    return slim.withColumn("tie", F.xxhash64("text", "rest")), others


def least_row() -> Column:
    """The row of a group that stays, from ``id, tie``."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("best")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["i"]) & (a["tie"] == b["tie"])


def only(slim: DataFrame, own: DataFrame, best: DataFrame, columns: list[str], id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """The rows of ``slim`` that ``best`` names, each once; ``own (id, tie)`` has a row for each of them.

    Only rows that may go, or are there more than once, are exchanged with their texts.
    """
    kept = best.select(F.col("best.id").alias("i"), F.col("best.tie").alias("tie"))
    rows = own.groupBy("id", "tie").agg(F.count("*").alias("n"))
    gone = rows.join(kept.withColumn("stays", F.lit(True)), _same(rows, kept), "left").where("stays is null or n > 1").select(rows["tie"])
    marked = _marks(slim, gone)
    # Rows alike in all columns fold before the exchange.
    doubt = marked.where("maybe").dropDuplicates(["id", "tie"])
    return unkeyed(marked.where("not maybe").unionByName(doubt.join(kept, _same(doubt, kept), "left_semi")), columns, id_col, text_col, others)


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """``members`` with ``pairs``: which pairs of blocks of its group a set is compared in."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    counted = sizes.select("component", "n", F.least(F.col("n"), F.greatest(F.ceil(F.col("shingles") / block), F.least(F.lit(SPREAD), F.ceil(F.col("n") / SPREAD_TEXTS)))).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    return hot_join(members, counted, "component").withColumn("pairs", F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda y: F.struct(F.least(own, y).alias("a"), F.greatest(own, y).alias("b")))).drop("k", "size")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, search: Callable[[DataFrame], DataFrame] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group that links of resemblance ``threshold`` or more connect.

    ``search`` gives links ``u, v`` between SimHash fingerprints ``(fp)``; without it
    bands alone make candidates. The row with the least id stays (null behind all), then the one with the least
    hash of all its columns; rows decide, so an id that has several texts keeps
    those that are in groups of their own. Null texts count as empty, and texts
    without words are one group; texts of any length are read whole. The bands
    are made for thresholds from 0.8 on; a lower one is refused. An empty table
    stays empty. ``block``: shingles of a group that are compared with those of
    another block in one task.
    """
    if not LEAST <= threshold <= 1:
        raise ValueError(f"the threshold must be from {LEAST} to 1")
    scratch = Scratch(docs.sparkSession)
    slim, others = slim_of(docs, id_col, text_col)
    own = scratch.written(slim.select("id", "text", "tie").mapInArrow(_marked(shingle), _MARKED), "shingles")
    # A row for each distinct set: it is named by its least row, of which the text is read.
    sets = scratch.written(own.groupBy("fp").agg(least_row(), F.min("bits").alias("bits"), F.min("size").alias("size")), "sets")
    keys = own.select("fp", F.explode("keys").alias("key"))
    least = keys.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("most"), F.count("*").alias("n")).where("v < most").select("key", "v", "n")
    met = hot_join(keys, least, "key").select(F.col("fp").alias("u"), "v")
    if search is not None:
        # SimHash links, each between the least sets of two fingerprints, and of the sets of one fingerprint.
        prints = scratch.written(sets.groupBy("bits").agg(F.min("fp").alias("v"), F.count("*").alias("n")), "prints")
        equal = hot_join(sets.select(F.col("fp").alias("u"), "bits"), prints, "bits").select("u", "v")
        near = search(prints.select(F.col("bits").alias("fp"))).withColumnsRenamed({"u": "x", "v": "y"})
        end = lambda c, name: prints.select(F.col("bits").alias(c), F.col("v").alias(name))
        met = met.union(equal).union(near.join(end("x", "u"), "x").join(end("y", "v"), "y").select("u", "v"))
    met = components(met.where("u <> v"), scratch=scratch)
    members = scratch.written(sets.join(met.select(F.col("node").alias("fp"), "component"), "fp").select("fp", "component", "size", F.col("best.id").alias("i"), F.col("best.tie").alias("tie")), "members")
    members = scratch.written(_blocks(members, block), "blocks")
    asked = _marks(slim, members).where("maybe").select("id", "tie", "text")
    bodies = asked.join(members, _same(asked, members)).select("component", "fp", "pairs", "text").dropDuplicates(["component", "fp"])
    found = bodies.withColumn("pair", F.explode("pairs")).groupBy("component", "pair").applyInArrow(_verified(shingle, threshold), "u long, v long")
    linked = components(found, scratch=scratch)
    root = sets.join(linked.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "best.id", "best.tie")
    best = root.groupBy("root").agg(least_row()).select("best")
    best, _ = written(best, "best")
    rows, _ = written(own.select("id", "tie"), "rows")
    scratch.clear()
    return only(slim, rows, best, docs.columns, id_col, text_col, others)
