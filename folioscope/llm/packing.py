"""Packing by vector bin packing with the dot-product heuristic.

An example demands tokens, one segment, and loss-bearing tokens. A sequence is
filled with the example whose demands have the largest weighted dot product with
what the sequence has left (Panigrahy et al., "Heuristics for vector bin
packing", 2011), among those that fit in every dimension. If none fits and cuts
are allowed, the best one is cut to what is left.

Each task tokenizes and packs what it reads, block by block, and hands on what
did not fill a sequence; these rests, less than a sequence for each task, are
written with the pieces and packed together afterwards in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, sliced, written
from .tokens import encoder


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most; with as many segments as tokens these bind nothing."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


#: Examples that are open for packing at once.
BLOCK = 2048
#: Parts of texts that a worker remembers in a generation; there is room for more than where texts are sorted too.
KNOWN = 700_000
#: Bytes of ids that are open for packing at once.
HELD = 8 << 20
#: Tasks whose rests are packed together.
GROUP = 256


def pack(tokens: np.ndarray, prompt: np.ndarray, limits: Limits, cuts: bool, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of (example, start, length), and the pieces of a sequence not filled if it is not the ``last`` call.

    tokens: of each example, at least 1. prompt: how many of its first tokens
    bear no loss. Without cuts an example beyond a limit of its own raises.
    """
    n = len(tokens)
    start, left = np.zeros(n, np.int64), tokens.astype(np.int64)
    loss = lambda i, s, m: np.maximum(0, s + m - np.maximum(s, prompt[i]))
    sequences: list[list[tuple[int, int, int]]] = []
    if cuts:
        # Whole sequences of one long example, without loss beyond the limit.
        for i in np.flatnonzero(left >= limits.tokens):
            while left[i] >= limits.tokens and loss(i, start[i], limits.tokens) <= limits.loss:
                sequences.append([(int(i), int(start[i]), limits.tokens)])
                start[i] += limits.tokens
                left[i] -= limits.tokens
    elif n and ((left > limits.tokens) | (loss(np.arange(n), start, left) > limits.loss)).any():
        raise ValueError("an example is beyond the limits and cuts are not allowed")
    open_ = np.flatnonzero(left > 0)
    weight = 1 / np.array([limits.tokens, limits.segments, limits.loss], float) ** 2
    while len(open_):
        room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        pieces: list[tuple[int, int, int]] = []
        while len(open_) and room[0] and room[1]:
            need = left[open_]
            bears = loss(open_, start[open_], need)
            value = weight[0] * room[0] * need + weight[1] * room[1] + weight[2] * room[2] * bears
            fits = (need <= room[0]) & (bears <= room[2])
            if fits.any():
                at = int(np.argmax(np.where(fits, value, -1)))
                i = int(open_[at])
                take = int(need[at])
            elif cuts:
                # Of what fits in no way whole, as much as the room allows.
                free = np.maximum(0, prompt[open_] - start[open_])
                most = np.minimum(np.minimum(need, room[0]), free + room[2])
                at = int(np.argmax(most))
                i, take = int(open_[at]), int(most[at])
                if take <= 0:
                    break
            else:
                break
            bears = int(loss(i, start[i], take))
            pieces.append((i, int(start[i]), take))
            start[i] += take
            left[i] -= take
            room -= (take, 1, bears)
            if not left[i]:
                open_ = np.delete(open_, at)
        sequences.append(pieces)
        if not len(open_) and room[0] and not last:
            return sequences[:-1], sequences[-1]
    return sequences, []


def _first(vocabulary: str, end_id: int, limits: Limits, cuts: bool, block: int, known: int, special: bool):
    names = ["id", "start", "length", "doc_tokens", "prompt", "sequence_id", "offset", "task", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary, known, special)
        tail = np.array([end_id], "<u4").tobytes()
        # Open examples: (id, ids from ``base`` on, base, tokens of the document, tokens without loss).
        waiting: list[tuple] = []

        def rows_of(examples, sequences, rest):
            nonlocal number
            out = []
            for s in sequences:
                offset = 0
                for i, start, length in s:
                    id_, data, base, total, prompt = examples[i]
                    out.append((id_, base + start, length, total, prompt, (task << 32) | number, offset, task, data[4 * start : 4 * (start + length)]))
                    offset += length
                number += 1
            for i, start, length in rest:
                id_, data, base, total, prompt = examples[i]
                out.append((id_, base + start, length, total, prompt, None, None, task, data[4 * start : 4 * (start + length)]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def close(last: bool):
            nonlocal waiting
            tokens = np.array([len(w[1]) // 4 for w in waiting], np.int64)
            prompt = np.array([max(0, w[4] - w[2]) for w in waiting], np.int64)
            sequences, rest = pack(tokens, prompt, limits, cuts, False)
            if last:
                batch = rows_of(waiting, sequences, rest)
                waiting = []
            else:
                batch = rows_of(waiting, sequences, [])
                # What did not fill a sequence waits for the next block, as examples that start where it starts.
                waiting = [(w[0], w[1][4 * s : 4 * (s + m)], w[2] + s, w[3], w[4]) for i, s, m in rest for w in [waiting[i]]]
            return batch

        held = 0
        for b in sliced(batches, 512, give_back=False):
            encoded = enc.encode_all([t or "" for t in b.column("text").to_pylist()])
            for id_, data, p in zip(b.column("id").to_pylist(), encoded, b.column("prompt").to_pylist(), strict=True):
                data += tail
                waiting.append((id_, data, 0, len(data) // 4, p or 0))
                held += len(data)
                if len(waiting) >= block or held > HELD:
                    yield close(False)
                    held = sum(len(w[1]) for w in waiting)
        if waiting:
            yield close(True)

    return run


_PIECES = "id long, start long, length long, doc_tokens long, prompt long, sequence_id long, offset long, task int, ids binary"


def _second(limits: Limits, cuts: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["task"], r["id"] is None, r["id"], r["start"], r["doc_tokens"], r["ids"]))
        prompt = np.array([max(0, r["prompt"] - r["start"]) for r in rows], np.int64)
        sequences, _ = pack(np.array([r["length"] for r in rows], np.int64), prompt, limits, cuts, True)
        base, out = (1 << 60) | (table.column("group")[0].as_py() << 32), []
        for k, s in enumerate(sequences):
            offset = 0
            for i, start, length in s:
                r = rows[i]
                out.append(r | {"start": r["start"] + start, "length": length, "ids": r["ids"][4 * start : 4 * (start + length)], "sequence_id": base + k, "offset": offset})
                offset += length
        return pa.table({c: pa.array([r[c] for r in out], table.schema.field(c).type) for c in table.column_names if c not in ("group", "task")})

    return run


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, end_id: int = 1, limits: Limits = Limits(), cuts: bool = False, block: int = BLOCK, known: int = KNOWN, special: bool = False) -> DataFrame:
    """A row for each piece: ``id_col, start, length, crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's token ids as little-endian 32-bit integers, of which
    ``crc32`` is the checksum: a sequence is its pieces' ids by ``offset``.

    A document is the ids of its text and ``end_id``; ``prompt_col`` says how
    many of its first tokens bear no loss (none: all bear it). Every id is in
    one piece. No sequence has more than ``limits`` in tokens, pieces or
    loss-bearing tokens. Without ``cuts`` (for instruction data) examples stay
    whole, and one beyond a limit of its own fails the job, so filter those
    before. Null texts count as empty and give the end id alone, a null id is
    kept, repeated rows are packed each, an empty table gives no piece. Other
    columns are not read; texts of any length are encoded whole. ``special``: strings of
    special tokens in a text give these tokens, else they are ordinary text.
    ``known`` is how many parts of texts a worker remembers (:mod:`tokens`), for
    speed alone. Sequence ids are unique, not gapless; which documents meet
    depends on the partitions of the input. Ids must be integers.
    """
    prompt = F.lit(0).cast("long") if prompt_col is None else F.greatest(F.lit(0), F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)))
    slim = keyed(docs.select(id_col, text_col, prompt.alias("_prompt")), id_col, text_col)[0].select("id", "text", F.col("rest.c0").alias("prompt"))
    pieces, _ = written(slim.mapInArrow(_first(vocabulary, end_id, limits, cuts, block, known, special), _PIECES), "pieces")
    done = pieces.where("sequence_id is not null").drop("task")
    rest = pieces.where("sequence_id is null").withColumn("group", F.floor(F.col("task") / GROUP).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema)
    out = done.unionByName(rest.groupBy("group").applyInArrow(_second(limits, cuts), schema))
    return out.select(F.col("id").alias(id_col), "start", "length", F.crc32("ids").alias("crc32"), "doc_tokens", "sequence_id", "offset", "ids")
