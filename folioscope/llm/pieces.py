"""SentencePiece ids and back: exact merge-type encoding by backtracking.

A merge-type model joins the adjacent pair of greatest score, the leftmost of
equals, until none is left. Its result is the only sequence of pieces that spells
the text and in which every two neighbours are compatible: merging the text of
these two alone gives these two again. So pieces are placed from left to right.
An Aho-Corasick automaton over the pieces says the longest one at each place; a
piece that does not go with the one before is replaced by the next shorter one,
and where none fits, the piece before is taken back and the place is marked in a
bitfield, so that no place is tried twice.

No piece goes over the end of a word (a space opens a piece or stands between
spaces), so words are encoded one by one and a worker remembers the frequent ones.
Those of a slice of rows that it does not know are merged together, each by its own
best pair in every step; long words and foreign characters are placed as above.
"""

from __future__ import annotations

import re
import sys
from array import array
from codecs import register_error
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, sliced, unkeyed

SPACE = "▁"
#: Fixed values of the public model format: kinds of pieces, and the kind of models that merge.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
#: Bytes that a worker's memory of words may take, two generations together, and the longest word in it.
KNOWN_BYTES = 160 << 20
LONGEST = 64
#: Words that are merged together.
MERGED = 1 << 14
#: Stands for a line break before a word; no character.
BREAK = "\uffff"
#: Pairs of neighbours that a worker remembers.
PAIRS = 300_000


class Memory:
    """Values by string, in two generations that together hold a bounded number of bytes."""

    def __init__(self, limit: int = KNOWN_BYTES, longest: int = LONGEST):
        self.new, self.old, self.size, self.limit, self.longest = {}, {}, 0, limit // 2, longest

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) > self.longest:
            return
        # 120 bytes are more than an entry takes in a dictionary that grows.
        self.size += sys.getsizeof(key) + sys.getsizeof(value) + 120
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value

    def put_all(self, keys: list[str], values: list[bytes], step: int = 4096) -> None:
        """:meth:`put` of many, of which none is too long."""
        for at in range(0, len(keys), step):
            some = dict(zip(keys[at : at + step], values[at : at + step], strict=True))
            self.size += sum(map(sys.getsizeof, some)) + sum(map(sys.getsizeof, some.values())) + 120 * len(some)
            if self.size > self.limit:
                self.old, self.new, self.size = self.new, {}, 0
            self.new.update(some)


class Surfaces:
    """What the pieces of a model file say: enough to decode."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as public

        model = public.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != MERGES or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces) or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} is no merge-type model with plain normalisation")
        self.names = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        self.end = self.names.index(model.trainer_spec.eos_piece)
        if self.byte and len(self.byte) != 256:
            raise ValueError(f"{path} has some pieces for bytes, but not all")
        self.surface = [n.replace(SPACE, " ").encode() for n in self.names]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.odd = {i for i, k in enumerate(self.kind) if k in (CONTROL, UNKNOWN)}
        for i in self.odd:
            self.surface[i] = model.trainer_spec.unk_surface.encode() if i == self.unknown else b""

    def decode(self, ids: list[int]) -> str:
        """The text of ids: what the library's own decoding gives, invalid bytes as U+FFFD each."""
        while ids and self.kind[ids[-1]] == CONTROL:
            ids = ids[:-1]
        start = next((k for k, i in enumerate(ids) if self.kind[i] != CONTROL), 0)
        if not self.odd.isdisjoint(ids[start:]):
            return "".join(self._decoded(run, first) for run, first in self._runs(ids[start:]))
        return self._decoded(ids[start:], True)

    def _runs(self, ids: list[int]) -> Iterator[tuple[list[int], bool]]:
        """Cut at control pieces and unknown ones: bytes on their two sides are apart."""
        at = 0
        for k, i in enumerate(ids):
            if i in self.odd:
                yield ids[at:k], at == 0
                yield [i], False
                at = k + 1
        yield ids[at:], at == 0

    def _decoded(self, ids: list[int], first: bool) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        if first and ids and self.kind[ids[0]] == NORMAL and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "folioscope.bytes")


class Pieces(Surfaces):
    """A merge-type model, read from its file, that encodes."""

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        import ahocorasick

        super().__init__(path)
        self.id = {n: i for i, (n, k) in enumerate(zip(self.names, self.kind, strict=True)) if k == NORMAL}
        self._rules()
        self.length = {i: len(p) for p, i in self.usable.items()}
        self.shorter = {i: next((self.usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.usable), None) for p, i in self.usable.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.foreign = re.compile("[^" + "".join(map(re.escape, sorted({c for p in self.id for c in p}))) + "]+")
        # No piece has a space behind another character, so none goes over the end of a word.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        self.pairs: dict[int, bool] = {}
        self.words, self.lines = Memory(known_bytes), Memory(known_bytes // 4)
        self.line = self._part("\n")
        self.simple = self.cuts and self.foreign.fullmatch("\n" + BREAK) is not None
        self._table()

    def _table(self) -> None:
        """Ids of characters, and all pairs that merge, in order: their rank (the greatest score is 0) and what they make."""
        self.characters = np.full(sys.maxunicode + 1, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.characters[ord(p)] = i
        if self.simple:
            self.characters[ord(BREAK)] = np.frombuffer(self.line, np.int32)[0]
        pairs = np.fromiter(self.merges, np.int64, len(self.merges))
        made = np.fromiter((self.id[self.names[k >> 32] + self.names[k & 0xFFFFFFFF]] for k in self.merges), np.int64, len(pairs))
        rank = np.unique(-np.fromiter(self.merges.values(), float, len(pairs)), return_inverse=True)[1]
        order = np.argsort(pairs)
        # The last one is equal to no pair.
        self.pair_keys = np.r_[pairs[order], np.iinfo(np.int64).max]
        self.pair_made = np.r_[made[order], 0]
        self.pair_rank = np.r_[rank[order], 0]

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a short text of known characters."""
        out, score = list(text), self.score.get
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What the last merge of a piece joins; None for one that its own text does not merge to."""
        out, score = list(piece), self.score.get
        while len(out) > 2:
            found = [(score(out[i] + out[i + 1]), -i) for i in range(len(out) - 1) if out[i] + out[i + 1] in self.score]
            if not found:
                return None
            at = -max(found)[1]
            out[at : at + 2] = [out[at] + out[at + 1]]
        return tuple(out)

    def _rules(self) -> None:
        """The pieces that occur, the two that each was merged of, and all pairs that merge."""
        halves = {p: self._halves(p) for p in self.id if len(p) > 1}
        self.usable = {p: i for p, i in self.id.items() if len(p) == 1 or halves[p]}
        self.size = size = len(self.names)
        self.at, self.left, self.right = [float("inf")] * size, [0] * size, [0] * size
        for p, h in halves.items():
            if h:
                i = self.id[p]
                self.at[i], self.left[i], self.right[i] = self.score[p], self.id[h[0]], self.id[h[1]]
        self.merges = {self.id[p[:k]] << 32 | self.id[p[k:]]: self.score[p] for p in self.id for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        # Where pieces are made later than their halves, the last merges can be undone one by one.
        self.ordered = all(min(self.at[self.left[i]], self.at[self.right[i]]) >= self.at[i] for p, i in self.usable.items() if len(p) > 1)
        ties = Counter(s for p, s in self.score.items() if len(p) > 1)
        self.tied = {i for p, i in self.usable.items() if len(p) > 1 and ties[self.score[p]] > 1}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both pieces gives both again.

        The merges of both are taken back, the latest first. The pair on the
        border must at no time be one that would have merged before the merge just
        taken back. Among equal scores the left one goes first.
        """
        if not self.ordered or a in self.tied or b in self.tied:
            x, y = self.names[a], self.names[b]
            return self.merged(x + y) == [x, y]
        merges, made, done, left = self.merges.get, self.at, -float("inf"), False
        while True:
            s = merges(a << 32 | b)
            if s is not None and (s > done or left and s == done):
                return False
            x, y = made[a], made[b]
            if x < y:
                a, done, left = self.right[a], x, False
            elif y < float("inf"):
                b, done, left = self.left[b], y, True
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """:meth:`compatible`, remembered for recent pairs."""
        pairs, key = self.pairs, a * self.size + b
        found = pairs.get(key)
        if found is None:
            found = self.compatible(a, b)
            if len(pairs) >= PAIRS:
                pairs.clear()
            pairs[key] = found
        return found

    def placed(self, text: str) -> list[int]:
        """The ids of a text of known characters, by backtracking."""
        whole = self.usable.get(text)
        if whole is not None:
            return [whole]
        # Longest pieces one behind the other, as far as they go together: nearly half of all words end here.
        first, fits = self.automaton.iter_long, self.fits
        out: list[int] = []
        last, at, n, length = -1, 0, len(text), self.length
        for _, piece in first(text):
            if last >= 0 and not fits(last, piece):
                break
            out.append(piece)
            at += length[piece]
            last = piece
        else:
            return out
        failed = bytearray(n // 8 + 1)
        shorter = self.shorter
        while at < n:
            end = at + length[piece]
            if not failed[end >> 3] & 1 << (end & 7) and (not out or fits(last, piece)):
                out.append(piece)
                at, last = end, piece
                if at < n:
                    piece = next(first(text, at))[1]
                continue
            piece = shorter[piece]
            while piece is None:
                # Nothing fits here behind what is before it.
                failed[at >> 3] |= 1 << (at & 7)
                gone = out.pop()
                at -= length[gone]
                last, piece = out[-1] if out else -1, shorter[gone]
        return out

    def _part(self, part: str) -> bytes:
        """Ids of a part of a word: known characters are placed, runs of others are spelt in bytes."""
        if not self.foreign.search(part):
            return array("i", self.placed(part)).tobytes()
        out: list[int] = []
        at = 0
        for m in self.foreign.finditer(part):
            out += self.placed(part[at : m.start()])
            out += [self.byte[b] for b in m[0].encode()] if self.byte else [self.unknown]
            at = m.end()
        return array("i", out + self.placed(part[at:])).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word with a space in front of it; ``word`` itself may begin with more spaces."""
        found = self.words.get(word)
        if found is None:
            if "\n" in word:
                # A line break has no piece of its own, so nothing is merged over it.
                first, *rest = word.split("\n")
                found = self._word(first) + b"".join(self.line + self._line(x) for x in rest)
            else:
                found = self._part(SPACE + word.replace(" ", SPACE))
            self.words.put(word, found)
        return found

    def _line(self, part: str) -> bytes:
        found = self.lines.get(part)
        if found is None:
            found = self._part(part)
            self.lines.put(part, found)
        return found

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of short words, those behind a line break with ``BREAK`` for it: each step merges the best pair of every word."""
        parts = [w if w[:1] == BREAK else SPACE + w for w in words]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = self.characters[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")].astype(np.int64)
        known = np.minimum.reduceat(ids, np.cumsum(size) - size) >= 0
        part = np.repeat(np.arange(len(parts)), size)
        ids, part = ids[known[part]], part[known[part]]
        none = len(self.pair_keys) << 32

        def looked_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = a << 32 | b
            at = np.searchsorted(self.pair_keys, key)
            return np.where(self.pair_keys[at] == key, self.pair_rank[at] << 32, none), self.pair_made[at]

        done_part, done_ids = [], []
        # best: of each id with the next one of its part.
        best, made = np.full(len(ids), none), np.zeros(len(ids), np.int64)
        inner = np.flatnonzero(part[1:] == part[:-1])
        best[inner], made[inner] = looked_up(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            least = np.minimum.reduceat(best + np.arange(len(ids)), starts)
            going = least < none
            if not going.all():
                stays = np.repeat(going, np.diff(np.r_[starts, len(ids)]))
                done_part.append(part[~stays])
                done_ids.append(ids[~stays])
                before = np.cumsum(~stays)
                least = least[going]
                at = least & 0xFFFFFFFF
                at -= before[at]
                ids, part, best, made = ids[stays], part[stays], best[stays], made[stays]
            else:
                at = least & 0xFFFFFFFF
            if not len(at):
                break
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, part, best, made = ids[keep], part[keep], best[keep], made[keep]
            at -= np.arange(len(at))
            # Only the pairs on the two sides of what was merged are new.
            best[at] = none
            right = at[at + 1 < len(ids)]
            right = right[part[right] == part[right + 1]]
            left = at[at > 0] - 1
            left = left[part[left] == part[left + 1]]
            new = np.concatenate([left, right])
            best[new], made[new] = looked_up(ids[new], ids[new + 1])
        out: list[bytes] = [b""] * len(parts)
        if done_part:
            part = np.concatenate(done_part)
            order = np.argsort(part, kind="stable")
            data, ends = np.concatenate(done_ids)[order].astype("<i4").tobytes(), np.cumsum(np.bincount(part, minlength=len(parts)) * 4).tolist()
            out = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in np.flatnonzero(~known).tolist():
            out[i] = self._alone(words[i])
        return out

    def _alone(self, word: str) -> bytes:
        return self.line + self._part(word[1:]) if word[:1] == BREAK else self._part(SPACE + word)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words; those that are not remembered are merged together."""
        out = list(map(self.words.new.get, words))
        unknown = [i for i, x in enumerate(out) if x is None]
        found = list(map(self.words.old.get, [words[i] for i in unknown]))
        missing = [i for i, x in zip(unknown, found, strict=True) if x is None]
        short = [i for i in missing if len(words[i]) <= self.words.longest]
        if len(short) < len(missing):
            for i in missing:
                if len(words[i]) > self.words.longest:
                    out[i] = self._alone(words[i])
        again = [(words[i], x) for i, x in zip(unknown, found, strict=True) if x is not None]
        for i, x in zip(unknown, found, strict=True):
            if x is not None:
                out[i] = x
        self.words.put_all([w for w, _ in again], [x for _, x in again])
        for at in range(0, len(short), MERGED):
            some = short[at : at + MERGED]
            keys = [words[i] for i in some]
            values = self._together(keys)
            for i, x in zip(some, values, strict=True):
                out[i] = x
            self.words.put_all(keys, values)
        return out

    def encode_all(self, texts: pa.Array, last: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """:meth:`encode` of each text, null ones empty, with ``last`` behind it: where each begins and ends, and the ids of all.

        Texts are cut into words in Arrow, and what follows goes by different words.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        text = pc.replace_substring(texts, SPACE, " ")
        odd = pc.equal(text, "")
        for p in ("  ", BREAK):
            odd = pc.or_(odd, pc.match_substring(text, p))
        odd = pc.or_(odd, pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")))
        if not self.simple:
            odd = pc.equal(text, text)
        lists = pc.split_pattern(pc.if_else(odd, None, pc.replace_substring(text, "\n", " " + BREAK)), " ")
        words = lists.flatten().dictionary_encode()
        # Behind the words of a plain text stands the last id; one of an odd text is its only word.
        ids = [*self._ids(words.dictionary.to_pylist()), last]
        order, at, put = words.indices.to_numpy(), np.cumsum(lists.value_lengths().fill_null(0).to_numpy()), []
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            put.append((i, at[i], len(ids)))
            ids.append(self.encode(texts[i].as_py()))
        behind = len(words.dictionary)
        put = np.array(sorted([*put, *zip(range(len(at)), at, [behind] * len(at), strict=True)], key=lambda x: (x[0], x[2] == behind)), np.int64).reshape(-1, 3)
        order = np.insert(order, put[:, 1], put[:, 2])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, starts, each = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(size) - size, size[order]
        ends = np.cumsum(each)
        closed = ends[order == behind]
        return np.r_[0, closed], values[np.repeat(starts[order] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        text = text.replace(SPACE, " ")
        if not self.cuts or "\n" in self.id or BREAK in text:
            return self._part(SPACE + text.replace(" ", SPACE))
        words = text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        got = list(map(self.words.new.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self._word(words[i])
        return b"".join(got)


register_error("folioscope.bytes", lambda e: ("�", e.start + 1))


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """The worker's own model of a file."""
    return Pieces(path)


@lru_cache(2)
def surfaces(path: str) -> Surfaces:
    return Surfaces(path)


def _encodes(path: str, end: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        last = np.array([model.end] if end else [], "<i4").tobytes()
        for b in sliced(batches, 512, give_back=False):
            offsets, values = model.encode_all(b.column("text"), last)
            ids = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *([b.column("text")] if keep_text else []), b.column("rest"), ids], ["id", *(["text"] if keep_text else []), "rest", "ids"])

    return run


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the pieces of each whole text by the model file ``model``.

    ``end`` adds the end id. Null and empty texts have no other id. Rows are
    encoded where they are, each one as a whole, repeated rows alike; memory is one
    text and its ids beside the worker's bounded memory of words. An empty table
    stays empty. A column of ``docs`` named ``ids`` is replaced; with
    ``keep_text=False`` the text is not returned. Ids of documents must be integers or null.
    """
    docs = docs.drop("ids")
    slim, others = keyed(docs, id_col, text_col)
    rest = slim.schema["rest"].dataType.simpleString()
    out = slim.mapInArrow(_encodes(model, end, keep_text), f"id long, {'text string, ' if keep_text else ''}rest {rest}, ids array<int>")
    return unkeyed(out, [c for c in docs.columns if keep_text or c != text_col], id_col, text_col, others, {"ids": F.col("ids")})


def _decodes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = surfaces(path)
        for b in sliced(batches, 256, give_back=False):
            ids = b.column("ids")
            values, at = ids.flatten().to_pylist(), [0, *np.cumsum([x or 0 for x in ids.value_lengths().to_pylist()]).tolist()]
            texts = [model.decode([x for x in values[a:z] if x is not None]) for a, z in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("row"), ids, pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    return run


def decoded(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids: control ids say nothing, bytes that are no UTF-8 are U+FFFD.

    Null ids and a null list count as none and give an empty text. An id that the
    model does not have is an error. A column of ``df`` named ``decoded`` is replaced.
    """
    df = df.drop("decoded")
    others = [c for c in df.columns if c != ids_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(None).cast("int").alias("none"))
    slim = df.select(row.alias("row"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    out = slim.mapInArrow(_decodes(model), f"row {slim.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.select(*[(F.col("ids") if c == ids_col else F.col(f"row.c{others.index(c)}")).alias(c) for c in df.columns], "decoded")
