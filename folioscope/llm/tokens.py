"""Token ids of whole texts, by a vocabulary file of the tokenizers library.

A byte-level pre-tokenizer starts a new piece at every space before other than
white space, so a text may be cut there and its parts encoded one by one. A line
break between other than white space is a piece, so parts are cut there again when
they are learned. Parts recur, so each worker keeps the ids of those that it has
met, in a bounded table.
"""

from __future__ import annotations

import os
import re
from functools import cached_property
from itertools import chain, compress, repeat
from operator import is_

import numpy as np

#: Parts of a generation; a worker remembers the latest and the one before.
KNOWN = 400_000
#: Bytes of a generation, whatever its parts are, and the longest part that is remembered at all.
KNOWN_BYTES = 224 << 20
LONGEST = 64
#: Characters of texts that are encoded at once.
BLOCK = 1 << 17

#: Latin letters, and marks of ASCII without the apostrophe: a word and the marks behind it are two pieces of the byte-level pattern.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Words in a row that is encoded at once.
ROW = 256
#: Lines with no other white space than the breaks between them.
_LINES = re.compile(r"\S+(?:\n\S+)+")


class Encoder:
    def __init__(self, vocabulary: str, known: int = KNOWN, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # Strings of special tokens in a text are ordinary text, but for ``special``.
        self.tokenizer.encode_special_tokens = True
        # Texts with added tokens are encoded whole, by the library's own rules.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.vocabulary, self.special = vocabulary, special
        # For words of ASCII letters, one piece each and spelt as in the vocabulary: no pattern has to find pieces.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Ids of a part; False for one that can only be encoded with what is before it.
        self.known: dict[str, bytes | bool] = {}
        self.older: dict[str, bytes | bool] = {}
        # Of the words behind a line break.
        self.lines: dict[str, bytes | bool] = {}
        self.marks: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.limit, self.size = known, 0
        self.cuts = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        # Byte-level tokens spell a space and a line break with these letters.
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = {x: np.array([t.startswith(letter) for t in tokens]) for x, letter in ((" ", "\u0120"), ("\n", "\u010a"))}

    @cached_property
    def plain(self):
        """The library's own rules; few workers meet a text that needs them."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.vocabulary)
        out.encode_special_tokens = not self.special
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; what is new in a block of texts is learned at once."""
        if not self.cuts:
            return [self._text(t) for t in texts]
        out, block, size = [], [], 0
        for t in texts:
            if any(a in t for a in self.added):
                out += [*self._block(block), self._text(t)]
                block, size = [], 0
                continue
            block.append(t)
            size += len(t)
            if size > BLOCK:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        parts = [t.split(" ") for t in texts]
        starts = [p.pop(0) for p in parts]
        every = list(chain.from_iterable(parts))
        got = list(map(self.known.get, every))
        gaps = list(compress(range(len(got)), map(is_, got, repeat(None))))
        if gaps:
            found = self._learn({every[i] for i in gaps})
            for i in gaps:
                got[i] = found[every[i]]
        first, out, at = self.first, [], 0
        for text, start, rest in zip(texts, starts, parts, strict=True):
            head = first.get(start)
            if head is None:
                head = self._whole([start])[0] if start else b""
                if len(start) <= LONGEST:
                    if len(first) > 50_000:
                        first.clear()
                    first[start] = head
            end = at + len(rest)
            try:
                out.append(head + b"".join(got[at:end]))
            except TypeError:  # a part that starts with white space, or an empty one
                out.append(self._whole([text])[0])
            at = end
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes | bool]:
        """Ids of parts that are not known; of an older generation if it has them, else encoded together. Long parts are not remembered."""
        if len(self.known) + len(new) > self.limit or self.size > KNOWN_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
            self.lines.clear()
        kept = new & self.older.keys()
        out = dict(zip(kept, map(self.older.__getitem__, kept), strict=True))
        rest = new - kept
        # A line break before other than white space is a piece, and so starts another one.
        lines = {p: p.split("\n") for p in rest if "\n" in p and _LINES.fullmatch(p)}
        behind: dict[str, bytes | bool] = {}
        if lines:
            rest.difference_update(lines)
            rest.update(x[0] for x in lines.values() if x[0] not in self.known)
            self._learn_words(behind, {y for x in lines.values() for y in x[1:]}.difference(self.lines), "\n", self.lines)
        self._learn_words(out, rest, " ", self.known)
        for p, x in lines.items():
            head = out[x[0]] if x[0] in out else self.known[x[0]]
            out[p] = head + b"".join(behind[y] if y in behind else self.lines[y] for y in x[1:])
        for known, more in ((self.known, out), (self.lines, behind)):
            sizes = list(map(len, more))
            if sizes and max(sizes) > LONGEST:
                more = {p: ids for p, ids in more.items() if len(p) <= LONGEST}
                sizes = map(len, more)
            # An entry of a dictionary that grows, both objects, and for each character at most 14 bytes of text and ids.
            self.size += 202 * len(more) + 14 * sum(sizes)
            known |= more
        return out

    def _learn_words(self, known: dict[str, bytes | bool], parts: set[str], before: str, have: dict[str, bytes | bool]) -> None:
        """Add to ``known`` the ids of parts with ``before`` in front of them; ``have`` are those of other parts."""
        good, ascii_, split = [], [], []
        for p in parts:
            if p.isalpha():
                (ascii_ if p.isascii() else good).append(p)
                continue
            w = p.rstrip(_MARKS)
            if len(w) < len(p) and _LATIN.fullmatch(w):
                split.append((p, w, p[len(w) :]))
            elif not p or p[0].isspace():
                known[p] = False
            else:
                good.append(p)
        # A word that is known or learned now needs its marks only.
        for w in {w for _, w, _ in split if w not in known and w not in have and w not in parts}:
            (ascii_ if w.isascii() else good).append(w)
        for words, spelt in ((good, False), (ascii_, before == " ")):
            for at in range(0, len(words), 16 * ROW):
                some = words[at : at + 16 * ROW]
                known |= zip(some, self._together(some, before, spelt), strict=True)
        for p, w, marks in split:
            known[p] = (known[w] if w in known else have[w]) + self._marks(marks)

    def _marks(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self._whole([marks])[0]
            if len(self.marks) < 10_000 and len(marks) <= LONGEST:
                self.marks[marks] = found
        return found

    def _together(self, parts: list[str], before: str = " ", spelt: bool = False) -> list[bytes]:
        """Ids of each part with ``before`` in front of it: encoded in rows, cut where a token starts with that.

        ``spelt``: the parts are words of ASCII letters behind a space, one piece each.
        """
        tokenizer = self.tokenizer
        rows = [before.join(parts[i : i + ROW]) for i in range(0, len(parts), ROW)]
        if spelt:
            tokenizer = self.words
            rows = ["\u0120" + r.replace(" ", " \u0120") for r in rows]
        else:
            rows = [before + r for r in rows]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(rows, add_special_tokens=False)])
        cuts = (4 * np.flatnonzero(self.begins[before][ids])).tolist()
        if len(cuts) != len(parts) or cuts[0]:
            raise RuntimeError("a token goes over the end of a part")
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


_encoders: dict[tuple[str, int, bool], Encoder] = {}


def encoder(vocabulary: str, known: int = KNOWN, special: bool = False) -> Encoder:
    """The worker's own encoder of a vocabulary file."""
    key = (vocabulary, known, special)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
