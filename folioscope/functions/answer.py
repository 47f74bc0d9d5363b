"""From an answer span to its sentence and its paragraph, as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TERMINATORS

#: Shares of the paragraph limit under which a neighbour is taken although it goes beyond the limit.
LEFT_SHARE, RIGHT_SHARE = 0.6, 0.8


#: A sentence with its terminator, or a terminator alone.
_TOKEN = re.compile(f"[^{TERMINATORS}]+[{TERMINATORS}]?|[{TERMINATORS}]")


def _spans(text: str) -> list[tuple[int, int, str]]:
    """:func:`text.sentences` of one text."""
    found = ((m.start(), m.end(), m.group().strip()) for m in _TOKEN.finditer(text))
    return [(s, e, x) for s, e, x in found if x and (e - s > 1 or x not in TERMINATORS)]


def _anchored(spans: list[tuple[int, int, str]], start: float, end: float) -> int:
    """The sentence that holds the whole span, else the one that holds its start, else the first; -1 without sentences. A missing place is in none."""
    if not spans:
        return -1
    whole = (i for i, (s, e, _) in enumerate(spans) if s <= start and end <= e)
    begun = (i for i, (s, e, _) in enumerate(spans) if s <= start < e)
    return next(whole, next(begun, 0))


def _grown(spans: list[tuple[int, int, str]], at: int, limit: int) -> str:
    # Sentences of normalised text have single spaces, so the words are one more than these.
    size = lambda i: spans[i][2].count(" ") + 1
    lo, hi, total, moved = at, at, size(at), True
    while moved and total < limit:
        moved = False
        if lo > 0 and (total + size(lo - 1) <= limit or total < LEFT_SHARE * limit):
            lo, total, moved = lo - 1, total + size(lo - 1), True
        if hi < len(spans) - 1 and (total + size(hi + 1) <= limit or total < RIGHT_SHARE * limit):
            hi, total, moved = hi + 1, total + size(hi + 1), True
    return " ".join(x for _, _, x in spans[lo : hi + 1])


def _located(text: Column, start: Column, end: Column, limit: int | None) -> Column:
    """``struct<sentence, start, end, paragraph>`` of normalised text by Arrow batches; no paragraph where ``limit`` is None."""

    @F.pandas_udf("sentence string, start int, end int, paragraph string")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, start, end in zip(texts, starts, ends, strict=True):
            t = " ".join((text or "").split())
            spans = _spans(t)
            at = _anchored(spans, start, end)
            s, e, x = spans[at] if at >= 0 else (0, len(t), t) if t else (-1, -1, t)
            rows.append((x, s, e, None if limit is None else _grown(spans, at, limit) if at >= 0 else t))
        return pd.DataFrame(rows, columns=["sentence", "start", "end", "paragraph"])

    # As doubles, places have one type in pandas, with nulls or not.
    return run(text, start.cast("double"), end.cast("double"))


def complete_sentence(text: Column, start: Column, end: Column) -> Column:
    """``struct<sentence, start, end>`` of the anchor in normalised text; the whole text if it has no sentence, -1 if empty."""
    found = _located(text, start, end, None)
    return F.struct(*[found[c].alias(c) for c in ("sentence", "start", "end")])


def matched_paragraph(text: Column, start: Column, end: Column, limit: int = 140) -> Column:
    """Sentences around the anchor, about ``limit`` words.

    In turn a sentence on the left, then one on the right is taken, if it fits or
    the paragraph is still under its share of the limit, until neither moves.
    """
    return _located(text, start, end, limit)["paragraph"]


def extracted(text: Column, start: Column, end: Column, limit: int = 140) -> Column:
    """``struct<sentence, paragraph>`` of both, from one pass over the sentences."""
    found = _located(text, start, end, limit)
    return F.struct(F.struct(*[found[c].alias(c) for c in ("sentence", "start", "end")]).alias("sentence"), found["paragraph"].alias("paragraph"))


def quote(sentence: Column, answer: Column) -> Column:
    """The sentence, or the bare answer if there is none."""
    return F.coalesce(F.nullif(sentence, F.lit("")), answer)
