"""Language of a text by its letters: profiles of hashed runs of three, learned from labelled texts and scored by Arrow batches.

A profile is a whole number for each bucket, a thousand times the log of its
smoothed share, rounded down. A text's score is the sum over its runs, so scores
are exact and the same wherever they are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of runs, and the factors that put three letters in one.
BUCKETS = 1 << 12
FACTORS = (961, 31, 1)
#: What stands between words.
_LETTERS = r"[^\p{L}\p{M}]+"


@dataclass(frozen=True)
class Profiles:
    """``codes`` in ascending order, and for each the weights of all buckets."""

    codes: list[str]
    weights: np.ndarray

    def as_rows(self) -> list[tuple[str, list[int]]]:
        return [(c, w.tolist()) for c, w in zip(self.codes, self.weights, strict=True)]

    @classmethod
    def of_rows(cls, rows: list) -> Profiles:
        rows = sorted(rows, key=lambda r: r["code"])
        return cls([r["code"] for r in rows], np.array([r["weights"] for r in rows], np.int64).reshape(len(rows), BUCKETS))


def _plain(text: Column) -> Column:
    """Lower-cased, with one space between words and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _LETTERS, " ")), F.lit(" "))


def _runs(plain: str) -> np.ndarray:
    """:func:`buckets` of a text that :func:`_plain` made."""
    a = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.int64)
    return sum(a[k : len(a) - 2 + k] * f for k, f in enumerate(FACTORS)) % BUCKETS if len(a) > 2 else a[:0]


def buckets(text: Column) -> Column:
    """The bucket of every run of three letters, lower-cased, with one space between words and at both ends; none for a text without letters."""
    plain = _plain(text)
    # One split and one pass: a substring for each place would start at the first letter each time.
    points = F.transform(F.split(plain, ""), lambda c: F.ascii(c))
    run = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.pmod(sum((F.get(a, i + k) * f for k, f in enumerate(FACTORS)), F.lit(0)), F.lit(BUCKETS)))
    return F.transform(F.array(points), lambda a: F.when(F.size(a) > 2, run(a)).otherwise(F.array().cast("array<int>")))[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a task's texts of each language have each bucket."""
    n: dict[str, np.ndarray] = {}
    for b in batches:
        for code, plain in zip(b.column("code").to_pylist(), b.column("plain").to_pylist(), strict=True):
            own = n.setdefault(code, np.zeros(BUCKETS, np.int64))
            own += np.bincount(_runs(plain), minlength=BUCKETS)
    for code, own in n.items():
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([code] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(own[there])], ["code", "b", "n"])


def learned(docs: DataFrame, text_col: str = "text", code_col: str = "lang") -> Profiles:
    """Profiles of all labelled texts; a row for each language and bucket reaches the driver.

    Rows with a null code or text are not used; no row at all gives no profile.
    """
    rows = docs.where(F.col(code_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(code_col).alias("code"), _plain(F.col(text_col)).alias("plain"))
    found = rows.mapInArrow(_counted, "code string, b int, n long").groupBy("code", "b").agg(F.sum("n").alias("n")).collect()
    codes = sorted({r["code"] for r in found})
    n = np.zeros((len(codes), BUCKETS))
    for r in found:
        n[codes.index(r["code"]), r["b"]] = r["n"]
    share = (n + 1) / (n.sum(1, keepdims=True) + BUCKETS)
    return Profiles(codes, np.floor(1000 * np.log(share)).astype(np.int64))


def language(text: Column, profiles: Profiles) -> Column:
    """The code of the profile with the greatest score, the first of equals; null without letters or profiles."""
    if not profiles.codes:
        return F.lit(None).cast("string")
    codes, weights = profiles.codes, profiles.weights

    @F.pandas_udf("string")
    def best(plain: pd.Series) -> pd.Series:
        runs = map(_runs, plain)
        return pd.Series([codes[int(weights[:, b].sum(1).argmax())] if len(b) else None for b in runs], dtype=object)

    return best(_plain(text))
