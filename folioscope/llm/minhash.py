"""One-permutation MinHash fingerprints with optimal densification and b-bit packing.

A shingle is hashed once; the high bits of the hash are its bin, the least hash
of a bin its value (Li, Owen and Zhang, 2012). An empty bin takes the value of
another one, found by its own sequence of universal hashes, so that two texts
look in the same places (Shrivastava, "Optimal densification for fast and
accurate minwise hashing", 2017). Of each value the low bits are stored; the
share of equal ones is corrected for chance matches (Li and Konig, 2010).

All of it is array expressions on the row itself: no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins are a power of two; their number and the stored bits fill whole 64-bit words.
BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
PER_WORD = 64 // BITS
#: Probes with universal hashes; a bin that they leave empty goes on through all bins in an order of its own.
PROBES = 24
#: A prime above all bins, and the multipliers of the universal hashes: ((a i + b) mod p) mod BINS.
PRIME = 65537


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _probe(k: int, i: Column) -> Column:
    a, b = 1 + (k * 25_173 + 13_849) % (PRIME - 1), (k * 40_503 + 7_919) % PRIME
    return ((i * a + b) % PRIME % BINS).cast("int")


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BIN_BITS)


#: The greatest hash of each bin stands for an empty one.
_ENDS = [((b - BINS // 2 + 1) << (64 - BIN_BITS)) - 1 for b in range(BINS)]


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """A hash for each run of ``words`` words; the whole text's for fewer, none for no word.

    Words are runs of other than ASCII white space, A-Z lower-cased.
    """
    split = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+"), lambda w: w != "")
    of = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]))
    return let(F.transform(split, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) <= words, F.array(F.xxhash64(h))).otherwise(of(h)))


def _least(hashes: Column) -> Column:
    """The least hash of each of the bins, in order; the greatest possible where a bin is empty."""
    ends = F.array(*[F.lit(e).cast("long") for e in _ENDS])
    ordered = F.sort_array(F.concat(hashes, ends))
    return let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _turn(i: Column, j: Column) -> Column:
    """When bin ``i`` looks at bin ``j``: an odd factor and an offset of its own make a permutation of all bins."""
    factor, offset = (i * 40_503 + 25_173) % PRIME * 2 + 1, (i * 30_803 + 13_849) % PRIME
    return F.pmod(j * factor + offset, F.lit(BINS).cast("long"))


def _dense(least: Column) -> Column:
    """Low bits of each bin's value, where empty those of the first bin with a value that its probes find; null only if all are empty.

    Copied values are never probed: each empty bin draws from the bins that have a value of their own.
    """
    low = F.transform(least, lambda x: F.when(F.shiftleft(x, BIN_BITS) == F.lit(-(1 << BIN_BITS)).cast("long"), F.lit(None).cast("long")).otherwise(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))))

    def fill(b: Column) -> Column:
        probed = F.transform(b, lambda x, i: F.coalesce(x, *[F.get(b, _probe(k, i.cast("long"))) for k in range(1, PROBES + 1)]))
        # (place, bits) of the bins with a value; the rest is found among them.
        full = F.filter(F.transform(b, lambda x, j: F.struct(j.cast("long").alias("j"), x.alias("x"))), lambda s: s["x"].isNotNull())
        first = lambda i, own: F.array_min(F.transform(own, lambda s: F.shiftleft(_turn(i, s["j"]), BITS).bitwiseOR(s["x"]))).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
        rest = lambda p: let(full, lambda own: F.transform(p, lambda x, i: F.coalesce(x, first(i.cast("long"), own))))
        return let(probed, lambda p: F.when(F.exists(p, lambda x: x.isNull()), rest(p)).otherwise(p))

    return let(low, fill)


def packed(hashes: Column) -> Column:
    """The fingerprint as an array of 64-bit words; an empty array without shingles."""

    def words(d: Column) -> Column:
        part = lambda w, j: F.shiftleft(F.get(d, F.lit(w * PER_WORD + j)), 64 - BITS * (j + 1))
        return F.array(*[_or([part(w, j) for j in range(PER_WORD)]) for w in range(BINS // PER_WORD)])

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(let(_dense(_least(h)), words)))


def _or(parts: list[Column]) -> Column:
    while len(parts) > 1:
        parts = [parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def fingerprint(text: Column, words: int = 5) -> Column:
    """Packed one-permutation MinHash of a text (null: empty)."""
    return packed(shingle_hashes(F.coalesce(text, F.lit("")), words))


def as_string(fp: Column) -> Column:
    """Lowercase hex, empty for a text without words."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1, corrected for chance matches; 1 for two empty ones, 0 for one."""
    ones = F.lit(int("1" * (64 // BITS), 2) if BITS == 1 else sum(1 << (BITS * i) for i in range(PER_WORD))).cast("long")

    def unlike(x: Column) -> Column:
        step, y = 1, x
        while step < BITS:
            y = y.bitwiseOR(F.shiftrightunsigned(y, step))
            step *= 2
        return F.bit_count(y.bitwiseAND(ones))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), unlike)), F.lit(0), lambda s, n: s + n)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - different / F.lit(float(BINS)) - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(estimate)


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", words: int = 5) -> DataFrame:
    """``docs`` with a fingerprint column (array of 64-bit words).

    Null and empty texts, and those of white space alone, have an empty array.
    Equal texts have equal ones; texts of any length are read whole. Repeated
    rows keep their number, an empty table stays empty. Other columns pass; one
    named ``name`` is replaced.
    """
    return docs.withColumn(name, fingerprint(F.col(text_col), words))
