"""Text as Column expressions: sanitising, white space, words, chunks, sentences, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that Python's str.isspace holds for, as a class of Java's regex.
WHITE_SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The characters that end a sentence.
TERMINATORS = ".!?।！？"

#: The same code points as a string.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

#: Tokens whose ends are summed in one fold; the folds of all such blocks make texts of any length cost in proportion.
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def sanitise(c: Column) -> Column:
    """Without NUL characters."""
    return F.replace(c, F.char(F.lit(0)), F.lit(""))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def words(c: Column) -> Column:
    """The runs of other than white space."""
    return F.filter(F.split(c, WHITE_SPACE + "+"), lambda x: x != "")


def normalise(c: Column) -> Column:
    """Words with single spaces between."""
    return F.array_join(words(c), " ")


def _step(size: int, overlap: int) -> int:
    if size <= 0:
        raise ValueError("size must be positive")
    return max(1, size - overlap)


def chunk_count(text: Column, size: int, overlap: int) -> Column:
    """How many chunks :func:`chunks` cuts, without cutting them."""
    return F.ceil(F.size(words(F.coalesce(text, F.lit("")))) / _step(size, overlap)).cast("int")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Overlapping word chunks: one starts every ``max(1, size - overlap)`` words, while words are left there."""
    step = _step(size, overlap)

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w), F.lit(step))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(F.coalesce(text, F.lit(""))), cut)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{TERMINATORS}]+[{TERMINATORS}]?|[{TERMINATORS}])"), F.lit(1))


def _running(sizes: Column, start: Column) -> Column:
    """``start`` and the sums of ``start`` and the first sizes, by one fold that appends: for short arrays."""
    return F.aggregate(sizes, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _ends(sizes: Column) -> Column:
    """0 and the running sums of ``sizes``; the blocks' own sums go first, so no long array is copied for each element."""

    def blocked() -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK))

        def summed(bs: Column) -> Column:
            starts = _running(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda s, n: s + n)), F.lit(0))
            inside = lambda st: F.flatten(F.transform(bs, lambda x, i: F.slice(_running(x, F.get(st, i)), 2, BLOCK)))
            return F.concat(F.array(F.lit(0)), let(starts, inside))

        return let(blocks, summed)

    return F.when(F.size(sizes) <= BLOCK, _running(sizes, F.lit(0))).otherwise(blocked())


def sentences(text: Column) -> Column:
    """``array<struct<s int, e int, x string>>``: bounds with the leading space, text without it.

    A sentence is what goes before a terminator, and that one. What is only
    terminators or white space is none. Offsets count code points.
    """

    def spans(tokens: Column) -> Column:
        of = lambda e: F.transform(tokens, lambda t, i: F.struct(F.get(e, i).alias("s"), F.get(e, i + 1).alias("e"), strip(t).alias("x")))
        return F.filter(let(let(F.transform(tokens, F.length), _ends), of), lambda x: (x["x"] != "") & ((x["e"] - x["s"] > 1) | ~F.contains(F.lit(TERMINATORS), x["x"])))

    return let(_tokens(F.coalesce(text, F.lit(""))), spans)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots start no extension."""
    base = basename(path)
    whole = F.regexp_extract(base, r"(?s)^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(whole != "", whole).otherwise(base)


def file_metadata(path: Column) -> Column:
    """``struct<title, author, publication_year, department>`` that a file name suggests.

    ``title - author - …`` by hyphens; else ``department_title words`` by
    underscores if there is no author. The year is the leftmost 19dd or 20dd
    (ASCII digits). Without a title the base name stands in.
    """

    def of(s: Column) -> Column:
        parts = lambda c: F.filter(F.transform(F.split(s, c), lambda x: strip(x)), lambda x: x != "")
        none = F.lit(None).cast("string")
        year = F.regexp_extract(s, r"((?:19|20)[0-9]{2})", 1)

        def from_parts(hyphens: Column, under: Column) -> Column:
            named = F.size(hyphens) >= 2
            filed = ~named & (F.size(under) >= 2)
            title = F.when(named, F.get(hyphens, F.lit(0))).when(filed, F.array_join(F.slice(under, 2, F.greatest(F.size(under) - 1, F.lit(0))), " ")).otherwise(s)
            return F.struct(
                F.coalesce(F.nullif(title, F.lit("")), basename(path)).alias("title"),
                F.when(named, F.get(hyphens, F.lit(1))).otherwise(none).alias("author"),
                F.nullif(year, F.lit("")).cast("int").alias("publication_year"),
                F.when(filed, F.get(under, F.lit(0))).otherwise(none).alias("department"),
            )

        return let(parts("-"), lambda h: let(parts("_"), lambda u: from_parts(h, u)))

    return let(stem(path), of)


def document_id(book_id: Column, chunk_index: Column) -> Column:
    return F.format_string("book-%d-chunk-%d", book_id, chunk_index)
