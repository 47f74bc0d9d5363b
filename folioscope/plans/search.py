"""From hits to results: answers, quotes, paragraphs, order, and the projections for clients. Lazy but for the ids of the hits."""

from __future__ import annotations

import posixpath
import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answer as a
from ..functions.text import let
from ..operators.models import Answerer, answered
from ..operators.retrieval import top_k


#: Fixed value of the client's contract.
NO_PARAGRAPH = "Paragraph text unavailable for this hit."


def hits(index: DataFrame, vector: Sequence[float], k: int) -> DataFrame:
    """Top-k rows of the index; a missing score counts as 0.

    The search reads ids and vectors alone; the k ids then reach the scan of the
    other columns as a filter.
    """
    return rows_of(index, top_k(index.select("chunk_id", "embedding"), vector, k, ["chunk_id"]))


def rows_of(index: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of the index behind ``best (chunk_id, retrieval_score, rank)``, a few rows."""
    best = best.select("chunk_id", "retrieval_score", "rank").collect()
    found = index.sparkSession.createDataFrame(best, "chunk_id long, retrieval_score double, rank int")
    rows = index.drop("embedding").where(F.col("chunk_id").isin([r["chunk_id"] for r in best]))
    return rows.join(F.broadcast(found), "chunk_id").withColumn("retrieval_score", F.coalesce("retrieval_score", F.lit(0.0)))


def extracted(found: DataFrame, limit: int = 140, text_col: str = "text") -> DataFrame:
    """Sentence, span and paragraph of the answer in ``qa``. Hits without text go; they keep their rank number used."""
    text, start, end = F.col(text_col), F.col("qa.start"), F.col("qa.end")
    rows = found.where(F.coalesce(text, F.lit("")) != "")
    rows = rows.withColumn("found", a.extracted(text, start, end, limit))
    return rows.withColumns({"sentence": F.col("found.sentence"), "matched_paragraph": F.col("found.paragraph"), "quote": a.quote(F.col("found.sentence.sentence"), F.col("qa.answer"))})


def reranked(df: DataFrame, score_col: str = "qa_score", rank_col: str = "rank") -> DataFrame:
    """By score, equal ones in the order of retrieval; ``rank`` stays the one of retrieval."""
    return df.orderBy(F.desc(score_col), rank_col)


def results(found: DataFrame, runner: str, limit: int = 140) -> DataFrame:
    """The nested result records of hits with ``qa``."""
    rows = extracted(found, limit)
    return reranked(
        rows.select(
            F.col("rank").cast("int"),
            "retrieval_score",
            F.col("qa.score").alias("qa_score"),
            "quote",
            F.struct(F.col("sentence.start").alias("start"), F.col("sentence.end").alias("end")).alias("answer_span"),
            F.struct(F.col("title").alias("book_title"), "author", "department", "page_number", "file_path").alias("source"),
            "matched_paragraph",
            F.col("text").alias("chunk_preview"),
            F.lit(runner).alias("qa_runner"),
        )
    )


def search(index: DataFrame, best: DataFrame, question: str, answerer: Answerer, limit: int = 140) -> DataFrame:
    """Result records of the rows of the index that ``best (chunk_id, retrieval_score, rank)`` names."""
    return results(answered(rows_of(index, best), answerer, F.lit(question)), answerer.name, limit)


#: A character of a word.
_WORD = r"[\p{L}\p{M}\p{N}]"


def _pieces_of(words: Sequence[str]) -> str | None:
    """A pattern of the whole pieces (runs of word characters, or of others) that may be one of ``words`` in lower case; None if no piece can be."""
    kinds = {w: {unicodedata.category(c)[0] in "LMN" for c in w} for w in words if w}
    some = lambda kind: "|".join(re.sub("i\u0307", "(?:i\u0307|\u0130)", re.escape(w)) for w, k in kinds.items() if k == {kind})
    inside, between = some(True), some(False)
    parts = [f"(?<!{_WORD})(?iu:{inside})(?!{_WORD})"] if inside else []
    parts += [f"(?<!{_WORD.replace('[', '[^')})(?:{between})(?!{_WORD.replace('[', '[^')})"] if between else []
    return "|".join(parts) or None


def highlights(text: Column, words: Sequence[str]) -> Column:
    """``array<struct<start, end>>``: where a text says one of the lower-cased ``words``, in one pass over what may be one and what stands between."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    pattern = _pieces_of(words)
    if pattern is None:
        return none
    wanted, text = F.array(*[F.lit(w) for w in words]), F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct((s["at"] + x["before"]).alias("start"), (s["at"] + x["before"] + x["own"]).alias("end"))
        return F.struct((s["at"] + x["before"] + x["own"]).alias("at"), F.when(x["is"], F.concat(s["found"], F.array(here))).otherwise(s["found"]).alias("found"))

    def placed(said: Column) -> Column:
        # The text behind the last piece has none.
        before = F.slice(F.split(text, pattern), 1, F.size(said))
        each = F.zip_with(before, said, lambda b, p: F.struct(F.length(b).alias("before"), F.length(p).alias("own"), F.array_contains(wanted, F.lower(p)).alias("is")))
        return F.aggregate(each, start, step)["found"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def facets(found: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts of ``found`` by each of ``sets`` of attributes, in one pass: ``facet`` names the set, ``value`` its values, joined by a bar."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    counts = found.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.grouping_id(*columns).alias("gid"), F.count("*").alias("n"))
    bits = {sum(1 << (len(columns) - 1 - k) for k, c in enumerate(columns) if c not in s): s for s in sets}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, s in bits.items():
        name = F.when(F.col("gid") == g, "|".join(s)).otherwise(name)
        value = F.when(F.col("gid") == g, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s])).otherwise(value)
    return counts.select(name.alias("facet"), value.alias("value"), "n")


def link(path: Column) -> Column:
    """Path as a link: ``./`` in front goes once, a ``/`` comes; ``#`` for none."""
    bare = F.when(F.startswith(path, F.lit("./")), F.substring(path, F.lit(3), F.length(path))).otherwise(path)
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("#")).when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.lit("/"), bare))


def or_else(c: Column, default: Column) -> Column:
    """``default`` for null and empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def api_columns() -> list[Column]:
    """The fields of the API's flat record, from a result record."""
    return [
        F.coalesce("quote", F.lit("")).alias("exact_quote"),
        or_else(F.col("source.book_title"), F.lit("Unknown Title")).alias("book_title"),
        or_else(F.col("source.author"), F.lit("Unknown Author")).alias("author"),
        F.col("source.department").alias("department"),
        F.coalesce("source.page_number", F.lit(0)).alias("page_number"),
        link(F.col("source.file_path")).alias("pdf_link"),
        or_else(F.col("matched_paragraph"), F.coalesce("chunk_preview", F.lit(""))).alias("paragraph_text"),
    ]


def api_results(df: DataFrame) -> DataFrame:
    """The flat records of the API, in the order of ``df``."""
    return df.select(*api_columns())


def client_results(df: DataFrame) -> DataFrame:
    """API records with the client's defaults (for null only) and the preview address."""
    default = {"exact_quote": "", "book_title": "Unknown Title", "author": "Unknown Author", "pdf_link": "#", "paragraph_text": ""}
    rows = df.select(*[F.coalesce(c, F.lit(default[c])).alias(c) if c in default else F.coalesce(c, F.lit(0)).alias(c) if c == "page_number" else F.col(c) for c in df.columns])
    return rows.withColumn("preview", preview(F.col("pdf_link"), F.col("page_number"))).withColumn("paragraph_shown", or_else(F.col("paragraph_text"), F.lit(NO_PARAGRAPH)))


def preview(pdf_link: Column, page: Column) -> Column:
    return F.concat(pdf_link, F.lit("#page="), page.cast("string"))


def served_path(root: str, url_path: str) -> str | None:
    """File under ``root`` for a path of the static mount, or none if it leads out of it."""
    at = posixpath.normpath(posixpath.join(root, url_path.lstrip("/")))
    return at if at == root or at.startswith(root.rstrip("/") + "/") else None
