"""Tables of pages to tables of chunks, books and index rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def word_chunks(df: DataFrame, text_col: str, size: int, overlap: int, keep: list[str]) -> DataFrame:
    """A row for each chunk: ``keep``, ``pos`` from 0, ``chunk_text``."""
    return df.select(*keep, F.posexplode(t.chunks(F.col(text_col), size, overlap)).alias("pos", "chunk_text"))


def page_chunks(pages: DataFrame, size: int, overlap: int, book_col: str = "path", page_col: str = "page_number", text_col: str = "text") -> DataFrame:
    """Chunks that never cross pages, numbered from 0 over each book in page order.

    A page's first number is the sum of the chunks before it, so the numbering
    exchanges one count for each page and not the texts.
    """
    cut = pages.select(book_col, page_col, t.chunks(F.col(text_col), size, overlap).alias("chunks"))
    before = F.coalesce(F.sum(F.size("chunks")).over(Window.partitionBy(book_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before", before).select(book_col, page_col, F.posexplode("chunks").alias("pos", "chunk_text"), "before").select(book_col, page_col, (F.col("before") + F.col("pos")).cast("int").alias("chunk_index"), "pos", "chunk_text")


def clean_pages(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Text sanitised and normalised; blank pages go."""
    return pages.withColumn(text_col, t.normalise(t.sanitise(F.coalesce(F.col(text_col), F.lit(""))))).where(F.col(text_col) != "")


def new_files(files: DataFrame, known: DataFrame, path_col: str = "path", known_col: str = "file_path") -> DataFrame:
    """Rows of ``files`` whose path the registry does not hold."""
    return files.join(known.select(F.col(known_col).alias(path_col)), path_col, "left_anti")


#: Rows of a range that is numbered in one task.
RANGE_ROWS = 1 << 17


def with_running(new: DataFrame, order: str, sums: dict[str, Column], path: str) -> DataFrame:
    """``new`` with, for each name in ``sums``, the sum of that column over the rows before in ``order``, whose ties are in any order and whose nulls are last.

    Rows go to ranges, which are written to ``path`` so that a retry sees the
    same ones; a range is summed in a task, and what goes before it is a sum
    over one row for each range.
    """
    spark = new.sparkSession
    n = max(1, -(-new.count() // RANGE_ROWS))
    new.repartitionByRange(n, F.asc_nulls_last(order)).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    ranged = spark.read.parquet(path)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    totals = totals.select(F.col("_range"), *[before(F.col(f"_{k}"), Window.orderBy("_range")).alias(f"_{k}") for k in sums])
    inside = ranged.withColumns({k: before(c, Window.partitionBy("_range").orderBy(F.asc_nulls_last(order))) for k, c in sums.items()})
    joined = inside.join(F.broadcast(totals), "_range")
    return joined.withColumns({k: (F.col(k) + F.col(f"_{k}")).cast("long") for k in sums}).drop("_range", *[f"_{k}" for k in sums])
