"""Schemas of the engine's tables and results."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

#: What Spark's binaryFile source reads.
FILES = T.StructType([T.StructField("path", _S), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", _L), T.StructField("content", T.BinaryType())])

BOOKS = T.StructType(
    [
        T.StructField("id", _L, False),
        T.StructField("title", _S, False),
        T.StructField("author", _S),
        T.StructField("publication_year", _I),
        T.StructField("department", _S),
        T.StructField("file_path", _S, False),
        T.StructField("language_code", _S),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("id", _L, False),
        T.StructField("book_id", _L, False),
        T.StructField("chunk_index", _I, False),
        T.StructField("page_number", _I),
        T.StructField("chunk_text", _S, False),
        T.StructField("language_code", _S),
        T.StructField("es_doc_id", _S),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CHUNK_INDEX = T.StructType(
    [
        T.StructField("doc_id", _S, False),
        T.StructField("book_id", _L, False),
        T.StructField("chunk_id", _L, False),
        T.StructField("chunk_index", _I, False),
        T.StructField("page_number", _I),
        T.StructField("title", _S),
        T.StructField("author", _S),
        T.StructField("department", _S),
        T.StructField("language_code", _S),
        T.StructField("file_path", _S),
        T.StructField("text", _S),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)

ERRORS = T.StructType([T.StructField("file_path", _S, False), T.StructField("message", _S), T.StructField("attempt", _I), T.StructField("batch_id", _L), T.StructField("failed_at", T.TimestampType())])

#: Batches whose rows another batch, that of the partition, holds too.
REPLACED = T.StructType([T.StructField("old", _S, False)])

RESULT = T.StructType(
    [
        T.StructField("rank", _I, False),
        T.StructField("retrieval_score", _D),
        T.StructField("qa_score", _D),
        T.StructField("quote", _S),
        T.StructField("answer_span", T.StructType([T.StructField("start", _I), T.StructField("end", _I)])),
        T.StructField("source", T.StructType([T.StructField("book_title", _S), T.StructField("author", _S), T.StructField("department", _S), T.StructField("page_number", _I), T.StructField("file_path", _S)])),
        T.StructField("matched_paragraph", _S),
        T.StructField("chunk_preview", _S),
        T.StructField("qa_runner", _S),
    ]
)

API_RESULT = T.StructType([T.StructField(n, _I if n == "page_number" else _S) for n in ("exact_quote", "book_title", "author", "department", "page_number", "pdf_link", "paragraph_text")])
