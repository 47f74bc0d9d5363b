"""Embedders and answerers: interfaces, deterministic stand-ins, and adapters for local models.

The stand-ins match the interface of neural models, not their answers. Models are
loaded once in each Python worker, never once for each request.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let

log = logging.getLogger(__name__)


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        """A unit row of ``dimension`` floats for each text."""


class Answerer(Protocol):
    name: str

    def answer(self, question: str, context: str) -> dict:
        """``answer, score, start, end``; offsets are code points of ``context``."""


def has_gpu() -> bool:
    """Whether models on this machine can use a GPU."""
    try:
        import torch
    except ImportError:
        return False
    return torch.cuda.is_available()


def device_for(wanted: str) -> str:
    """``cuda`` where it is there and ``cpu`` is not wanted, else ``cpu``; a GPU that was asked for and is missing is told."""
    if wanted not in ("auto", "cpu", "cuda"):
        raise ValueError(f"not a device: {wanted}")
    if wanted == "cpu" or not has_gpu():
        if wanted == "cuda":
            log.warning("no GPU here, models run on the CPU")
        return "cpu"
    return "cuda"


class HashingEmbedder:
    """Signed counts of hashed words, scaled to length 1; a text without words gets the first unit vector."""

    def __init__(self, dimension: int = 1024):
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.strip(".,;:!?\"'()").encode(), digest_size=8).digest(), "little")
                row[(h >> 1) % self.dimension] += 1 if h & 1 else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
            else:
                row[0] = 1
        return out


class SentenceEmbedder:
    """A sentence-transformer in a local folder, loaded on first use in each process."""

    def __init__(self, path: str, dimension: int = 1024, device: str = "auto"):
        self.path, self.dimension, self.device, self._model = path, dimension, device, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.path, device=device_for(self.device))
        return np.asarray(self._model.encode(list(texts), normalize_embeddings=True), np.float32)


class LexicalAnswerer:
    """The context word that the question has, longest first; its score is the share of question words found."""

    name = "lexical"

    def answer(self, question: str, context: str) -> dict:
        asked = {w for w in re.split(r"[ \t-\r]+", question.lower()) if w}
        best, found = None, set()
        for m in re.finditer(r"[^ \t-\r]+", context):
            w = m.group().lower()
            if w in asked:
                found.add(w)
                if best is None or len(w) > len(best.group()):
                    best = m
        if best is None:
            return {"answer": "", "score": 0.0, "start": -1, "end": -1}
        return {"answer": best.group(), "score": len(found) / len(asked), "start": best.start(), "end": best.end()}


class PipelineAnswerer:
    """An extractive question-answering pipeline of a local model, loaded on first use in each process."""

    name = "pipeline"

    def __init__(self, path: str, device: str = "auto"):
        self.path, self.device, self._run = path, device, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_run": None}

    def answer(self, question: str, context: str) -> dict:
        if self._run is None:
            from transformers import pipeline

            self._run = pipeline("question-answering", model=self.path, tokenizer=self.path, device=0 if device_for(self.device) == "cuda" else -1)
        return self._run(question=question, context=context)


#: Tokens of a question and its context that a model sees; the context is cut.
CONTEXT_TOKENS = 512


class PairEncoder:
    """Question and context as a model takes them, by a tokenizer file of the tokenizers library."""

    def __init__(self, tokenizer: str, limit: int = CONTEXT_TOKENS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.tokenizer.enable_truncation(limit, strategy="only_second")
        self.tokenizer.no_padding()

    def encode(self, question: str, context: str) -> tuple[list[int], list[int], list[tuple[int, int] | None]]:
        """Ids, attention mask, and for each token its bounds in the context, none for other tokens."""
        e = self.tokenizer.encode(question, context)
        own = [o if s == 1 else None for o, s in zip(e.offsets, e.sequence_ids, strict=True)]
        return e.ids, e.attention_mask, own


class OnnxLogits:
    """``encode`` for :class:`LogitsAnswerer` from a folder with ``tokenizer.json`` and ``model.onnx``, loaded on first use in each process."""

    def __init__(self, path: str, device: str = "auto", limit: int = CONTEXT_TOKENS):
        self.path, self.device, self.limit, self._loaded = path, device, limit, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def _session(self):
        import onnxruntime

        wanted = ["CUDAExecutionProvider"] if device_for(self.device) == "cuda" else []
        providers = [p for p in (*wanted, "CPUExecutionProvider") if p in onnxruntime.get_available_providers()]
        return onnxruntime.InferenceSession(f"{self.path}/model.onnx", providers=providers)

    def __call__(self, question: str, context: str) -> tuple[list[tuple[int, int] | None], Sequence[float], Sequence[float]]:
        if self._loaded is None:
            self._loaded = PairEncoder(f"{self.path}/tokenizer.json", self.limit), self._session()
        pairs, session = self._loaded
        ids, mask, own = pairs.encode(question, context)
        given = {"input_ids": [ids], "attention_mask": [mask], "token_type_ids": [[0] * len(ids)]}
        feed = {i.name: np.array(given[i.name], np.int64) for i in session.get_inputs()}
        starts, ends = session.run(["start_logits", "end_logits"], feed)
        return own, starts[0].tolist(), ends[0].tolist()


class LogitsAnswerer:
    """Answers from start and end logits of any model: ``encode(question, context)`` gives offsets of context tokens (None for others) and both logits.

    Start is the best context token, end the best one from there on; the score is
    the product of their sigmoids. Without context tokens the answer is empty.
    """

    name = "logits"

    def __init__(self, encode: Callable[[str, str], tuple[list[tuple[int, int] | None], Sequence[float], Sequence[float]]]):
        self.encode = encode

    def answer(self, question: str, context: str) -> dict:
        offsets, starts, ends = self.encode(question, context)
        own = [i for i, o in enumerate(offsets) if o is not None]
        if not own:
            return {"answer": "", "score": 0.0, "start": -1, "end": -1}
        first = max(own, key=lambda i: (starts[i], -i))
        last = max((i for i in own if i >= first), key=lambda i: (ends[i], -i))
        a, b = offsets[first][0], offsets[last][1]
        squash = lambda x: 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        return {"answer": context[a:b].strip(), "score": squash(starts[first]) * squash(ends[last]), "start": a, "end": b}


def coerced(got: dict) -> tuple[str, float, int, int]:
    """A runner's answer with the defaults of what it leaves out."""
    value = lambda k, d: d if got.get(k) is None else got[k]
    return str(value("answer", "")), float(value("score", 0.0)), int(value("start", -1)), int(value("end", -1))


def embedded(df: DataFrame, embedder: Embedder, text_col: str = "text", name: str = "embedding") -> DataFrame:
    """``df`` with a unit vector for each text, by Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder.embed(texts.fillna("").tolist())))

    return df.withColumn(name, run(F.col(text_col)))


def answered(df: DataFrame, answerer: Answerer, question: Column, text_col: str = "text", name: str = "qa") -> DataFrame:
    """``df`` with ``struct<answer, score, start, end>`` for each row."""

    @F.pandas_udf("answer string, score double, start int, end int")
    def run(questions: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        rows = [coerced(answerer.answer(q, c or "")) for q, c in zip(questions, contexts, strict=True)]
        return pd.DataFrame(rows, columns=["answer", "score", "start", "end"])

    return df.withColumn(name, run(question, F.col(text_col)))


def lexical_answer(question: Column, text: Column) -> Column:
    """:class:`LexicalAnswerer` as an expression, so that it stays in the JVM.

    The words of both are runs of other than ASCII white space, compared in lower case.
    """
    asked = F.array_distinct(F.filter(F.split(F.lower(question), r"[ \t-\r]+"), lambda w: w != ""))

    def of(a: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(r"([^ \t-\r]+|[ \t-\r]+)"), F.lit(1))

        def pick(tokens: Column, hits: Column) -> Column:
            # The first of the longest words is also the first token that is spelled so.
            most = F.array_max(F.transform(hits, lambda x: F.length(x)))
            longest = let(most, lambda n: F.get(F.filter(hits, lambda w: F.length(w) == n), F.lit(0)))

            def located(w: Column) -> Column:
                before = F.slice(tokens, 1, (F.array_position(tokens, w) - 1).cast("int"))
                at = F.when(w.isNull(), F.lit(-1)).otherwise(F.length(F.array_join(before, ""))).cast("int")
                found = F.size(F.array_distinct(F.transform(hits, lambda x: F.lower(x))))
                return F.struct(F.coalesce(w, F.lit("")).alias("answer"), F.when(w.isNull(), F.lit(0.0)).otherwise(found / F.size(a)).alias("score"), at.alias("start"), F.when(w.isNull(), F.lit(-1)).otherwise(at + F.length(w)).cast("int").alias("end"))

            return let(longest, located)

        return let(tokens, lambda ts: let(F.filter(ts, lambda w: F.array_contains(a, F.lower(w))), lambda hits: pick(ts, hits)))

    return let(asked, of)
