"""Quality classifier: a factorisation machine over hashed words and text structure.

score = sigmoid(b + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
all pairwise interactions in time linear in the features (Rendle, "Factorization
machines", 2010). x holds hashed words (frequency weights, unit length) and
standardised statistics of the whole text; numeric metadata columns can be added.

The model is fitted on the driver on a bounded sample of labelled rows
(``Settings.train_rows``, the rows with the least hash of their id); weights have
a fixed size and are broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes, keyed, sliced, texts, unkeyed


@dataclass(frozen=True)
class Settings:
    #: Most labelled rows that the model is fitted on.
    train_rows: int = 6000
    buckets: int = 4096
    rank: int = 8
    epochs: int = 14
    step: float = 0.02
    decay: float = 1e-4
    batch: int = 128
    threshold: float = 0.7
    seed: int = 7


_LETTERS_UP = np.arange(65, 91)
_LETTERS_LOW = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_END_MARKS = np.array([33, 46, 63])
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!.?,'-"])
STATISTICS = 18


def statistics(text: bytes, words: list[bytes]) -> np.ndarray:
    """Structure of a whole text; zeros for an empty one."""
    out = np.zeros(STATISTICS)
    if not words:
        return out
    n, size = len(words), len(text)
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = max(1, of[_LETTERS_UP].sum() + of[_LETTERS_LOW].sum())
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = sum(map(int, of[_MARKS]))
    out[:] = (
        np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        of[_LETTERS_UP].sum() / letters, of[_DIGITS].sum() / size, marked / n, of[_END_MARKS].sum() / n,
        of[33] / n, of[124] / n, of[44] / n, of[128:].sum() / size,
        len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(lines) / n,
        max(of[_MARKS]) / n, (lengths == 1).mean(),
    )
    return out


def counts(words: list[bytes], buckets: int) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed words."""
    if not words:
        return np.zeros(buckets, np.float32)
    x = np.sqrt(np.bincount((hashes(words) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets))
    return (x / np.linalg.norm(x)).astype(np.float32)


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    buckets: int

    def inputs(self, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.hstack([words, np.clip((dense - self.centre) / self.spread, -4, 4).astype(np.float32) / 2])

    def score(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        z = self.bias + x @ self.linear + 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


class Sparse:
    """Rows of a matrix by the places and values that are not 0; an index gives those rows whole."""

    def __init__(self, ends: np.ndarray, at: np.ndarray, x: np.ndarray, width: int, rows: np.ndarray | None = None):
        self.ends, self.at, self.x, self.rows = ends, at, x, np.arange(len(ends) - 1) if rows is None else rows
        self.shape = len(self.rows), width

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), self.shape[1]), np.float32)
        for to, row in zip(out, self.rows[i].tolist(), strict=True):
            a, b = self.ends[row : row + 2]
            to[self.at[a:b]] = self.x[a:b]
        return out

    def ordered(self, rows: np.ndarray) -> Sparse:
        return Sparse(self.ends, self.at, self.x, self.shape[1], self.rows[rows])


def fit(words: np.ndarray | Sparse, dense: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Adam on the log loss, classes weighted evenly; without two classes the score is the share of label 1."""
    rng = np.random.default_rng(s.seed)
    d = words.shape[1] + dense.shape[1]
    m = Model(dense.mean(0) if len(y) else np.zeros(dense.shape[1]), dense.std(0) + 1e-6 if len(y) else np.ones(dense.shape[1]), 0.0, np.zeros(d, np.float32), rng.normal(0, 0.02, (d, s.rank)).astype(np.float32), s.buckets)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        m.factors[:] = 0
        m.bias = float(np.log((share + 0.01) / (1.01 - share)))
        return m
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1, np.float32), m.linear, m.factors)]
    bias, t = np.zeros(1, np.float32), 0
    for epoch in range(s.epochs):
        step = s.step * (1 - epoch / s.epochs) + 1e-4
        order = rng.permutation(len(y))
        for at in range(0, len(y), s.batch):
            i, t = order[at : at + s.batch], t + 1
            # Only the rows of a step are spelt out: the driver never holds the whole matrix.
            xb = m.inputs(words[i], dense[i])
            m.bias = float(bias[0])
            g = ((m.score(xb) - y[i]) * weight[i] / len(i)).astype(np.float32)
            sums = xb @ m.factors
            grads = (g.sum(keepdims=True), xb.T @ g + s.decay * m.linear, xb.T @ (g[:, None] * sums) - ((xb * xb).T @ g)[:, None] * m.factors + s.decay * m.factors)
            for p, gr, (a, b) in zip((bias, m.linear, m.factors), grads, state, strict=True):
                a += 0.1 * (gr - a)
                b += 0.001 * (gr * gr - b)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    m.bias = float(bias[0])
    return m


def _features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows, dense = [], []
            for t in texts(b.column("text")):
                w = t.split()
                rows.append(counts(w, buckets))
                dense.append(statistics(t, w))
            sparse = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.float64()), pa.array(sparse, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(rows, sparse, strict=True)], pa.list_(pa.float32())), pa.array(dense, pa.list_(pa.float64())), b.column("meta")], ["y", "at", "x", "dense", "meta"])

    return run


def _meta(columns: list[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: list[str] | None = None, settings: Settings = Settings()) -> Model:
    """Fit on at most ``train_rows`` of ``labels (id, label)``.

    The sample are the rows with the least hash of their id, so it does not
    depend on partitions. Rows with a null id or label are not used, a document
    without a text counts as empty, and no labelled row at all gives a model
    that scores 0.5.
    """
    s = settings
    sample = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(s.train_rows)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _meta(metadata or []).alias("meta"))
    # At most train_rows rows of two numbers: a proven bound.
    rows = slim.join(F.broadcast(sample), "id").select("y", "text", "meta").mapInArrow(_features(s.buckets), "y double, at array<int>, x array<float>, dense array<double>, meta array<double>").toArrow()
    n = rows.num_rows
    at, x = rows["at"].combine_chunks(), rows["x"].combine_chunks()
    ends = np.cumsum([0, *at.value_lengths().to_pylist()])
    words = Sparse(ends, at.flatten().to_numpy(), x.flatten().to_numpy(), s.buckets)
    dense = np.hstack([np.array(rows["dense"].to_pylist(), float).reshape(n, STATISTICS), np.array(rows["meta"].to_pylist(), float).reshape(n, len(metadata or []))])
    y = (rows["y"].to_numpy() > 0.5).astype(np.float32)
    mean = np.bincount(np.repeat(np.arange(n), np.diff(ends)), words.x * words.at.astype(float), n)
    order = np.lexsort((mean, dense[:, 1], dense[:, 0], y)) if n else np.zeros(0, int)
    return fit(words.ordered(order), dense[order], y[order], s)


def _scores(model, metadata: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in sliced(batches):
            out = []
            data = texts(b.column("text"))
            meta = np.array(b.column("meta").to_pylist(), float).reshape(len(data), -1)
            for at in range(0, len(data), 256):
                part = data[at : at + 256]
                words = [t.split() for t in part]
                x = np.stack([counts(w, m.buckets) for w in words])
                dense = np.stack([statistics(t, w) for t, w in zip(part, words, strict=True)])
                out.append(m.score(m.inputs(x, np.hstack([dense, meta[at : at + 256]]))))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), b.column("rest"), pa.array(np.concatenate(out) if out else [], pa.float64())], ["id", "text", "rest", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", metadata: list[str] | None = None, threshold: float = Settings.threshold, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) behind its columns.

    Every row is scored, by its whole text: a null text counts as empty, null
    metadata as 0, repeated rows score alike and keep their number, an empty
    table stays empty. Ids must be integers. Columns of ``docs`` named
    ``score`` or ``predicted`` are replaced. With ``keep_text=False`` the text
    is not returned.
    """
    docs = docs.drop("score", "predicted")
    slim, others = keyed(docs, id_col, text_col)
    slim = slim.withColumn("meta", F.array(*[F.coalesce(F.col(f"rest.c{others.index(c)}").cast("double"), F.lit(0.0)) for c in metadata]) if metadata else F.array().cast("array<double>"))
    rest = slim.schema["rest"].dataType.simpleString()
    if not keep_text:
        run = _scores(docs.sparkSession.sparkContext.broadcast(model), bool(metadata))
        out = slim.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3)], ["id", "rest", "score"]) for b in run(bs)), f"id long, rest {rest}, score double").withColumn("text", F.lit(None).cast("string"))
        columns = [c for c in docs.columns if c != text_col]
    else:
        out = slim.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), bool(metadata)), f"id long, text string, rest {rest}, score double")
        columns = docs.columns
    return unkeyed(out, columns, id_col, text_col, others, {"score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")})


def held_out(id_col: str = "doc_id"):
    """The rows that the contract keeps from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
