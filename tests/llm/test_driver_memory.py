"""The driver fits the quality model without the whole matrix of its rows."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import quality


def test_rows_by_their_places_fit_as_whole_ones():
    r = np.random.default_rng(3)
    words = (r.random((40, 6)) * (r.random((40, 6)) < 0.4)).astype(np.float32)
    words[7] = 0
    dense, y, order = r.normal(size=(40, 2)), (r.random(40) < 0.5).astype(np.float32), r.permutation(40)
    at = [np.flatnonzero(w) for w in words]
    rows = quality.Sparse(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate([w[i] for w, i in zip(words, at, strict=True)]), 6)
    assert np.array_equal(rows[np.arange(40)], words) and np.array_equal(rows.ordered(order)[np.array([2, 2, 0])], words[order[[2, 2, 0]]])
    s = quality.Settings(buckets=6, rank=2, epochs=3, batch=7)
    a, b = quality.fit(words[order], dense[order], y[order], s), quality.fit(rows.ordered(order), dense[order], y[order], s)
    assert a.bias == b.bias and np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


def test_training_holds_a_part_of_the_matrix(spark):
    n, s = 3000, quality.Settings(epochs=1)
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    tracemalloc.start()
    quality.train(docs, labels, settings=s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * s.buckets * 4 / 2
