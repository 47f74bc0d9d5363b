"""Rows decide which near copy stays; large groups go block by block; segments by the number of fingerprints."""

import numpy as np

from folioscope.llm import common, resemblance, simhash
from tests.llm import brute
from tests.llm.test_resemblance import groups, near_copies


def test_texts_under_one_id_stay(spark):
    rows = [(5, "some words of one text here"), (5, "quite other words of another one"), (6, "some words of one text here"), (6, "some words of one text here"), (None, "lone words"), (None, "lone words"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "fp")
    got = simhash.representatives(df, text_col="fp").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[1], (None, "lone words"), (7, None)], key=repr)


def test_blocks_of_a_large_group(spark):
    rows = near_copies()
    names, _ = groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for more in ({"block": 3}, {"search": lambda d: simhash.links(d)}):
        assert sorted(x.doc_id for x in resemblance.representatives(df, **more).collect()) == sorted(set(names.values()))


def test_segments_follow_the_number_of_fingerprints():
    assert [simhash.segments_for(n, 4) for n in (10, 300_000, 20_000_000, 20_000_000_000)] == [5, 5, 3, 2]


def test_long_runs_over_batches():
    """Members of one value that come in several batches, dense and loose ones."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 4).astype(np.uint64)
    near = [c ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for c in centre for i in range(40) for j in range(20)]
    fp = np.unique(np.concatenate([np.array(near, np.uint64), r.integers(0, 1 << 63, 700).astype(np.uint64)]))
    r.shuffle(fp)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), 7)), pa.array(x.view(np.int64))], ["key", "fp"]) for x in np.array_split(fp, 5)]
    found = [(u, v) for b in simhash._links(4)(iter(batches)) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True)]
    signed = fp.view(np.int64).tolist()
    want = [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 4]
    assert brute.groups(signed, found) == brute.groups(signed, want) and len(found) < 4 * len(fp)


def test_join_with_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(None, i) for i in range(900)] + [(i, i) for i in range(2, 60)], "k long, x int")
    right = left.where("k < 50").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 as y")
    inner = common.hot_join(left, right, "k")
    assert inner.columns == ["k", "x", "y"] and inner.count() == 3000 + 48 and inner.where("y <> 2 * k").count() == 0
    outer = common.hot_join(left, right, "k", how="left")
    assert outer.count() == left.count() and outer.where("y is null").count() == 900 + 10
    assert common.hot_join(left, right.limit(0), "k", how="left").count() == left.count()


def test_sizes_of_pruned_and_joined_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    whole = common.input_bytes(docs)
    assert common.input_bytes(docs.select("doc_id", "text")) == whole
    assert whole < common.input_bytes(docs.join(labels, "doc_id")) < 2 * whole
    assert common.bucket_count(docs, 1, 500) == 500
