"""The pipeline stage by stage against brute force, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline as pipeline
from folioscope.llm import quality, registry
from tests.llm import brute
from tests.llm.test_pipeline_operators import pieces_hold
from tests.llm.test_resemblance import groups

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def words(text):
    return brute.WS_WORD.findall(text)


def test_stages(spark, tmp_path):
    docs, seen = registry.table(spark, SF, "documents"), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == pipeline.COLUMNS
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
    raw = texts_of(registry.table(spark, SF, "documents"))
    graded, single, cut, clean = map(texts_of, seen[:4])

    model = quality.train(registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels").where(~quality.held_out()), metadata=registry.METADATA)
    scored = quality.score(registry.table(spark, SF, "documents"), model, metadata=registry.METADATA)
    assert graded == {r.doc_id: raw[r.doc_id] for r in scored.where("predicted = 1").collect()}
    labels = {r.doc_id: r.quality for r in registry.table(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in graded for i in good) / len(good) > 0.95

    # Near copies: five words, 0.8 or more, over all pairs.
    names, _ = groups(list(graded.items()))
    assert single == {i: t for i, t in graded.items() if names[i] == i} and len(single) < len(graded)

    want = brute.substring(single.items())
    assert set(cut) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    assert all(brute.sha(" ".join(words(t))) == want[i][2] for i, t in cut.items())
    assert all(cut[i] == single[i] for i in cut if not want[i][1]) and any(gone for _, gone, _ in want.values())

    items = [(r.item_id, r.text) for r in registry.table(spark, SF, "benchmark").collect()]
    want = brute.decontaminate(cut.items(), items)
    assert set(clean) == {i for i, (n, hit, *_) in want.items() if not hit or hit < n}
    assert all(len(brute.AN_WORD.findall(brute.lower(clean[i]))) == want[i][0] - want[i][1] for i in clean)
    assert all(clean[i] == cut[i] for i in clean if not want[i][1]) and any(x[4] for x in want.values())
    for r in seen[3].collect():
        assert r.n_chars == len(r.text)

    assert pieces_hold(seen[4].collect(), list(clean.items())) < 0.02
    assert pieces_hold(pipeline.run(spark, SF).collect(), list(clean.items())) < 0.02


def test_stages_take_empty_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a few words of text", "en", "s", 19), (2, "a few words of text", "en", "s", 19)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES:
            stage(spark, df, str(tmp_path)).collect()
