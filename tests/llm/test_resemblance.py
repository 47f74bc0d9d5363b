"""Near copies by resemblance against all pairs."""

import random

import corpus_pipeline as pipeline
from folioscope.llm import registry, resemblance
from tests.llm import brute
from tests.llm.test_files_and_fingerprints import jaccard, shingles


def near_copies():
    """Texts with copies of them that differ by a few words, some below and some above 0.8."""
    r = random.Random(11)
    rows = []
    for _ in range(40):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30, 300))]
        for changes in (0, 0, 1, 2, 4, 6, 9):
            w = list(base)
            for _ in range(changes):
                w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    return [*rows, (900, ""), (901, None), (902, "One two"), (903, "one  two")]


def groups(rows):
    sets = {i: shingles(t or "") for i, t in rows}
    ids = list(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(x := sets[a] | sets[b]) == 0 or len(sets[a] & sets[b]) / len(x) >= 0.8]
    return brute.groups(ids, linked), linked


def test_stage_against_all_pairs(spark):
    rows = near_copies()
    names, linked = groups(rows)
    text = dict(rows)
    wide = [(a, b) for a, b in linked if (brute.simhash_of(text[a]) ^ brute.simhash_of(text[b])).bit_count() > 4]
    assert len(wide) > 50
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_duplicate_stage(spark, df.repartition(5), "").collect()
    assert sorted(x.doc_id for x in got) == sorted(set(names.values()))


def test_recall_on_a_table(spark):
    docs = registry.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    owners = {}
    for i, t in rows:
        for s in shingles(t or ""):
            owners.setdefault(s, set()).add(i)
    text = dict(rows)
    pairs = {(a, b) for x in owners.values() if len(x) > 1 for a in x for b in x if a < b}
    names = brute.groups(list(text), [(a, b) for a, b in pairs if jaccard(text[a], text[b]) >= 0.8])
    got = resemblance.representatives(docs).collect()
    assert sorted(x.doc_id for x in got) == sorted(set(names.values()))


def test_rows_decide(spark):
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (2, one), (2, other), (2, other), (None, one), (None, "lone words"), (None, "lone words")]
    got = resemblance.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, one), (2, other), (None, "lone words")], key=repr)
    assert resemblance.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
