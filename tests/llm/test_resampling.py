"""Importance resampling against a plain version, with chunks of a few bytes."""

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from folioscope.llm import registry, resample

from tests.llm.brute import AN_WORD, lower


def plain(docs, target, percent=5, least=20, buckets=10_000):
    """[(id, n_words, n_features, weight, score, rank)] of [(id, text)]."""

    def feats(text):
        w = AN_WORD.findall(lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = [(i, *feats(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted([(*r, place.get(id(r))) for r in out], key=repr)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [*"a b c one Two the of and größe 漢字 naïve x1".split(), "w" * 48, "w" * 49, "v" * 90]
    sep = [" ", "  ", ", ", "\n", "-"]
    return ["".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.choice([0, 3, 19, 20, 60, 400]))) for _ in range(n)]


ADDED = ["n_words", "n_features", "weight", "score", "rank"]


@pytest.mark.parametrize("chunk", [1 << 16, 50, 7])
def test_equals_plain(spark, chunk):
    docs = list(enumerate(texts(120))) + [(None, "the of and " * 20), (200, None), (201, ""), (202, "--- !"), (203, "x" * 3000), (5, "one Two " * 40)]
    target = texts(9, 2) + [None, ""]
    df = spark.createDataFrame([(i, t, i, "s") for i, t in docs], "doc_id long, text string, weight long, row string").repartition(3)
    out = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), chunk=chunk)
    assert out.columns == ["doc_id", "text", "row", *ADDED]
    rows = out.collect()
    want = plain(docs, target)
    assert sorted([(r["doc_id"], *(r[c] for c in ADDED)) for r in rows], key=repr) == want
    assert sum(r[5] is not None for r in want) >= 2
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None and r["text"] is not None) == sorted((i, t) for i, t in docs if i is not None and t is not None)


def test_ties_and_repeated_rows(spark):
    """Rows of one id have one score: as many are drawn as have a place."""
    docs = [(7, "one two three " * 10)] * 70 + [(i, f"other words {i} " * 8) for i in range(100, 130)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = resample.resampled(df, spark.createDataFrame([("one two three " * 5000,)], "text string"), keep_text=False)
    assert out.columns == ["doc_id", *ADDED]
    rows = sorted((r["rank"], r["doc_id"]) for r in out.collect() if r["rank"] is not None)
    assert rows == [(k, 7) for k in range(1, 6)]


def test_empty_tables(spark):
    df = spark.createDataFrame([(i, "some words " * 15) for i in range(20)], "doc_id long, text string")
    none = df.limit(0)
    assert resample.resampled(none, df).count() == 0
    rows = resample.resampled(df, none.select("text")).collect()
    assert sorted([(r["doc_id"], *(r[c] for c in ADDED)) for r in rows], key=repr) == plain([(i, "some words " * 15) for i in range(20)], [])


def test_chunks_own_what_starts_in_them():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab é,") for _ in range(rng.randrange(120))).encode()
        whole = resample.words_of(text)
        parts = list(resample.chunks(text, rng.randrange(1, 40), 2))
        owned = [w for words, carried in parts for w in words.split()[: len(words.split()) - carried]]
        assert owned == whole
        for (_, carried), (after, _) in zip(parts, parts[1:]):
            assert carried <= 2 and after[:1] != b" "
        at = 0
        for words, carried in parts:
            at += len(words.split()) - carried
            assert words.split()[len(words.split()) - carried :] == whole[at : at + 2][:carried] and carried == min(2, len(whole) - at)


def test_checksums_of_runs():
    words = [b"a", b"", b"x" * 47, b"y" * 48, b"z" * 49, b"q" * 200, "漢".encode(), b"b"]
    words = [w or b"c" for w in words]
    got = {int(p): int(b) for b, p in zip(*list(resample.features(words, np.array([len(words)])))[2], strict=True)}
    assert got == {i: zlib.crc32(b" ".join(words[i : i + 3])) % 10_000 for i in range(len(words) - 2)}


def test_query_equals_sql_on_odd_texts(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate([None, "", "Ünï Cödé " * 12, *texts(60, 4)])]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(texts(5, 5))], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()["op11_resampling"])
    names = [d[0] for d in found.description]
    got = registry.op11_resampling(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)
