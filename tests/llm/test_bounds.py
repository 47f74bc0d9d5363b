"""What is bounded by bytes, ids of 64 bits, long texts that are compared, and thresholds."""

import random
import resource
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import neighbours, registry, resemblance, simhash, tokens

_GROWS = """
import random, resource, numpy as np
from tokenizers import Tokenizer
from folioscope.llm import registry
from folioscope.llm.tokens import Encoder
enc, r = Encoder(registry.vocabulary(), 700_000), random.Random(1)
enc.encode_all(["some words to begin with"] * 10)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
cjk, b64 = [chr(0x4E00 + i) for i in range(6000)], "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
done = 0
for k in range(60):
    parts = ["".join(r.choices(cjk if i % 2 else b64, k=r.choice([30, 400, 4000]))) for i in range(120)]
    enc.encode_all([" ".join(parts)])
    done += sum(len(p.encode()) for p in parts)
print(done >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10, enc.size >> 20, max(map(len, [*enc.known, *enc.older])))
"""


def test_unspaced_text_is_not_remembered():
    """Parts of hundreds of characters are encoded where they are: memory does not follow them."""
    out = subprocess.run([sys.executable, "-c", _GROWS], capture_output=True, text=True, check=True).stdout.split()
    done, grown, size, longest = map(int, out)
    assert done > 10 and grown < 200 and size < 20 and longest <= tokens.LONGEST


def test_generations_close_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 20_000)
    enc, tok, r = tokens.Encoder(registry.vocabulary()), Tokenizer.from_file(registry.vocabulary()), random.Random(2)
    tok.encode_special_tokens = True
    for _ in range(60):
        text = r.choice(["", "x" * 90 + "\n"]) + r.choice([" ", "\n"]).join("".join(r.choices("abcß漢.,'1", k=r.choice([1, 4, 70]))) for _ in range(60))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert enc.size <= 20_000 + 60 * 400 and len(enc.first) == 0 or all(len(x) <= tokens.LONGEST for x in enc.first)


def test_as_many_ranges_for_hashed_ids(spark):
    small = spark.range(40_000).select(F.col("id").alias("key"))
    hashed = small.select(F.xxhash64("key").alias("key"))
    edges = spark.createDataFrame([(-(1 << 63),), ((1 << 63) - 1,), ((1 << 63) - 2,), (0,)], "key long")
    assert len(neighbours._bounds(small, 50)) == 50
    for df in (hashed, hashed.union(edges)):
        bounds = neighbours._bounds(df, 50)
        there = {r["key"] for r in df.collect()}
        assert len(bounds) >= 48 and bounds == sorted(set(bounds)) and set(bounds) <= there and bounds[-1] == max(there)
    assert neighbours._bounds(small.limit(0), 50) == [] and neighbours._bounds(small, 1) == [39_999]
    rows = hashed.limit(3000).select(F.col("key").alias("id"), (F.col("key") % 97).alias("x"))
    got = {r["id"]: r["next"]["id"] for r in neighbours.with_next(rows, "id", ["x"], bucket_bytes=1 << 10).collect()}
    ids = sorted((r["id"] for r in rows.collect()), reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def plain_alike(sets, threshold):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= threshold:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


@pytest.mark.parametrize("threshold", [0.8, 0.9, 1.0])
def test_alike_equals_all_pairs(threshold):
    r = np.random.default_rng(int(10 * threshold))
    for _ in range(25):
        base = [np.unique(r.integers(0, 400, r.integers(1, 60))) for _ in range(6)]
        sets = []
        for _ in range(40):
            s = set(base[r.integers(0, 6)].tolist())
            for _ in range(r.integers(0, 8)):
                (s.add if r.random() < 0.5 else s.discard)(int(r.integers(0, 400)))
            sets.append(np.array(sorted(s or {1}), np.uint64))
        assert resemblance.alike(sets, threshold).tolist() == plain_alike(sets, threshold)
    assert resemblance.alike([], threshold).tolist() == []


def test_long_texts_of_one_group():
    """Time and memory follow the shingles, not the square of the texts."""
    r = np.random.default_rng(5)
    common = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, r.integers(0, 1 << 62, 17_000).astype(np.uint64)])) for _ in range(100)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert resemblance.alike(sets, 0.8).tolist() == list(range(100))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600 << 10


def test_low_thresholds_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for bad in (0.3, 0.79, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            simhash.representatives(df, similarity=bad)
