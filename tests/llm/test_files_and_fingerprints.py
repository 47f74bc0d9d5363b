"""MinHash, token-ID files and sharding: brute force, round trips, exact counts."""

import io
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from folioscope.llm import minhash, neighbours, registry, sharding, tokenfiles
from tests.llm import brute
from tests.llm.test_pipeline_operators import frame, texts

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = brute.WS_WORD.findall(brute.lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edits(docs):
    """{doc_id: (text, edited text, next text)} by the contract."""
    order = sorted(docs, reverse=True)
    out = {}
    for k, i in enumerate(order):
        t, n = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        out[i] = (t, t[: len(t) - half] + n[:half], n)
    return out


def test_minhash_query(spark):
    docs = {r.doc_id: r.text for r in registry.table(spark, SF, "documents").collect()}
    want = edits(docs)
    rows = registry.op2_minhash(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    errors, scaled, by_text = [], [], {}
    for r in rows:
        text, edited, nxt = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        for got, other in ((r.near_edited, edited), (r.near_next, nxt)):
            j, n = jaccard(text, other), len(shingles(text) | shingles(other))
            errors.append(got - j)
            # Variance of the corrected share of equal bins, of as many bins as have values of their own.
            equal = j + (1 - j) / 16
            filled = 256 * (1 - (1 - 1 / 256) ** n)
            scaled.append(errors[-1] / np.sqrt(equal * (1 - equal) / max(filled, 1) + 1e-9) * (15 / 16) if 0 < equal < 1 else 0.0)
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert by_text.setdefault(t, f) == f and len(f) == (256 if shingles(t) else 0)
    assert abs(np.mean(errors)) < 0.01 and np.mean(np.square(scaled)) < 2


def test_minhash_of_short_texts_and_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A b  c\nd e"), (8, "a b c d f"), (9, "a b c d e")]
    df = minhash.with_fingerprint(frame(spark, rows))
    got = {r.doc_id: tuple(r.fingerprint) for r in df.collect()}
    assert got[1] == got[2] == got[3] == () and got[4] == got[5] and len(got[6]) == 16 and got[7] == got[9] != got[8]
    both = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), minhash.likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("j"))
    j = {(r.x, r.y): r.j for r in both.collect()}
    assert j[1, 2] == 1 and j[1, 4] == 0 and j[7, 9] == 1 and j[7, 8] < 0.2
    assert minhash.with_fingerprint(frame(spark, [])).count() == 0


@pytest.mark.parametrize("likeness", [0.2, 0.5, 0.8, 0.95])
def test_minhash_is_unbiased_on_short_texts(spark, likeness):
    """Most bins are empty here, so this is the densification."""
    r = random.Random(likeness)
    rows = []
    for i in range(300):
        base = [f"w{r.randrange(10**9)}" for _ in range(44)]
        cut = round(40 * 2 * likeness / (1 + likeness))
        rows.append((i, " ".join(base), " ".join(base[: cut + 4] + [f"v{r.randrange(10**9)}" for _ in range(40 - cut)])))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = df.select("id", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("j")).collect()
    e = np.array([x.j - jaccard(rows[x.id][1], rows[x.id][2]) for x in got])
    assert abs(e.mean()) < 0.015 and e.std() < 0.12


def test_minhash_of_texts_of_a_few_shingles(spark):
    """Nearly all bins are empty, so the probes go through several passes."""
    r = random.Random(5)
    rows = []
    for i in range(300):
        a = [f"w{r.randrange(10**9)}" for _ in range(12)]
        rows.append((i, " ".join(a), " ".join(a[:8] + [f"v{r.randrange(10**9)}" for _ in range(4)])))
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = df.select("id", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("j")).collect()
    e = np.array([x.j - jaccard(rows[x.id][1], rows[x.id][2]) for x in got])
    assert abs(e.mean()) < 0.02 and e.std() < 0.07


@pytest.mark.parametrize("bucket_bytes", [40, 400, 1 << 20])
def test_next_row(spark, bucket_bytes):
    r = random.Random(bucket_bytes)
    rows = [(i, f"t{i}") for i in [*r.sample(range(-500, 500), 80), 10**15, -(10**15)]] + [(None, "none"), (7_000, "b"), (7_000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neighbours.with_next(df, "doc_id", ["text"], bucket_bytes).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert sorted((x.doc_id or -1, x.text, x.next.text) for x in got) == sorted((a[0] or -1, a[1], order[(k + 1) % len(order)][1]) for k, a in enumerate(order))
    assert neighbours.with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    one = neighbours.with_next(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", ["text"]).collect()
    assert [x.next.text for x in one] == ["x"]


def test_range_lookup(spark):
    bounds = [3, 7, 8, 20, 21]
    got = spark.range(0, 30).select("id", neighbours._range_of(F.col("id"), bounds).alias("r")).collect()
    assert all(x.r == sum(b <= x.id for b in bounds) for x in got)


def test_token_files_query(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.vocabulary())
    tok.encode_special_tokens = True
    docs = {r.doc_id: r.text for r in registry.table(spark, SF, "documents").collect()}
    rows = {r.doc_id: r for r in registry.op3_token_files(spark, SF).collect()}
    at = 0
    for i in sorted(docs):
        ids = [*tok.encode(docs[i] or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert len(rows) == len(docs)


def test_token_files_of_several_parts(spark, tmp_path):
    rows = texts(70, 3) + [(None, "no id"), (5, "again"), (10**12, "  two  spaces \n and more <|endoftext|> ")]
    df = frame(spark, rows)
    manifest, path = tokenfiles.write(df, registry.vocabulary(), str(tmp_path / "ids"), frame_ids=50, file_bytes=200)
    assert manifest.count() > 2
    got = tokenfiles.read(manifest, path).orderBy("start").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.vocabulary())
    tok.encode_special_tokens = True
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.crc32) == (i, at, len(ids), brute.crc(ids))
        at += len(ids)
    none, path = tokenfiles.write(df.limit(0), registry.vocabulary())
    assert tokenfiles.read(none, path).count() == 0


@pytest.mark.parametrize("known", [3, 40, 10**6])
def test_parts_encode_like_whole_texts(known):
    """With a memory that overflows all the time, and with odd white space and characters."""
    from tokenizers import Tokenizer

    from folioscope.llm.tokens import Encoder

    enc, tok, r = Encoder(registry.vocabulary(), known), Tokenizer.from_file(registry.vocabulary()), random.Random(known)
    tok.encode_special_tokens = True
    bits = ["a", "The", "été,", "Ünder%%%", "naïve_", "ªb", "ends.'", "A&&&!!", "Ààÿþð", "don't", "x\n", "\ny", "1,234", "é", "日本", "\u00a0", "\x1c", "\u2003z", "<|endoftext|>", "", "🙂", "''s", "%%%", "\t", "word's\n\nNew"]
    rows = ["".join(r.choice(bits) + r.choice([" ", " ", "", "\n"]) for _ in range(r.randrange(12))) for _ in range(400)]
    want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in rows]
    assert [enc.encode(t) for t in rows] == want
    assert enc.encode_all(rows) == want


def test_seekable_file():
    r = random.Random(1)
    docs = [(i, np.array([r.randrange(50_000) for _ in range(r.randrange(1, 400))], "<u4").tobytes()) for i in range(60)]
    w = tokenfiles.Writer(frame_ids=300)
    for i, d in docs:
        w.add(i, d)
    data = b"".join(w.finish())
    reader = tokenfiles.Reader(io.BytesIO(data))
    assert len(reader.table) > 5
    for k in r.sample(range(60), 20):
        assert reader.document(k).tobytes() == docs[k][1]
    # Any reader of zstandard sees the ids alone.
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain == b"".join(d for _, d in docs)
    # Only the frame that is asked for is read and checked.
    place = int(reader.places[2]) + 30
    damaged = data[:place] + bytes([data[place] ^ 255]) + data[place + 1 :]
    reader = tokenfiles.Reader(io.BytesIO(damaged))
    assert reader.document(0).tobytes() == docs[0][1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.frame(2)
    with pytest.raises(ValueError):
        tokenfiles.Reader(io.BytesIO(data[:-1] + b"x"))


def test_sharding_query(spark):
    docs = {r.doc_id: r.text or "" for r in registry.table(spark, SF, "documents").collect()}
    rows = registry.op8_sharding(spark, SF).collect()
    assert len(rows) == len(docs)
    import zlib

    slots = {}
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shuffle_is_even_and_edges(spark):
    """Chi-square of first slots over many seeds; null and repeated rows keep their number."""
    df = spark.range(24).select(F.col("id").alias("doc_id"), F.lit(None).cast("int").alias("shard"))
    seen = np.zeros((24, 4))
    for seed in range(60):
        for r in sharding.shuffled(df, ["doc_id"], 4, seed, part_bytes=60).collect():
            seen[r.doc_id, r.shard] += 1
    assert (seen.sum(0) == 360).all()
    assert ((seen - 15) ** 2 / 15).sum() < 72 + 4 * 12
    rows = spark.createDataFrame([(None, "a")] * 5 + [(1, None)] * 6, "doc_id long, text string")
    got = sharding.shuffled(rows, ["doc_id", "text"], 3, part_bytes=20).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)]
    assert sharding.shuffled(rows.limit(0), ["doc_id"], 3).count() == 0


def test_hypergeometric_law():
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 30, 50, 20) for _ in range(6000)]
    assert abs(np.mean(draws) - 20 * 30 / 80) < 0.08
    assert abs(np.var(draws) - 20 * 30 / 80 * 50 / 80 * 60 / 79) < 0.25
    assert min(draws) >= 0 and max(draws) <= 20
    big = sharding.hypergeometric(rng, 10**10, 15 * 10**10, 10**7)
    assert abs(big - 10**7 / 16) < 10 * (10**7 / 16) ** 0.5
    m = sharding.matrix([7, 0, 12, 5], [8, 8, 8], 3)
    assert [sum(r) for r in m] == [7, 0, 12, 5] and [sum(c) for c in zip(*m, strict=True)] == [8, 8, 8]
