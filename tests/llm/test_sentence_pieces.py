"""Pieces equal those of the library, ids and texts, for whole and odd texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import pieces, registry

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "▁", " ▁ \n", "x  y   z", " lead and trail ", "<s> </s> <unk> <0x0A>", "a\0b", "漢字かな交じり文", "नमस्ते दुनिया", "😀é́ﬁ", "a" * 5000, " " * 700 + "b", "q\n" * 900, "aHR0cHM6Ly9leGFtcGxlLm9yZw==" * 200]


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(list(" ▁\n\t.,abehinorst019éß漢अ😀\0")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    m, lib = pieces.pieces(PATH), LIBRARY
    got = ids(m, text)
    assert got == lib.encode(text) and m.decode(got) == lib.decode(got)


def test_pieces_behind_each_other(model, library):
    """Texts of pieces have many ways to be cut: these make the search go back."""
    rng, names = random.Random(3), list(model.id)
    for k in range(4000):
        text = "".join(rng.choice(names) for _ in range(rng.randrange(1, 9))).replace("▁", " " if k % 2 else "")
        assert ids(model, text) == library.encode(text)


def test_compatibility_is_remerging(model):
    rng, names = random.Random(4), list(model.usable)
    for _ in range(20000):
        p = rng.choice(names)
        cut = rng.randrange(len(p) + 1)
        a, b = (p[:cut], p[cut:]) if rng.random() < 0.4 else (p, rng.choice(names))
        if a in model.usable and b in model.usable:
            assert model.compatible(model.usable[a], model.usable[b]) == (model.merged(a + b) == [a, b])


def test_any_ids_are_decoded(model, library):
    rng = random.Random(5)
    for _ in range(5000):
        some = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), model.id["▁"], model.id["▁▁"]]) for _ in range(rng.randrange(9))]
        assert model.decode(some) == library.decode(some)


def test_places_are_not_tried_twice(model, library):
    """A long text without a space takes time in proportion to its length."""
    text = "".join(random.Random(6).choice("aehinorstw漢字") for _ in range(60000))
    assert ids(model, text) == library.encode(text)


def test_memory_is_bounded_by_bytes(library):
    m = pieces.Pieces(PATH, known_bytes=1 << 20)
    rng = random.Random(7)
    for _ in range(40):
        text = " ".join("".join(rng.choice("漢字文書翻訳学習") for _ in range(rng.choice([3, 9, 400]))) for _ in range(300))
        assert ids(m, text) == library.encode(text)
    assert m.words.size <= 1 << 19 and max(map(len, [*m.words.new, *m.words.old])) <= pieces.LONGEST


def test_odd_rows(spark, library):
    df = spark.createDataFrame([(i if i % 5 else None, t, f"e{i}", [i]) for i, t in enumerate(ODD + ODD[:3])], "doc_id long, text string, ids string, decoded array<int>")
    out = pieces.decoded(pieces.encoded(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(out.collect(), key=repr)
    want = sorted([(i if i % 5 else None, t, library.encode(t or "") + [2], library.decode(library.encode(t or "") + [2])) for i, t in enumerate(ODD + ODD[:3])], key=repr)
    assert sorted(map(tuple, got), key=repr) == want
    assert pieces.encoded(df.limit(0), PATH).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, []), (3, [None, 2])], "row int, ids array<int>")
    assert [r["decoded"] for r in pieces.decoded(nothing, PATH).orderBy("row").collect()] == ["", "", ""]


def test_query_equals_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in registry.table(spark, sf, "documents").collect():
        x = [*library.encode(r["text"] or ""), 2]
        want[r["doc_id"]] = (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest())
    out = registry.op12_sentencepiece(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
