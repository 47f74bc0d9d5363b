"""Words that a worker does not know are merged together, with the ids that each has alone and by the library."""

import random

import numpy as np
import pyarrow as pa
import sentencepiece

from folioscope.llm import pieces, registry

MODEL = registry.vocabulary("piece_bpe_32k.model")
SYLLABLES = ["th", "er", "on", "an", "sch", "ü", "ß", "ing", "re", "Ab", "9", ".", ",", "aaa", "日本", "\U0001f600", "́", "▁", "é"]


def rows(n=400, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 9)))
    out = [None, "", " ", "\n", " \n", "\n ", "\0", "a\0b", "\uffff", "a\uffffb", "a \uffffb\nc", "\uffff\n\uffff", "▁", "a▁▁b", "one\n\ntwo \nthree\n four", "x" * 200, "a\n" + "er" * 90 + "\nü" + "\U0001f600" * 70, "\n" + "th" * 40, "tab\tand\r\nreturn", "  two", "two  ", "日\n本"]
    while len(out) < n:
        text = "".join(word() + r.choice([" ", " ", " ", " ", "\n", " \n", "  " if r.random() < 0.1 else " "]) for _ in range(r.randrange(0, 60)))
        out.append(text if r.random() < 0.3 else text.strip())
    return out


def of(model, texts, last=b""):
    at, values = model.encode_all(pa.array(texts, pa.string()), last)
    assert len(at) == len(texts) + 1 and at[0] == 0 and at[-1] == len(values)
    return [values[a:z].tolist() for a, z in zip(at, at[1:])]


def test_all_at_once_as_one_by_one_and_by_the_library():
    library, texts = sentencepiece.SentencePieceProcessor(model_file=MODEL), rows()
    want = [library.encode(t or "") for t in texts]
    small = pieces.Pieces(MODEL, known_bytes=4000)
    for model in (pieces.Pieces(MODEL), small):
        for step in (1, 7, len(texts)):
            got = [x for a in range(0, len(texts), step) for x in of(model, texts[a : a + step], np.array([2], "<i4").tobytes())]
            assert got == [[*w, 2] for w in want]
        assert [np.frombuffer(model.encode(t or ""), "<i4").tolist() for t in texts] == want
    assert small.words.size <= 2000
    assert of(pieces.Pieces(MODEL), texts[:3]) == want[:3] and of(pieces.Pieces(MODEL), []) == []


def test_equal_scores_go_from_the_left():
    model = pieces.Pieces(MODEL)
    some = [model.names[i].replace(pieces.SPACE, "") * k + x for i in sorted(model.tied) for k in (1, 2, 3) for x in ("", "e", "th")]
    some = sorted({w for w in some if w})
    assert model._together(some) == [model._part(pieces.SPACE + w) for w in some]


def test_new_words_are_not_placed_one_by_one(monkeypatch):
    placed, calls = pieces.Pieces.placed, []
    monkeypatch.setattr(pieces.Pieces, "placed", lambda self, text: calls.append(text) or placed(self, text))
    r = random.Random(1)
    text = " ".join("".join(r.choice("aeinrstdhl") for _ in range(9)) for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([None], pa.null())], ["id", "text", "rest"])
    pieces.pieces.cache_clear()
    (out,) = pieces._encodes(MODEL, True, False)(iter([batch]))
    assert len(out.column("ids")[0]) > 5000 and len(calls) < 50
