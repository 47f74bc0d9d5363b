"""Column expressions against plain Python restatements of their rules: golden cases and random ones."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import answer as a
from folioscope.functions import text as t
from folioscope.functions import vector as v
from folioscope.operators import chunking, models

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def one(spark, rows, schema, **columns):
    out = spark.createDataFrame(rows, schema).select("*", *[c.alias(k) for k, c in columns.items()])
    return [r.asDict(recursive=True) for r in out.collect()]


def model_sentences(text):
    return [{"s": m.start(), "e": m.end(), "x": m.group().strip()} for m in re.finditer(f"[^{t.TERMINATORS}]+[{t.TERMINATORS}]?", text) if m.group().strip()]


def model_anchor(spans, start, end):
    if not spans:
        return -1
    for i, x in enumerate(spans):
        if x["s"] <= start and end <= x["e"]:
            return i
    for i, x in enumerate(spans):
        if x["s"] <= start < x["e"]:
            return i
    return 0


def model_paragraph(text, start, end, limit=140):
    text = " ".join((text or "").split())
    spans = model_sentences(text)
    if not spans:
        return text
    n = [len(x["x"].split()) for x in spans]
    lo = hi = model_anchor(spans, start, end)
    total = n[lo]
    while total < limit:
        moved = False
        if lo > 0 and (total + n[lo - 1] <= limit or total < 0.6 * limit):
            lo, total, moved = lo - 1, total + n[lo - 1], True
        if hi < len(n) - 1 and (total + n[hi + 1] <= limit or total < 0.8 * limit):
            hi, total, moved = hi + 1, total + n[hi + 1], True
        if not moved:
            break
    return " ".join(x["x"] for x in spans[lo : hi + 1])


def model_metadata(path):
    base = os.path.basename(path)
    stem = os.path.splitext(base)[0]
    title, author, department = stem, None, None
    year = re.search("(19|20)[0-9]{2}", stem)
    h = [p.strip() for p in stem.split("-") if p.strip()]
    u = [p.strip() for p in stem.split("_") if p.strip()]
    if len(h) >= 2:
        title, author = h[:2]
    elif len(u) >= 2:
        department, title = u[0], " ".join(u[1:])
    return {"title": title or base, "author": author, "publication_year": int(year[0]) if year else None, "department": department}


def test_sanitise_and_white_space(spark):
    assert len(SPACES) == 29
    rows = [(i, f"a{c}b") for i, c in enumerate(SPACES)] + [(100, "a\0b\0"), (101, ""), (102, None), (103, f"{SPACES[5]} x  y\n"), (104, "a​b")]
    got = {r["i"]: r for r in one(spark, rows, "i int, x string", n=t.normalise(F.col("x")), s=t.sanitise(F.col("x")))}
    assert all(got[i]["n"] == "a b" for i in range(29))
    assert got[100]["s"] == "ab" and got[101]["n"] == "" and got[102]["n"] is None and got[103]["n"] == "x y" and got[104]["n"] == "a​b"


@pytest.mark.parametrize("n,count", [(0, 0), (1, 1), (49, 1), (50, 1), (250, 1), (251, 2), (300, 2), (301, 2), (550, 3), (1000, 4)])
def test_chunk_counts(spark, n, count):
    words = [f"w{i}" for i in range(n)]
    got = one(spark, [(" ".join(words),)], "x string", c=t.chunks(F.col("x"), 300, 50))[0]["c"]
    assert got == [" ".join(words[i : i + 300]) for i in range(0, n, 250)] and len(got) == count


def test_chunk_settings(spark):
    got = one(spark, [("a b c",)], "x string", c=t.chunks(F.col("x"), 2, 5), d=t.chunks(F.lit(None).cast("string"), 2, 1))[0]
    assert got["c"] == ["a b", "b c", "c"] and got["d"] == []
    with pytest.raises(ValueError):
        t.chunks(F.col("x"), 0, 0)


def test_page_chunks_number_a_book_through(spark):
    rows = [("b", 2, " ".join("abcdefg")), ("b", 1, "x y z"), ("b", 5, "q"), ("c", 1, " \n ")]
    pages = chunking.clean_pages(spark.createDataFrame(rows, "path string, page_number int, text string"))
    got = chunking.page_chunks(pages, 3, 1).orderBy("path", "chunk_index").collect()
    assert [(r.page_number, r.chunk_index, r.chunk_text) for r in got] == [(1, 0, "x y z"), (1, 1, "z"), (2, 2, "a b c"), (2, 3, "c d e"), (2, 4, "e f g"), (2, 5, "g"), (5, 6, "q")]


GOLDEN = {
    "A - B - 2020.pdf": ("A", "B", 2020, None),
    "/x/Dept_Title_2021.pdf": ("Title 2021", None, 2021, "Dept"),
    "Self-Study_2020.pdf": ("Self", "Study_2020", 2020, None),
    "12019.pdf": ("12019", None, 2019, None),
    ".pdf": (".pdf", None, None, None),
    "Physics-2020.PDF": ("Physics", "2020", 2020, None),
}


def test_file_metadata(spark):
    r = random.Random(1)
    bits = ["A", "b c", "-", "--", "_", " ", "1999", "20", "24", ".", "..", "कख", "é", "x-y", "2"]
    rows = [(k,) for k in GOLDEN] + [("/d/" * r.randrange(2) + "".join(r.choice(bits) for _ in range(r.randrange(8))) + r.choice([".pdf", ".PDF", ""]),) for _ in range(1500)]
    for x in one(spark, rows, "p string", m=t.file_metadata(F.col("p"))):
        assert x["m"] == model_metadata(x["p"]), x["p"]
        if x["p"] in GOLDEN:
            assert tuple(x["m"].values()) == GOLDEN[x["p"]]


def random_texts(n, seed):
    r = random.Random(seed)
    bits = ["a", "bb ccc", " ", ".", "!", "?", "।", "！", "。", "3.14", "...", "🙂", "क", "\n", "  x"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(n)]


def test_sentences(spark):
    golden = {"...": [], "x... y": ["x.", "y"], "3.14 is pi. ok": ["3.", "14 is pi.", "ok"], "क।ख": ["क।", "ख"], "a。b": ["a。b"]}
    rows = [(x,) for x in [*golden, *random_texts(1500, 2)]]
    for x in one(spark, rows, "x string", s=t.sentences(F.col("x"))):
        assert x["s"] == model_sentences(x["x"]), x["x"]
        if x["x"] in golden:
            assert [s["x"] for s in x["s"]] == golden[x["x"]]


def test_anchor_sentence_and_paragraph(spark):
    r = random.Random(3)
    rows = [(x, r.randrange(-1, 30), r.randrange(-1, 40)) for x in random_texts(700, 4)] + [(None, 0, 0), ("", -1, -1), ("...", 1, 2), ("One. Two words. Three.", 2, 8)]
    for _ in range(300):
        words = " ".join(" ".join(["w"] * r.choice([1, 3, 20, 60, 90, 150])) + r.choice(".!?") for _ in range(r.randrange(1, 12)))
        at = r.randrange(len(words))
        rows.append((words, at, at + r.randrange(9)))
    got = one(spark, rows, "x string, s int, e int", c=a.complete_sentence(F.col("x"), F.col("s"), F.col("e")), p=a.matched_paragraph(F.col("x"), F.col("s"), F.col("e")), small=a.matched_paragraph(F.col("x"), F.col("s"), F.col("e"), 5))
    for x in got:
        text = " ".join((x["x"] or "").split())
        spans = model_sentences(text)
        i = model_anchor(spans, x["s"], x["e"])
        want = {"sentence": spans[i]["x"], "start": spans[i]["s"], "end": spans[i]["e"]} if spans else {"sentence": text, "start": 0 if text else -1, "end": len(text) if text else -1}
        assert x["c"] == want
        assert x["p"] == model_paragraph(x["x"], x["s"], x["e"]) and x["small"] == model_paragraph(x["x"], x["s"], x["e"], 5)
    assert got[703]["c"]["sentence"] == "One."


def test_quote(spark):
    got = one(spark, [("s", "a"), ("", "a"), (None, "a")], "x string, y string", q=a.quote(F.col("x"), F.col("y")))
    assert [x["q"] for x in got] == ["s", "a", "a"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 0.0])]
    got = one(spark, rows, "a array<float>, b array<float>", d=v.dot(F.col("a"), F.col("b")), n=v.norm(F.col("a")), u=v.normalised(F.col("a")))[0]
    assert (got["d"], got["n"]) == (3.0, 5.0) and got["u"] == pytest.approx([0.6, 0.8])
    for bad in (v.normalised(F.array(F.lit(0.0))), v.checked(F.array(F.lit(0.0)), 2)):
        with pytest.raises(Exception, match="zero vector|expected 2"):
            spark.range(1).select(bad).collect()


def test_lexical_answer_equals_its_expression(spark):
    r = random.Random(6)
    words = ["the", "The", "of", "longer", "Longest", "x", "é", "🙂of"]
    rows = [(" ".join(r.choice(words) for _ in range(r.randrange(4))), r.choice([" ", "  ", "\n"]).join(r.choice(words) for _ in range(r.randrange(9)))) for _ in range(300)]
    plain = models.LexicalAnswerer()
    for x in one(spark, rows, "q string, c string", qa=models.lexical_answer(F.col("q"), F.col("c"))):
        want = plain.answer(x["q"], x["c"])
        assert (x["qa"]["answer"], x["qa"]["start"], x["qa"]["end"]) == (want["answer"], want["start"], want["end"]) and x["qa"]["score"] == pytest.approx(want["score"])
        assert x["c"][want["start"] : want["end"]] == want["answer"] or want["start"] == -1


def test_logits_answerer_and_coercion():
    run = models.LogitsAnswerer(lambda q, c: ([None, (0, 3), (4, 7), (8, 11)], [9, 0.0, 2.0, 1.0], [9, 5.0, 0.0, 1.0]))
    got = run.answer("q", "one two six")
    assert (got["answer"], got["start"], got["end"]) == ("two six", 4, 11) and got["score"] == pytest.approx(0.8808 * 0.7311, abs=1e-3)
    assert models.LogitsAnswerer(lambda q, c: ([None], [1], [1])).answer("q", "c") == {"answer": "", "score": 0.0, "start": -1, "end": -1}
    assert models.coerced({}) == ("", 0.0, -1, -1) and models.coerced({"answer": "a", "score": None, "start": 2, "end": 3}) == ("a", 0.0, 2, 3)
