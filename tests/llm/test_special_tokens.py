"""Strings of special tokens, by the library's own call; and packing without a limit of segments."""

from folioscope.llm import packing, registry, tokenfiles
from tests.llm import brute
from tests.llm.test_pipeline_operators import frame


def test_special_tokens_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.vocabulary())
    docs = [(1, "end of one <|endoftext|> next doc"), (2, "<|endoftext|>"), (3, "plain words"), (4, "<|endoftext"), (5, None), (6, "a<|endoftext|><|endoftext|>b\n c")]
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in docs}
    assert len(ids[1]) == 7
    manifest, path = tokenfiles.write(frame(spark, docs).repartition(3), registry.vocabulary(), special=True)
    assert {r.doc_id: (r.n_tokens, r.crc32) for r in tokenfiles.read(manifest, path).collect()} == {i: (len(x) + 1, brute.crc([*x, 2])) for i, x in ids.items()}
    pieces = packing.packed(frame(spark, docs), registry.vocabulary(), cuts=True, special=True).collect()
    assert {p.doc_id: (p.doc_tokens, p.crc32) for p in pieces} == {i: (len(x) + 1, brute.crc([*x, 1])) for i, x in ids.items()}


def test_short_documents_leave_little_padding(spark):
    """4096 documents of one token fill two sequences where the segments have no limit."""
    docs = spark.range(4096).selectExpr("id as doc_id", "'' as text").coalesce(1)
    pieces = packing.packed(docs, registry.vocabulary(), limits=packing.Limits(segments=2048), cuts=True).collect()
    assert len({p.sequence_id for p in pieces}) == 2
    pieces = packing.packed(docs, registry.vocabulary(), cuts=True).collect()
    assert len({p.sequence_id for p in pieces}) == 32


def test_positions_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "GROUP", 3)
    files = spark.createDataFrame([(i, f"f{i}", 10 + i, 1) for i in range(11) if i != 4], "part int, file string, n_tokens long, n_docs long")
    rows = tokenfiles._started(files).orderBy("part").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
