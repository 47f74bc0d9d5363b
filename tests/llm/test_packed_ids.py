"""The token ids of packed sequences."""

import corpus_pipeline as pipeline
import numpy as np
from folioscope.llm import packing, registry
from tests.llm.test_pipeline_operators import frame, texts


def hold(pieces, docs):
    """The ids of all sequences, put together by document, are those of the texts."""
    from tokenizers import Tokenizer

    tok, own, sequences = Tokenizer.from_file(registry.vocabulary()), {}, {}
    for p in sorted(pieces, key=lambda p: p.offset):
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        whole = np.frombuffer(b"".join(bytes(p.ids) for p in s), "<u4")
        assert len(whole) == s[-1].offset + s[-1].length <= 2048
        for p in s:
            own.setdefault(p.doc_id, []).append((p.start, whole[p.offset : p.offset + p.length].tolist()))
    got = {i: [x for _, ids in sorted(parts) for x in ids] for i, parts in own.items()}
    assert got == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}


def test_sequences_hold_their_ids(spark):
    docs = texts(80, 9)
    hold(packing.packed(frame(spark, docs).repartition(7), registry.vocabulary(), cuts=True, block=5).collect(), docs)


def test_last_stage_returns_ids(spark):
    docs = [(i, t) for i, t in texts(40, 4)]
    hold(pipeline.packing_stage(spark, frame(spark, docs), "").collect(), docs)
