"""The documents themselves go into shards."""

from folioscope.llm import registry, sharding


def test_query_shards_whole_documents(spark, monkeypatch):
    seen, shuffled = [], sharding.shuffled

    def keep(df, *a, **b):
        seen.append(shuffled(df, *a, **b))
        return seen[-1]

    monkeypatch.setattr(sharding, "shuffled", keep)
    sf = "/root/testdata/sf0.001"
    digest = {r.doc_id: (r.shard, r.slot) for r in registry.op8_sharding(spark, sf).collect()}
    docs = registry.table(spark, sf, "documents")
    assert {"text", "lang", "source", "n_chars"} <= set(seen[0].columns)
    rows = seen[0].collect()
    assert sorted(tuple(r[c] for c in docs.columns) for r in rows) == sorted(map(tuple, docs.collect()))
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == digest
