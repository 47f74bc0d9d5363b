"""Fingerprints equal those that SQL computes, whole numbers from the bytes up."""

import duckdb
import pytest
import xxhash

from folioscope.llm import registry, sql_hashes

ODD = [None, "", " \n\t", "One", "one two", "a b c d", "a b c d e", "A b c d e f", "Wörter für Größe 日本 語 — naïve", "x" * 70 + " y", *[" ".join(f"w{i * j % 37}" for j in range(i)) for i in range(6, 40)], "w1 " * 300]


def test_xxh64_in_sql():
    strings = ["", "a", "abc", "abcd", "abcdefg", "abcdefgh", "hello wörld", "x" * 31, "y" * 32, "z" * 33, "é" * 40, "0123456789" * 13]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[s] for s in strings])
    got = con.execute(f"WITH {sql_hashes.xxh64('t')} SELECT s, h FROM hashed").fetchall()
    assert {s: int(h) for s, h in got} == {s: xxhash.xxh64_intdigest(s.encode(), 42) for s in strings}


@pytest.mark.parametrize("name", ["op2_minhash", "op6_simhash"])
def test_odd_texts(spark, tmp_path, name):
    df = spark.createDataFrame([(7 * i % 101, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
