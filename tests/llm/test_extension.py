"""Matches are extended word by word and compared by words; anchors of many buckets; short texts."""

import numpy as np
import pytest

from folioscope.llm import substring
from tests.llm import brute
from tests.llm.test_pipeline_operators import frame, texts


@pytest.mark.parametrize("seed", [1, 4])
def test_hot_anchors(spark, monkeypatch, seed):
    """Workers see no patch, so the number of buckets is what makes anchors hot."""
    passage = " ".join(f"p{i}" for i in range(45))
    rows = texts(40, seed) + [(100 + i, f"own{i} words{i} {passage} tail{i} end{i}") for i in range(300)]
    got = substring.substring_dedup(frame(spark, rows), bucket_bytes=200).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in got} == brute.substring(rows)
    assert sum(r.n_removed == 45 for r in got) == 299


def test_equal_hashes_are_told_apart_by_words():
    rows = np.array([[1, 2], [1, 3], [1, 2], [1, 3], [4, 4]], np.uint32)
    key = np.zeros(5, np.uint64)
    id_, start = np.array([5, 2, 3, 9, 1]), np.array([0, 0, 0, 0, 7])
    assert substring._first_alike(key, rows, id_, start).tolist() == [2, 1, 2, 1, 4]


def test_other_lengths(spark):
    rows = texts(50, 7)
    for length, seed in ((9, 9), (30, 5), (10, 1)):
        got = substring.substring_dedup(frame(spark, rows), length=length, seed=seed, bucket_bytes=500).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in got} == brute.substring(rows, length)
        for r in got:
            assert all(s.end - s.start >= length for s in r.spans)
    with pytest.raises(ValueError):
        substring.substring_dedup(frame(spark, rows), seed=21)


def test_extension_grows_both_ways():
    """Two places of one anchor with three words alike on the left and one on the right: windows of anchor and four words."""
    w = 4
    words = np.zeros((2, 2 * w), np.uint32)
    words[:] = [11, 12, 13, 14, 21, 22, 23, 24]
    words[1, 3], words[1, 5:] = 99, 98
    p = substring.Places(np.array([7, 7], np.uint64), np.full(2, w, np.uint8), np.full(2, w, np.uint8), words, np.array([1, 2]), np.zeros(2, np.int32), np.array([10, 10], np.int32))
    late = substring.extended(p)
    assert not late[0].any() and late[1].tolist() == [False, False, False, True, False]


def test_null_and_short_rows_stay(spark):
    rows = [(i % 3 or None, None if i % 2 else "a b") for i in range(500)]
    got = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 500 and {(r.text, r.n_words, r.kept, tuple(r.spans)) for r in got} == {("", 0, "", ()), ("a b", 2, "a b", ())}
