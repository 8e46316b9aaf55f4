"""Exact top-k search against comparing all."""

import numpy as np
import pytest

from strophe.llm import topk


def brute(rows, queries, k, factor=256):
    """All inner products, by the definition; rows and queries are (vec_id, vector) in any number of copies."""
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    cut = lambda v: [int(np.floor(factor * x)) for x in v]
    out = set()
    for q in {i for i, v in queries if i is not None and ok(v)}:
        scores = sorted((-sum(a * b for a, b in zip(cut(v), cut(w))), i) for j, v in queries if j == q and ok(v) for i, w in rows if i is not None and i != q and ok(w) and len(v) == len(w))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, part string")


@pytest.mark.parametrize("shard", [7, 64, 100000])
def test_answers_are_those_of_comparing_all(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(150, 6)).astype(np.float32).tolist())]
    queries = rows[::10]
    got = topk.search(frame(spark, rows), frame(spark, queries), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [5.0, 5.0]), (9, [-0.001, 0.5]), (10, [1e30, -1e30])]
    queries = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (4, [0.0, 0.0]), (5, []), (6, [1.0, 2.0, 3.0]), (1, None)]
    got = {}
    for q, rank, i, score in map(tuple, topk.search(frame(spark, rows), frame(spark, queries), 5).collect()):
        got.setdefault(q, {})[rank] = (i, score)
    top = 256 * topk.LARGEST
    assert got[0] == {1: (10, top), 2: (10, top), 3: (7, 65536), 4: (7, 65536), 5: (8, 65536)}  # a repeated query answers twice, a repeated vector is two answers
    assert [got[4][r] for r in (1, 2, 3, 4, 5)] == [(0, 0), (7, 0), (8, 0), (8, 0), (9, 0)]
    assert 5 not in got and 6 not in got and 1 not in got  # no others of their length, or no vector
    assert topk.search(frame(spark, []), frame(spark, []), 5).collect() == []


def test_reading_ends_early_where_few_can_qualify():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(20000, 16))).astype(np.int32)
    lists = topk.Lists(np.arange(len(x)), x)
    q = x[7]
    scores = np.sort(np.delete(x.astype(np.int64) @ q, 7))[::-1]
    rows, got = lists.search(q, 7, 5, float(scores[4]))
    assert got.tolist() == scores[:5].tolist() and lists.start < topk.STEPS // 2
