"""The cascade of similarities against comparing all pairs."""

from collections import Counter

import numpy as np
import pytest

from strophe.operators import similar as L
from strophe.operators.kernels import local_paths, smith_waterman


def plain(rows, least, occurrences=None):
    out, rows = {}, sorted({(k, p, tuple(s)) for k, p, s in rows if k is not None and p is not None and s})
    cover = {}
    for p, seq, pos in occurrences or []:
        for _, q, s in rows:
            if q == p:
                cover.setdefault(p, set()).update((seq, pos + k) for k in range(len(s)))
    for k, a, x in rows:
        for j, b, y in rows:
            if k != j or a >= b:
                continue
            n = max(len(x), len(y))
            overlap = sum((Counter(x) & Counter(y)).values()) / n
            alignment = len(smith_waterman(list(x), list(y))) / n
            both = sorted(cover.get(a, set()) & cover.get(b, set()))
            run = best = 0
            for i, point in enumerate(both):
                run = run + 1 if i and both[i - 1] == (point[0], point[1] - 1) else 1
                best = max(best, run)
            if overlap >= least and alignment >= least and (occurrences is None or best / n >= least):
                out[k, a, b] = (round(overlap, 9), round(alignment, 9)) + ((round(best / n, 9),) if occurrences is not None else ())
    return out


@pytest.mark.parametrize("least", [0.5, 0.75, 0.8, 1.0])
def test_edges_are_those_of_all_pairs(spark, least):
    rng = np.random.default_rng(int(100 * least))
    rows = []
    for k in range(2):
        for p in range(60):
            base = rng.integers(0, 5, int(rng.choice([1, 4, 5, 8, 10, 20]))).tolist()
            rows += [(k, f"{p}", base), (k, f"{p}x", [x if rng.random() < 0.9 else 9 for x in base])]
    rows += rows[:5] + [(0, None, [1]), (None, "n", [1]), (0, "e", [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key int, pattern string, syms array<int>, n int")
    edges, steps = L.cascade(df, "key", least)
    got = {(r.key, r.a, r.b): (round(r.overlap, 9), round(r.alignment, 9)) for r in edges.collect()}
    assert got == plain(rows, least) and got
    counts = [r.pairs for r in sorted(steps.collect(), key=lambda r: r.ord)]
    assert counts == sorted(counts, reverse=True) and counts[-1] == len(got)


def test_occurrences_are_the_last_measure(spark):
    rows = [(1, "a", [1, 2, 3, 4, 5]), (1, "b", [1, 2, 3, 4, 6]), (1, "c", [1, 2, 3, 4, 5, 7])]
    at = [("a", 0, 10), ("a", 3, 0), ("b", 0, 11), ("c", 3, 0), ("c", 0, 50)]
    df, occ = spark.createDataFrame(rows, "key int, pattern string, syms array<int>"), spark.createDataFrame(at, "pattern string, seq_id int, pos int")
    edges, _ = L.cascade(df, "key", 0.6, occ)
    assert {(r.key, r.a, r.b): (round(r.overlap, 9), round(r.alignment, 9), round(r.together, 9)) for r in edges.collect()} == plain(rows, 0.6, at)


def test_registered_patterns_are_compared_as_by_hand(spark):
    from strophe.plans import relations

    sf = "/root/testdata/sf0.001"
    rows = [(r.song, r.pattern, list(r.syms)) for r in relations._patterns(spark, sf)[0].collect()]
    got = {(r.song, r.a, r.b) for r in relations.pattern_cascade(spark, sf).collect()}
    assert got == set(plain(rows, 0.5)) and got


def test_paths_of_many_pairs_are_those_of_each(spark):
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 4, rng.integers(0, 30)).tolist(), rng.integers(0, 4, rng.integers(0, 30)).tolist()) for _ in range(80)]
    assert local_paths(pairs) == [smith_waterman(a, b) for a, b in pairs]


def test_no_patterns(spark):
    edges, steps = L.cascade(spark.createDataFrame([], "key int, pattern string, syms array<int>"), "key", 0.8)
    assert edges.count() == 0 and {r.pairs for r in steps.collect()} == {0}
