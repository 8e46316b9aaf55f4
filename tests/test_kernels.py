"""Sequential algorithms against small results worked out by hand, plain versions, or invariants."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strophe import plans
from strophe.operators import evolution as E
from strophe.operators import grammars as G
from strophe.operators import kernels as K

symbols = st.lists(st.integers(0, 3), min_size=1, max_size=40)


def test_smith_waterman_goes_back_by_maxima():
    assert K.smith_waterman([3, 4, 6, 7], [3, 4, 5, 6, 7]) == [(0, 0), (1, 1), (3, 4)]
    assert K.smith_waterman([1], [2]) == []
    assert K.smith_waterman([1, 9, 3], [1, 2, 3], ignore=(9,)) == [(0, 0), (1, 1), (2, 2)]


@given(symbols, symbols)
@settings(max_examples=40, deadline=None)
def test_local_scores_are_the_recursion(a, b):
    h = K.local_scores(a, b)
    want = np.zeros_like(h)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            want[i, j] = max(0, want[i - 1, j - 1] + (3 if a[i - 1] == b[j - 1] else -3), want[i - 1, j] - 5, want[i, j - 1] - 5)
    assert np.array_equal(h, want)


@given(st.lists(symbols, min_size=1, max_size=3))
@settings(max_examples=60, deadline=None)
def test_induction_can_be_undone(seqs):
    left, sections, occurrences = G.induce(seqs)
    for s, original in zip(left, seqs):
        assert [y for x in s for y in G.expanded(x, sections)] == original
    for k, where in occurrences.items():
        for s, p in where:
            whole = G.expanded(k, sections)
            assert seqs[s][p : p + len(whole)] == whole


def test_pairs_are_thinned_by_parity():
    assert G.thinned_pairs([0, 1, 0, 1]) == [(0, 1), (1, 0)]
    assert G.thinned_pairs([0, 0, 0, 0, 1]) == [(0, 0), (0, 0)]


def test_layers_last_as_long_as_the_sequence():
    seq = [0, 1, 2, 0, 1, 2, 3, 0, 1]
    left, sections, _ = G.induce([seq])
    layers = G.section_layers(left[0], sections)
    assert layers and all(sum(d) == len(seq) and len(d) == len(lab) for lab, d in layers)
    assert len(layers[0][0]) == 1


@given(st.integers(3, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=12))
@settings(max_examples=40, deadline=None)
def test_closure_is_idempotent_and_right(n, cells):
    m = np.zeros((n, n))
    for i, j in cells:
        m[i % n, j % n] = 1
    c = K.close(m)
    reach = (np.eye(n) + m + m.T > 0).astype(int)
    for _ in range(n):
        reach = (reach @ reach > 0).astype(int)
    assert np.array_equal(c > 0, reach > 0) and np.array_equal(K.close(c), c)


def test_runs_of_a_matrix():
    m = np.zeros((5, 5))
    m[0, 2] = m[1, 3] = m[3, 4] = 1
    assert K.diagonal_runs(m) == [(3, 4, 1), (0, 2, 2)]


def test_construction_finds_a_repetition():
    t = np.zeros((24, 24))
    for k in range(8):
        t[k, k + 8] = t[k + 8, k + 16] = t[k, k + 16] = 0.9
    got = K.transitive_construction(t, 4, 4, size_factor=1)
    assert np.array_equal(np.triu(got, 1) > 0, t > 0)
    t[3, 11] = 0.01  # a weak cell is filled in by the closure
    assert K.transitive_construction(t, 4, 4, size_factor=1)[3, 11] == 1


def test_greedy_hierarchical_keeps_what_agrees():
    t = np.zeros((16, 16))
    k = np.arange(8)
    t[k, k + 8] = 1
    assert np.array_equal(np.triu(K.greedy_hierarchical(K.diagonal_runs(t), t, 4), 1), t)


def test_best_segments_take_the_best_first():
    m = np.zeros((20, 20))
    k = np.arange(8)
    m[k, k + 10] = 1
    assert K.best_segments(m, 4, 8, 1, 0, 0.5, 0.6)[0] == (0, 10, 8)
    assert K.best_segments(np.zeros((3, 3))) == []


def test_filter_segments():
    segs = [(0, 2, 2), (0, 10, 6), (1, 12, 5), (0, 30, 3)]
    assert K.filter_segments(segs, 0, 3, 1, True) == [(0, 30, 3), (0, 10, 6), (1, 12, 5)]
    assert K.filter_segments(segs, 1, 3, 2, True) == [(0, 30, 3)]
    assert K.filter_segments(segs, 0, 3, 1, False)[0] == (0, 10, 6)


def test_constrained_components():
    e = [((0, 0), (1, 0)), ((1, 0), (2, 0)), ((0, 3), (2, 0)), ((0, 20), (3, 0)), ((2, 0), (3, 0))]
    assert K.constrained_components(e, 16) == [[(0, 0), (0, 20), (1, 0), (2, 0), (3, 0)]]
    assert K.constrained_components([((0, 0), (1, 0)), ((0, 5), (2, 0)), ((1, 0), (2, 0))], 16) == [[(0, 0), (1, 0)], [(0, 5), (2, 0)]]


def test_laplacian_labels_of_two_blocks():
    a = np.zeros((20, 20))
    a[:10, :10] = a[10:, 10:] = 1
    a[9, 10] = 1
    labels = K.laplacian_labels(a, 2, 1)
    assert len(set(labels[0].tolist())) == 1
    assert labels[1].tolist() == [labels[1][0]] * 10 + [labels[1][10]] * 10 and labels[1][0] != labels[1][10]


def test_profile_alignment_of_a_deletion_and_an_insertion():
    base = [0, 1, 2, 3, 0, 2, 1, 3, 2, 0]
    got = K.profile_msa([base, base, base[:5] + base[6:], base[:5] + [4] + base[5:]], 5)
    assert got[0] == list(range(10))
    assert got[2] == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert got[3] == [0, 1, 2, 3, 4, -1, 5, 6, 7, 8, 9]


def test_optics_parts_two_groups_and_noise():
    x = np.array([0, 0.1, 0.2, 0.3, 0.4, 5, 5.1, 5.2, 5.3, 5.4, 100.0])
    lab = K.optics_clusters(np.abs(x[:, None] - x[None]), 5, 5)
    assert lab.tolist() == [0] * 5 + [1] * 5 + [-1]


def test_kmeans_labels_by_first_appearance():
    x = np.array([[5.0], [5.1], [0.0], [0.1]])
    assert K.kmeans(x, 2).tolist() == [0, 0, 1, 1]


def test_lowess_of_a_line_is_the_line(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["a"] * 50, "x": np.arange(50.0), "y": 2 * np.arange(50.0) + 1}))
    for r in E.lowess(df, "k").collect():
        assert r.y == pytest.approx(2 * r.x + 1)
    one = spark.createDataFrame([("a", 1.0, 3.0)], "k string, x double, y double")
    assert [tuple(r) for r in E.lowess(one, "k").collect()] == [("a", 1.0, 3.0)]


def test_maximal_cliques():
    a = np.zeros((6, 6))
    for i, j in [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (2, 4)]:
        a[i, j] = 1
    assert K.maximal_cliques(a) == [[0, 1, 2], [2, 3, 4], [5]]


def test_structure_of_a_repetition():
    t = np.zeros((24, 24))
    for k in range(12):
        t[k, k + 12] = 0.9
    layers = K.simple_structure(t)
    assert layers and all(sum(d) == 24 for _, d in layers)
    assert layers[1][0] == layers[1][0][:2] * 2  # the last pair of a sequence never counts, so its last symbol stays by itself


def test_pairwise_kernels_take_all_partners_of_the_reference(spark):
    d = "/root/testdata/sf0.001"
    pairs = {tuple(r) for r in plans.QUERIES["pairings"](spark, d).select("a", "b").collect()}
    assert {tuple(r) for r in plans.QUERIES["sw_similarity"](spark, d).select("a", "b").collect()} == pairs
    alike = {tuple(r) for r in plans.QUERIES["sw_similarity"](spark, d).where("similarity > 0").select("a", "b").collect()}
    assert {tuple(r) for r in plans.QUERIES["smith_waterman"](spark, d).select("a", "b").distinct().collect()} == alike


def test_laplacian_query_gives_all_levels_of_the_reference(spark):
    assert {r.level for r in plans.QUERIES["laplacian_labels"](spark, "/root/testdata/sf0.001").select("level").distinct().collect()} == set(range(11))
