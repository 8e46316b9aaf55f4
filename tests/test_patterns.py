"""Patterns, sections and wider measures, by small results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strophe.operators import matrices as M
from strophe.operators import patterns as P


def segs(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "seq_id long, i0 int, j0 int, len int")


def series(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "seq_id long, pos int, value int")


def matrix(spark, rows):
    return spark.createDataFrame([(1, i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "m long, i int, j int, v double")


def test_fill_gaps(spark):
    got = [r.value for r in P.fill_gaps(series(spark, [0, 1, 1, 1, 0, 1, 1, 1, 0, 0, 1, 0]), 1, 0.2).orderBy("pos").collect()]
    assert got == [0, 1, 1, 1, 1, 1, 1, 1, 0, 0, 1, 0]


def test_sliding_means(spark):
    got = {(r.pos, r.len): r["mean"] for r in P.sliding_means(series(spark, [1, 3, 5]), 2, 3).collect()}
    assert got == {(0, 2): 2, (1, 2): 4, (0, 3): 3}


def test_diagonal_ratings(spark):
    got = {(r.i, r.j): r.rating for r in P.diagonal_ratings(matrix(spark, [[2, 1, 0], [1, 4, 0], [0, 0, 6]]), ["m"], 2).collect()}
    assert got[0, 0] == pytest.approx(3) and got[1, 1] == 0 and got[0, 1] == pytest.approx(0.25)


def test_entropy_fusion_of_one_value_is_nothing(spark):
    got = P.entropy_fusion(matrix(spark, [[1] * 4] * 4), ["m"], 2, 4).collect()
    assert len(got) == 16 and all(abs(r.v) < 1e-9 for r in got)


def test_sections_within_others(spark):
    got = {(r.p, r.len, r["sub"]) for r in P.sections(segs(spark, (0, 4, 8), (2, 6, 4), (2, 10, 2), (1, 4, 1)), "seq_id").collect()}
    assert got == {(0, 12, 4), (1, 4, 3)}


def test_patterns_merge(spark):
    p = P.translations(segs(spark, (0, 5, 3), (0, 9, 3), (2, 7, 4), (2, 11, 4), (20, 25, 2)), "seq_id")
    assert {(r.p, r.len, tuple(r.t)) for r in p.collect()} == {(0, 3, (0, 5, 9)), (2, 4, (0, 5, 9)), (20, 2, (0, 5))}
    assert {(r.p, r.len, tuple(r.t)) for r in P.merged_patterns(p, "seq_id").collect()} == {(0, 6, (0, 5, 9)), (20, 2, (0, 5))}


def test_distance_to_references(spark):
    s = segs(spark, (0, 10, 5), (50, 60, 3))
    got = {(r.i0, r.j0): r.dist for r in P.min_distance(s, segs(spark, (2, 14, 6), (3, 30, 6)), "seq_id").collect()}
    assert got == {(0, 10): 2, (50, 60): 1}


def test_wildcards(spark):
    d = spark.createDataFrame([([1, -1, 3], [1, 2, -1]), ([1, 2], [1, 3]), ([1], [1, 1]), ([], [])], "a array<int>, b array<int>")
    assert [r.e for r in d.select(P.wildcard_equal(F.col("a"), F.col("b")).alias("e")).collect()] == [True, False, False, True]


def test_combinations(spark):
    c = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 2)], "seq_id long, k int, i int, j int")
    got = {(r.combo, r.j) for r in P.combinations(c, ["seq_id"], "k", 2).collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (3, 2)}


def test_f_measure(spark):
    a = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 1.0)], "m long, i int, j int, v double")
    b = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 2, 3.0)], "m long, i int, j int, v double")
    r = M.f_measure(a, b, ["m"]).first()
    assert (r.p, r.r, r.f) == (0.5, 0.25, pytest.approx(1 / 3))


def test_blocks_and_isolated_cells(spark):
    s = segs(spark, (0, 1, 2), (0, 2, 2), (0, 3, 2), (5, 9, 2))
    n = spark.createDataFrame([(1, 12)], "seq_id long, n int")
    got = {(r.i0, r.j0): r.block for r in P.without_blocks(s, n, "seq_id", 3).collect()}
    assert got == {(0, 1): True, (0, 2): False, (0, 3): True, (5, 9): False}
    c = P.isolated_cells(M.segment_cells(s, ["seq_id"]), ["seq_id"]).first()
    assert (c.n, c.isolated) == (8, 0)
