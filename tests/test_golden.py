"""Small inputs whose results were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strophe.functions import columns as C
from strophe.operators import graphs as G
from strophe.operators import hierarchies as H
from strophe.operators import matrices as M
from strophe.operators import sequences as S
from strophe.operators import statistics as T


def seq(spark, *seqs, value="sym", kind="int"):
    return spark.createDataFrame([(n, k, v) for n, s in enumerate(seqs) for k, v in enumerate(s)], f"seq_id long, pos int, {value} {kind}")


def values(df, column):
    return [r[column] for r in df.orderBy("seq_id", "pos").collect()]


def levels(spark, *rows, item=1):
    return spark.createDataFrame([(item, n, k, v) for n, r in enumerate(rows) for k, v in enumerate(r)], "item long, level int, pos int, label int")


def test_grid_summarize_takes_the_longest_then_the_first(spark):
    f = spark.createDataFrame([(1, k, t, v) for k, (t, v) in enumerate([(0.0, 3), (0.5, 5), (2.5, 7), (3.5, 8), (7.0, 9)])], "seq_id long, pos int, t double, value int")
    g = spark.createDataFrame([(1, k, float(k)) for k in range(5)], "seq_id long, pos int, t double")
    assert values(S.grid_summarize(f, g, 2.0), "value") == [3, 5, 5, 7, 9]


def test_chords(spark):
    d = spark.createDataFrame([("A",), ("Cb",), ("F#m",), ("Bdim",), ("Ebaug",)], "c string")
    r = d.select(C.chord_index(F.col("c")).alias("i")).collect()
    assert [x.i for x in r] == [9, -1, 18, 47, 27]
    names = spark.createDataFrame([(18,), (47,), (27,)], "i int").select(C.chord_name(F.col("i")).alias("n"), C.chord_pitches(F.col("i")).alias("p")).collect()
    assert [x.n for x in names] == ["F#m", "Bdim", "Ebaug"]
    assert names[0].p == [1, 6, 9]


def test_windows(spark):
    assert values(S.downsample_mode(seq(spark, [1, 1, 2, 3, 4, 4, 1, 2, 3]), 3), "sym") == [1, 4, 1]
    g = seq(spark, [1.0, 3.0, 6.0, 7.0], value="t", kind="double")
    assert values(S.interpolate_grid(g), "t") == [1, 2, 3, 4.5, 6, 6.5, 7, 7.5]
    b = seq(spark, [float(c) for c in "000010110011000"], value="value", kind="double")
    assert values(S.median_filter(b, 2), "value") == [float(c) for c in "000001101100000"]
    assert [r.pos for r in S.subarray_search(seq(spark, [1, 2, 1, 2]), [1, 2]).orderBy("pos").collect()] == [0, 2]


def test_runs_and_segments(spark):
    s = seq(spark, [0, 1, 2, 0, 1, 2, 0])
    segs = {(r.i0, r.j0, r.len) for r in M.diag_segments(M.equality_cells(s), ["seq_id"]).collect()}
    assert segs == {(0, 3, 4), (0, 6, 1)}
    back = M.diag_segments(M.segment_cells(M.diag_segments(M.equality_cells(s), ["seq_id"]), ["seq_id"]), ["seq_id"])
    assert {(r.i0, r.j0, r.len) for r in back.collect()} == segs


def test_smoothing_closes_a_gap_and_trims(spark):
    a = [0, 1, 2, 3, 4, 5, 6, 7]
    s = seq(spark, a + a[:4] + [9] + a[5:])
    got = {(r.i0, r.j0, r.len) for r in M.self_align(s, 6, 1, 1, 0.5).collect()}
    assert got == {(0, 8, 8)}


def test_msa_entropy(spark):
    s = seq(spark, [0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 2])
    c = s.select("seq_id", "pos", F.floor(F.col("pos") / 4).cast("int").alias("root"))
    r = G.msa_entropy(s, c).first()
    assert r.entropy == pytest.approx(2.3112781) and (r.comps, r.points) == (3, 12)


def test_pairwise_recall(spark):
    assert H.pairwise_recall(levels(spark, [0, 0, 0, 1, 1, 1], [2, 2, 3, 3, 4, 4])).first().recall == pytest.approx(2 / 3)
    assert H.pairwise_recall(levels(spark, [0, 0], [1, 2])).first().recall is None


def test_lmeasure(spark):
    ref = levels(spark, [0] * 6, [1, 2, 3, 1, 2, 4])
    p = H.lmeasure(ref, levels(spark, [0] * 6, [1, 1, 1, 1, 1, 2])).first()
    assert (p.p, p.r, round(p.l, 7)) == (pytest.approx(3 / 20), pytest.approx(3 / 8), 0.2142857)
    p = H.lmeasure(ref, ref).first()
    assert (p.p, p.r, p.l) == (1, 1, 1)
    p = H.lmeasure(ref, levels(spark, [0] * 6)).first()
    assert (p.p, p.r, p.l) == (0, 0, 0)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(k, k + 1) for k in range(60)] + [(500, 500 + k) for k in range(1, 90)] + [(7, 7)]
    got = {r.node: r.root for r in G.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {500 + k: 500 for k in range(90)}
    assert G.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_as_of(spark):
    left = spark.createDataFrame([(1, 0, 0.5), (1, 1, 1.0), (1, 2, 9.0)], "k int, pos int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b"), (2, 0.0, "c")], "k int, t double, v string")
    r = S.as_of(left, right, "v", ["k"], default="-").orderBy("pos").collect()
    assert [x.v for x in r] == ["-", "a", "b"]
    r = S.as_of(left, right, "v", ["k"], inclusive=False, default="-").orderBy("pos").collect()
    assert [x.v for x in r] == ["-", "-", "b"]


def test_monotonic_refinement(spark):
    h = spark.createDataFrame([(1, 0, 0, 0.0, 4.0, "a"), (1, 0, 1, 4.0, 8.0, "b"), (1, 1, 0, 0.0, 5.0, "c"), (1, 1, 1, 5.0, 8.0, "d")], "item long, level int, seg int, start double, end double, label string")
    got = [(r.level, r.start, r.end, r.label) for r in H.make_monotonic(h).orderBy("level", "start").collect()]
    assert got == [(0, 0.0, 4.0, "a"), (0, 4.0, 8.0, "b"), (1, 0.0, 4.0, "c"), (1, 4.0, 5.0, "c"), (1, 5.0, 8.0, "d")]
    assert not H.monotonicity(h).first().monotonic and H.monotonicity(H.make_monotonic(h)).first().monotonic


def test_chi_squared_by_common_bins(spark):
    h = T.tuple_hist(seq(spark, [0, 1, 0, 1], [0, 1, 2, 2], [5, 5]), 2, relative=True)
    got = {(r.a, r.b): r.d for r in T.chi2_distances(h).collect()}
    full = {k: {r.gram: r.n for r in h.where(F.col("seq_id") == k).collect()} for k in range(3)}
    for (a, b), d in got.items():
        keys = set(full[a]) | set(full[b])
        assert d == pytest.approx(0.5 * sum((full[a].get(k, 0) - full[b].get(k, 0)) ** 2 / (full[a].get(k, 0) + full[b].get(k, 0) + 1e-6) for k in keys), abs=1e-9)
    assert len(got) == 9


def test_tonal_complexity(spark):
    d = spark.createDataFrame([([1.0] + [0.0] * 11,), ([1.0] * 12,)], "c array<double>")
    r = [x.t for x in d.select(C.tonal_complexity(F.col("c")).alias("t")).collect()]
    assert r[0] == pytest.approx(0, abs=1e-6) and r[1] == pytest.approx(1)
    assert math.isclose(d.select(C.amplitude(F.lit(20.0)).alias("x")).first().x, 10)
