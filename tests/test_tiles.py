"""Matrices worked out in tiles against the same from tables of all cells, with stripes and tiles far smaller than a series."""

import pytest
from pyspark.sql import functions as F

from strophe.functions.columns import cosine
from strophe.operators import alignment as L
from strophe.operators import matrices as M
from strophe.operators import patterns as P
from strophe.operators import sequences as Q
from strophe.operators import spectral, tiles
from strophe.sources import adapters as A

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(tiles, "COLUMNS", 7)


@pytest.fixture(scope="module")
def feat(spark):
    """Series with equal vectors, which tie, a vector without length and a null one."""
    f = A.features(spark, SF).where("label < 3").select("label", "pos", F.slice("vec", 1, 12).alias("vec"))
    first = f.where("pos = 2").select("label", F.col("vec").alias("again"))
    v = F.when(F.col("pos").isin(5, 9, 10, 11, 30), F.col("again")).when(F.col("pos") == 17, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec"))
    return f.join(first, "label").select("label", "pos", v.alias("vec")).cache()


@pytest.fixture(scope="module")
def cells(feat):
    a, b = feat.select("label", F.col("pos").alias("i"), F.col("vec").alias("x")), feat.select("label", F.col("pos").alias("j"), F.col("vec").alias("y"))
    return a.join(b, "label").select("label", "i", "j", cosine(F.col("x"), F.col("y")).alias("v")).cache()


def same(a, b, digits=None):
    names = a.columns
    r = lambda x: round(x, digits) + 0.0 if digits is not None and isinstance(x, float) else x
    x, y = [sorted(([r(v) for v in row] for row in d.select(*names).collect()), key=str) for d in (a, b)]
    assert x and x == y


def test_similarities_are_those_of_the_cells(feat, cells):
    same(M.ssm(feat, "label"), cells)
    same(M.ssm(feat, "label", upper=True), cells.where("j >= i"))
    same(M.ssm(feat, "label", within=5), cells.where("abs(i - j) <= 5"))


def test_null_vectors_and_null_components_give_null(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, None), ("a", 2, [1.0, None]), ("a", 3, [0.0, 0.0]), ("a", 4, [1.0, 2.0, 3.0]), (None, 0, [1.0, 1.0])]
    f = spark.createDataFrame(rows, "label string, pos int, vec array<double>")
    a, b = f.select("label", F.col("pos").alias("i"), F.col("vec").alias("x")), f.select("label", F.col("pos").alias("j"), F.col("vec").alias("y"))
    same(M.ssm(f, "label"), a.join(b, "label").select("label", "i", "j", cosine(F.col("x"), F.col("y")).alias("v")))


def test_nearest(feat, cells):
    same(M.nearest_cells(feat, feat, ["label"], 0.5), M.knn_threshold(cells, ["label"], 0.5))


def test_percentile(feat, cells):
    same(tiles.above_percentile(feat, feat, ["label"], 90), M.percentile_threshold(cells, ["label"], 90))


def test_peaks(feat, cells):
    same(tiles.peaks(feat, feat, ["label"], 0.1), M.peak_threshold(cells, ["label"], 0.1))
    same(tiles.peaks(feat, feat, ["label"], 0.05, 6), M.peak_threshold(cells, ["label"], 0.05, 6))


def test_windows(feat, cells):
    kernel = [[1.0, 0.5, 0.0], [0.0, 2.0, -1.0]]
    same(tiles.convolved(feat, "label", kernel), L.convolved(cells, ["label"], kernel), 9)
    same(tiles.diagonal_ratings(feat, "label", 3, 3), P.diagonal_ratings(cells.withColumn("v", F.round("v", 3) + 1), ["label"], 3), 9)
    same(tiles.entropy_fusion(feat, "label", 3, 4), P.entropy_fusion(cells, ["label"], 3, 4), 9)
    same(tiles.time_lag_median(feat, "label", 2), L.time_lag_median(cells.where("j >= i"), ["label"], 2))


def test_blocks_and_largest(feat, cells):
    same(tiles.block_means(feat, "label", 8), Q.block_summarize(cells, 8, ["label"]), 9)
    top = lambda c: L.largest_cells(c, ["label"], 20, 0.05)
    same(top(tiles.largest(feat, "label", 20, 0.05, 6)), top(cells.where("i < j").withColumn("v", F.round("v", 6))))


def test_recurrence_keeps_what_is_near_both_ways(feat, cells):
    got = {(r["label"], r["i"], r["j"]): r["v"] for r in spectral.recurrence(feat, "label", 4).collect()}
    d = {}
    for r in cells.where("abs(i - j) >= 4").withColumn("d", F.round(1 - F.col("v"), 9)).collect():
        d.setdefault((r["label"], r["i"]), []).append((r["d"], r["j"]))
    n = {r["label"]: r["n"] for r in feat.groupBy("label").agg(F.count("*").alias("n")).collect()}
    near = {(k, i, j) for (k, i), x in d.items() for _, j in sorted(x)[: min(n[k] - 1, 2 * -int(-max(0, n[k] - 7) ** 0.5 // 1))]}
    assert got.keys() == {x for x in near if (x[0], x[2], x[1]) in near}


def test_series_are_dealt_out_in_stripes(spark, feat):
    """A series of 50 positions is at least three tasks' work, and no task gets a table of cells."""
    met = tiles.stripes(feat, feat, ["label"], lambda s: iter([[[len(s.rows.pos)], [sum(len(t[0].pos) for t in s.tiles())]]]), "rows int, columns int").collect()
    n = {r["label"]: r["n"] for r in feat.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(r["rows"] <= 16 and r["columns"] == n[r["label"]] for r in met) and len(met) == sum(-(-x // 16) for x in n.values())


def test_smoothing_looks_only_beside_cells(spark):
    """Against both filters along whole diagonals."""
    import random

    rng = random.Random(3)
    ni, nj, r = 23, 31, 2
    held = {(i, j) for i in range(ni) for j in range(nj) if rng.random() < (0.5 if (j - i) % 3 else 0.08)}
    want = set()
    for d in range(-ni + 1, nj):
        line = [int((i, i + d) in held) for i in range(max(0, -d), min(ni, nj - d))]
        med = lambda x: [int(sum(x[k - r : k + r + 1]) > r) if k >= r and k + r < len(x) else x[k] for k in range(len(x))]
        out = med([max(a, b) for a, b in zip(med(line), line)])
        want |= {("x", max(0, -d) + k, d, line[k]) for k, v in enumerate(out) if v}
    c = spark.createDataFrame([("x", i, j) for i, j in held], "key string, i int, j int")
    sizes = spark.createDataFrame([("x", ni, nj)], "key string, ni int, nj int")
    assert {tuple(x) for x in M.smoothed(c, sizes, ["key"], r).select("key", "i", "d", "raw").collect()} == want


def test_labels_filter_only_the_eigenvectors_they_use():
    """A median filter of all n eigenvectors would hold nine matrices more."""
    import tracemalloc

    import numpy as np

    from strophe.operators.kernels import laplacian_labels

    a = np.random.default_rng(1).random((600, 600)) > 0.9
    tracemalloc.start()
    laplacian_labels(a.astype(float), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * a.size * 8
