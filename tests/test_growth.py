"""That the work of queries which grew faster than their input does not any more: what plans and tasks hold, by small tables."""

from __future__ import annotations

import time
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from strophe import plans
from strophe.operators import chains as H2
from strophe.operators import consensus as C
from strophe.operators import corpus as R
from strophe.operators import graphs as G
from strophe.operators import hierarchies as H
from strophe.operators import kernels as K
from strophe.operators import parts as N
from strophe.operators import structures as T
from strophe.operators import tiles
from strophe.sources import adapters as A
from strophe.sources.storage import stored


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjust_start_end_goes_through_levels_once(spark):
    h = spark.createDataFrame([(1, 0, 0, 5.0, 9.0, "a"), (1, 0, 1, 9.0, 12.0, "b"), (1, 1, 0, 30.0, 40.0, "c"), (2, 0, 0, 0.0, 25.0, "d")], "item long, level int, seg int, start double, end double, label string")
    x = H.adjust_start_end(h, spark.createDataFrame([(1, 20.0), (2, 20.0)], "item long, target double"))
    rows = sorted(tuple(r) for r in x.collect())
    assert rows == [(1, 0, 0, 0.0, 5.0, "-1"), (1, 0, 1, 5.0, 9.0, "a"), (1, 0, 2, 9.0, 12.0, "b"), (1, 0, 3, 12.0, 20.0, "-1"), (1, 1, 0, 0.0, 20.0, "-1"), (2, 0, 0, 0.0, 20.0, "d")]
    assert plan(x).count("Join") == 1 and "Union" not in plan(x)


def test_groups_come_many_to_a_batch_and_whole(spark):
    """Groups that go over the ends of batches come as one; no group is a batch of its own, which took 13 ms."""
    df = spark.range(50).select((F.col("id") % 4).alias("g"), F.col("id").cast("int").alias("x"), (-F.col("id")).cast("int").alias("y"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 1)], "g long, x int, y int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        one = K.per_group(df, "g", lambda f: [(len(f), int(f["x"].sum()))], "n int, x int")
        two = K.per_rows(df, "g", ["x", "y"], lambda rows: [(len(rows), sum(x for x, _ in rows))] if rows == sorted(rows) else [], "n int, x int")
        want = [(k, len(range(k, 50, 4)), sum(range(k, 50, 4))) for k in range(4)]
        assert sorted(map(tuple, one.collect())) == want == sorted(map(tuple, two.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in plan(one) and "FlatMapGroups" not in plan(two)


def test_results_of_many_sequences_are_handed_on_in_parts():
    frames = list(K.handed_on(((k, "a") for k in range(2 * K.HANDED_ON + 1)), ["k", "s"]))
    assert [len(f) for f in frames] == [K.HANDED_ON, K.HANDED_ON, 1]


def test_beam_joins_classes_as_closing_matrices_does():
    segs = [(0, 6, 5), (1, 12, 4), (6, 12, 6), (2, 17, 4)]
    target = np.zeros((24, 24))
    for s in segs:
        target[T.cells_of(s)] = 1
    with mock.patch.object(T, "close", side_effect=AssertionError("a matrix is closed for every step")):
        assert T.beam_hierarchical(segs, target, 3, 3)


def test_songs_are_batches_of_their_own(spark):
    rows = [(k, [(k, [1, 2])], [(k, k, 0, 1, 1)]) for k in range(6)]
    df = spark.createDataFrame(rows, "song long, seqs array<struct<seq_id:long,syms:array<int>>>, segs array<struct<a:long,b:long,i0:int,j0:int,len:int>>")
    x = R.per_song(df, lambda ids, seqs, segs: [(ids[0], len(segs))], "seq_id long, n int")
    assert sorted(map(tuple, x.collect())) == [(k, k, 1) for k in range(6)]
    assert "FlatMapGroupsInPandas" in plan(x)


def test_components_of_a_dense_song_are_found_soon():
    """Sixty sequences that are all alike: a pair costs no more than the smaller component, where whole components were sorted for each."""
    segs = [(a, b, 0, 0, 40) for a in range(60) for b in range(a + 1, 60)]
    began = time.process_time()
    comps = C.connected_components(segs, 8)
    assert [len(c) for c in comps] == [60] * 40 and time.process_time() - began < 4


def test_plain_tables_are_as_large_as_their_rows(spark):
    """A million packed rows are under Spark's bound for broadcasts, and would go through the driver."""
    seq = spark.range(0, 1_000_000, 1, 2).select(F.floor(F.col("id") / 64).alias("seq_id"), (F.col("id") % 64).cast("int").alias("pos"), F.lit(1).alias("sym"))
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(stored(seq, "packed")) < 10 << 20 < size(stored(seq, "plain", plain=True))


def test_combinations_shuffle_cells_once(spark):
    from strophe.operators.patterns import combinations

    cells = spark.createDataFrame([(1, 0, 0, 1), (1, 2, 0, 1), (1, 1, 3, 4)], "seq_id long, param int, i int, j int")
    x = combinations(cells, ["seq_id"], "param", 3)
    want = [(1, c, 0, 1) for c in range(1, 8) if c & 5] + [(1, c, 3, 4) for c in range(1, 8) if c & 2]
    assert sorted(tuple(r) for r in x.select("seq_id", "combo", "i", "j").collect()) == sorted(want)
    assert "Aggregate" not in plan(x).split("Generate")[0]


def test_profile_aligns_sequences_of_a_length_together():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 5, n).tolist() for n in [6] * 40 + [9] * 40 + [0, 1]]
    took, stack = [], np.stack
    with mock.patch.object(np, "stack", side_effect=lambda *a, **k: (took.append(1), stack(*a, **k))[1]):
        paths = K.profile_msa(seqs, 5)
    assert [len(p) for p in paths] == [len(s) for s in seqs]
    assert len(took) < 200  # of 82 sequences one by one: over 3,000


def test_supported_parts_count_pairs_where_segments_are(spark):
    """Only segments are shuffled for the count; cells were, each as two structs."""
    segs = [(0, 0, 1, 0, 0, 9), (0, 1, 0, 2, 2, 5), (0, 1, 2, 1, 11, 6), (0, 2, 2, 12, 1, 4)]
    df = spark.createDataFrame(segs, "song long, a long, b long, i0 int, j0 int, len int")
    tables = []
    with mock.patch.object(N, "stored", side_effect=lambda d, name: (tables.append(d), stored(d, name))[1]):
        got = sorted((r["comp"], r["seq_id"], r["pos"]) for r in N.supported_parts(df, "song", 3, 1).collect())
    assert got == [(k, *x) for k, c in enumerate(C.supported_components([s[1:] for s in segs], 3, 1)) for x in c]
    assert tables[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_differences_of_points_are_not_shuffled(spark):
    """Only points and rows of them are; differences were, and each pattern was a Python step."""
    rng = np.random.default_rng(2)
    sets = {k: sorted({(int(a), int(b)) for a, b in zip(rng.integers(-9, 30, n), rng.integers(0, 4, n))}) for k, n in enumerate([1, 2, 40, 25, 60])}
    sets[5] = [(0, -(2**28)), (2**29, 2**28), (2**29 + 7, 0)]  # a long line
    rows = [(k, *p) for k, points in sets.items() for p in points]
    want = []
    for k, points in sets.items():
        moves = {}
        for i, (x, y) in enumerate(points):
            for u, v in points[i + 1 :]:
                moves.setdefault((u - x, v - y), []).append((x, y))
        for (dx, dy), own in moves.items():
            every = {(u - own[0][0], v - own[0][1]) for u, v in points}
            want.append((k, dx, dy, len(own), sum(all((x + u, y + v) in set(points) for x, y in own) for u, v in every)))
    df = spark.createDataFrame([*rows, *rows[:9], (2, None, 1)], "seq_id long, pos int, sym int")
    for stripe in (1 << 18, 50):
        x = G.siatec(df, stripe)
        assert sorted(map(tuple, x.collect())) == sorted(want)
        assert "Join" not in plan(x) and plan(x).count("RepartitionByExpression") == 1


def test_connected_places_meet_without_shuffling_their_pairs(spark):
    """Places are counted where they meet; the cells of all pairs of occurrences were shuffled for the counts."""
    rng = np.random.default_rng(3)
    occ = {(int(s), int(n), int(x)) for s, n, x in zip(rng.integers(0, 6, 150), rng.integers(2, 6, 150), rng.integers(0, 12, 150))}
    rows = [(f"{n}:{(s + x) % 3}", n, s, x) for s, n, x in sorted(occ)]
    df = spark.createDataFrame(rows, "pattern string, len int, seq_id long, pos int")
    for least in (1, 2, 3):
        n = {}
        for a in rows:
            for b in rows:
                if a[0] == b[0] and a[2:] < b[2:]:
                    for k in range(a[1]):
                        at = a[2], a[3] + k, b[2], b[3] + k
                        n[at] = n.get(at, 0) + 1
        for many in (0, 4, 12):
            x = G.connection_counts(df, least, many)
            assert sorted(map(tuple, x.collect())) == sorted((*at, c) for at, c in n.items() if c >= least)
            assert "Aggregate" not in plan(x)


def test_best_segments_marks_what_a_window_contains_without_looking_at_all_others(spark):
    m = np.random.default_rng(1).random((400, 400))
    began = time.process_time()
    assert K.best_segments(m, 5, 12, 2, 90, 0.2, 0.05)
    assert time.process_time() - began < 3  # 0.3 s; comparing each window with all others took 9
    cells = plans.QUERIES["best_segments"](spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in plan(cells)  # a series' vectors are sent, not its cells


def test_transitive_construction_keeps_what_it_knows_of_two_components(spark):
    x = np.random.default_rng(1).standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    began = time.process_time()
    label = K.transitive_labels(np.maximum(x @ x.T, 0))
    assert time.process_time() - began < 3  # 0.3 s; rating each cell of the beam anew took 12
    i, j = K.pairs_within(label)
    assert len(i) and (j - i >= 4).all() and (label[i] == label[j]).all() and len(i) == ((label[:, None] == label).sum() - 200) // 2
    assert "MapInPandas" not in plan(plans.QUERIES["transitive_construction"](spark, "/root/testdata/sf0.001"))


def test_simple_structure_is_sent_vectors_and_not_cells(spark):
    assert "MapInPandas" not in plan(plans.QUERIES["simple_structure"](spark, "/root/testdata/sf0.001"))


def test_components_shuffle_nodes_and_not_edges(spark):
    n = 60
    e = spark.createDataFrame([(a, b) for k in range(4) for a in range(k * n, k * n + n) for b in range(k * n, a)] + [(1000, 1000), (1000, 5)], "u long, v long").repartition(2).union(spark.createDataFrame([(1001, None)], "u long, v long")).dropna()
    few = G.contracted(e.where("u > v")).collect()
    assert len(few) <= 3 * (4 * n)  # of 7,081 edges
    want = {(x, x // n * n) for x in range(4 * n)} | {(1000, 0)}
    assert {(r.node, r.root) for r in G.components(e).collect()} == want
    assert {(r.node, r.root) for r in G.components(G.contracted(e.where("u > v"), 1)).collect()} == want  # a part of one edge at a time


def test_a_gap_is_aligned_with_many_sequences_at_once():
    rng = np.random.default_rng(2)
    a, many = rng.integers(0, 3, 40), [rng.integers(0, 3, n) for n in (30, 0, 2, 55)]
    which, i, j, n = K.common_segments_of_all(a, many, 4, 1, 0.2)
    assert sorted(zip(which.tolist(), i.tolist(), j.tolist(), n.tolist())) == sorted((k, *s) for k, b in enumerate(many) for s in C.alignments(a.tolist(), b.tolist(), 4, 1, 0.2)) and len(n)


def test_chain_steps_take_no_round_for_each_ring(spark):
    """Chains hang on where no ring closes; a song with many rings took a round of jobs for each."""
    points = [(1, 3 * r + c, 100 * r + s, p) for r in range(4) for s in range(3) for p, c in enumerate([(s + k) % 3 for k in range(3)])]
    comps = spark.createDataFrame(points, "song long, comp int, seq_id long, pos int")
    with mock.patch.object(H2, "stored", side_effect=stored) as store:
        got = sorted(tuple(r) for r in H2.chain_steps(comps, 0.3).collect())
    assert got == [(1, 3 * r + c, 3 * r + c + 1) for r in range(4) for c in range(2)] and store.call_count == 1


def test_sigma_beta_study_ranks_cells_where_they_are_worked_out(spark):
    with mock.patch.object(tiles, "similarities", side_effect=AssertionError("all cells are rows")):
        assert plans.QUERIES["sigma_beta_study"](spark, "/root/testdata/sf0.001").count() == 90


def test_eigenvectors_of_long_series_need_no_matrix():
    """Beyond DENSE positions the labels come from the cells, and are those of the matrix."""
    import tracemalloc

    rng, n = np.random.default_rng(4), 700
    for i, j, whole in ((np.repeat(np.arange(n), 6), rng.integers(0, n, 6 * n), True), (np.append(np.arange(n - 1), 5), np.append(np.arange(1, n), 400), False)):
        i, j = np.divmod(np.unique(i * n + j), n)
        v = np.ones(len(i)) if whole else rng.random(len(i)) + 0.1
        want = K.laplacian_labels_of_cells(i, j, v, 4, whole=whole)
        with mock.patch.object(K, "DENSE", 10), mock.patch.object(K, "BASIS", 48):
            tracemalloc.start()
            got = K.laplacian_labels_of_cells(i, j, v, 4, whole=whole)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
        assert all((a == b).all() for a, b in zip(got, want)) and peak < n * n * 8


def test_diagonal_ratings_are_rounded_where_they_are_worked_out(spark):
    assert "round(" not in plan(plans.QUERIES["diagonal_ratings"](spark, "/root/testdata/sf0.001"))


def test_affinities_are_rounded_where_they_are_worked_out(spark):
    """Spark's round makes a decimal number for each of a matrix's cells."""
    for q in ("scaled_affinity", "mixed_affinity"):
        assert "round(v" not in plan(plans.QUERIES[q](spark, "/root/testdata/sf0.001"))
    f = A.features(spark, "/root/testdata/sf0.01").where("label < 2")
    exact = tiles.similarities(f, f, ["label"], upper=True).withColumn("v", F.round("v", 4))
    assert sorted(map(tuple, tiles.similarities(f, f, ["label"], upper=True, digits=4).collect())) == sorted(map(tuple, exact.collect()))
