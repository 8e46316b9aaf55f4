"""Sequential algorithms, applied sequence by sequence, pair by pair or series by series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import matrices as M
from ..operators import statistics as S
from ..operators import tiles as T
from ..sources import adapters as A
from .registry import query


@query()
def smith_waterman(spark, d):
    s = A.sequences(spark, d)
    return K.local_alignments(s, S.pairings(s))


@query()
def sw_similarity(spark, d):
    s = A.sequences(spark, d)
    return K.sw_similarity(s, S.pairings(s)).withColumn("similarity", F.round("similarity", 6))


def _matrix(frame) -> np.ndarray:
    n = int(max(frame["i"].max(), frame["j"].max())) + 1 if len(frame) else 0
    m = np.zeros((n, n))
    m[frame["i"], frame["j"]] = frame["v"] if "v" in frame else 1.0
    return m


@query()
def best_segments(spark, d):
    return T.per_matrix(A.features(spark, d), "label", lambda m: K.best_segments(m, 5, 12, 2, 90, 0.2, 0.05), "i0 int, j0 int, len int")


@query()
def filter_segments(spark, d):
    segs = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 2")
    return K.per_group(segs, "seq_id", lambda f: K.filter_segments(sorted(f[["i0", "j0", "len"]].itertuples(index=False, name=None)), 10, 2, 2, True), "i0 int, j0 int, len int")


def _components(label: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(*(x.tolist() for x in K.pairs_within(label))))


def _cells(m: np.ndarray) -> list[tuple[int, int]]:
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(m, 1) > 0)]


@query()
def transitive_construction(spark, d):
    return T.per_matrix(A.features(spark, d), "label", lambda m: _components(K.transitive_labels(np.maximum(m, 0))), "i int, j int")


@query()
def make_hierarchical(spark, d):
    cells = M.equality_cells(A.sequences(spark, d))
    return K.per_group(cells, "seq_id", lambda f: _cells(K.greedy_hierarchical(K.diagonal_runs(m := _matrix(f)), m, 4)), "i int, j int")


@query()
def constrained_components(spark, d):
    segs = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 3")

    def f(frame):
        rows = sorted(frame[["len", "i0", "j0"]].itertuples(index=False, name=None), key=lambda r: (-r[0], r[1], r[2]))
        edges = [((0, i + k), (0, j + k)) for m, i, j in rows for k in range(m)]
        return [(n, p) for n, c in enumerate(K.constrained_components(edges, 8)) for _, p in c]

    return K.per_group(segs, "seq_id", f, "comp int, pos int")


@query()
def laplacian_labels(spark, d):
    f = A.features(spark, d)
    cells = M.nearest_cells(f, f, ["label"], 0.5)
    return K.per_group(cells, "label", lambda f: [(k, p, int(x)) for k, lab in enumerate(K.laplacian_labels_of_cells(f["i"].to_numpy(), f["j"].to_numpy(), np.ones(len(f)))) for p, x in enumerate(lab)], "level int, pos int, cluster int")


@query()
def profile_msa(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("seq_id"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("song"))
    s = K.packed(A.order_sequences(spark, d)).join(c, "seq_id")

    def f(frame):
        frame = frame.sort_values("seq_id")
        paths = K.profile_msa([[int(x) for x in s] for s in frame["syms"]], 5)
        return [(int(i), k, p) for i, path in zip(frame["seq_id"], paths) for k, p in enumerate(path)]

    return K.per_group(s, "song", f, "seq_id long, pos int, state int")


@query()
def optics_clusters(spark, d):
    h = S.frequency_hist(A.sequences(spark, d), relative=True).withColumn("song", F.floor(F.col("seq_id") / 50))

    def f(frame):
        t = frame.pivot_table(index="seq_id", columns="sym", values="n", fill_value=0.0).sort_index()
        x = t.to_numpy(float)
        dist = 0.5 * ((x[:, None] - x[None]) ** 2 / (x[:, None] + x[None] + 1e-6)).sum(2)
        return [(int(i), int(c)) for i, c in zip(t.index, K.optics_clusters(dist))]

    return K.per_group(h, "song", f, "seq_id long, cluster int")


@query()
def maximal_cliques(spark, d):
    cells = M.segment_cells(M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 4"), ["seq_id"])
    return K.per_group(cells, "seq_id", lambda f: [(n, v) for n, c in enumerate(c for c in K.maximal_cliques(_matrix(f)) if len(c) > 2) for v in c], "clique int, pos int")


@query()
def simple_structure(spark, d):
    def f(m):
        return [(n, k, lab, dur) for n, (labs, durs) in enumerate(K.simple_structure(np.maximum(m, 0))) for k, (lab, dur) in enumerate(zip(labs, durs))]

    return T.per_matrix(A.features(spark, d), "label", f, "level int, ord int, sec int, duration int")
