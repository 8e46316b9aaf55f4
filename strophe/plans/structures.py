"""Cliques, closed matrices, sections and components over whole songs, and the corpus run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import cliques as Q
from ..operators import consensus as C
from ..operators import corpus as R
from ..operators import grammars as G
from ..operators import kernels as K
from ..operators import matrices as M
from ..operators import parts as N
from ..operators import profiles as P
from ..operators import statistics as S
from ..operators import structures as T
from ..operators import training as H
from ..sources import adapters as A
from .kernels import _matrix
from .registry import query


def _runs(spark, d, least):
    return M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where(F.col("len") >= least)


def _per_runs(runs, f, columns):
    return K.per_rows(runs, "seq_id", ["i0", "j0", "len"], f, columns)


@query()
def reinforced_segments(spark, d):
    return _per_runs(_runs(spark, d, 4), lambda segs: Q.reinforced_segments(segs, 0), "i0 int, j0 int, len int")


@query()
def rival_segments(spark, d):
    return _per_runs(_runs(spark, d, 4), lambda segs: [(*s, g) for s, g in zip(segs, Q.rival_groups(segs))], "i0 int, j0 int, len int, grp int")


@query()
def neighbour_choices(spark, d):
    cells = M.segment_cells(_runs(spark, d, 3), ["seq_id"])
    return K.per_group(cells, "seq_id", lambda f: [(v, x) for v, c in enumerate(Q.neighbour_choices(_matrix(f))) for x in c], "pos int, choice int")


@query()
def block_model(spark, d):
    cells = M.segment_cells(_runs(spark, d, 4), ["seq_id"])
    return K.per_group(cells, "seq_id", lambda f: list(enumerate(Q.blocks(_matrix(f)))), "pos int, block int")


@query()
def beam_hierarchical(spark, d):
    def f(segs):
        n = max(j + m for _, j, m in segs)
        target = np.zeros((n, n))
        for s in segs:
            target[T.cells_of(s)] = 1
        return T.beam_hierarchical([s for s in segs if s[2] >= 4], target, 3, 3)

    return _per_runs(_runs(spark, d, 2), f, "i0 int, j0 int, len int")


def _pruned(spark, d, how):
    def f(segs):
        m = T.noisy_closure(segs, max(j + n for _, j, n in segs))
        return [(int(i), int(j)) for i, j in np.argwhere(np.triu(how(m), 1) > 0)]

    return _per_runs(_runs(spark, d, 4), f, "i int, j int")


@query()
def prune_components(spark, d):
    return _pruned(spark, d, T.without_isolated_components)


@query()
def prune_rows(spark, d):
    return _pruned(spark, d, T.without_isolated_rows)


@query()
def prune_worst_rows(spark, d):
    return _pruned(spark, d, lambda m: T.without_isolated_rows(m, True))


@query()
def trim_components(spark, d):
    return _pruned(spark, d, T.trimmed_components)


@query()
def short_sections(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms])
        left, sections = G.without_homogeneous(*G.without_long_sections(left, sections, 0.2))
        return [(p, k, c) for p, cs in [(-1, left[0]), *sorted(sections.items())] for k, c in enumerate(cs)]

    return K.per_sequence(A.sequences(spark, d), f, "parent int, ord int, child int")


@query()
def similar_parts(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms[: len(syms) // 2], syms[len(syms) // 2 :]])
        return [(p, "-".join(map(str, a)), "-".join(map(str, b))) for p, a, b in G.similar_parts(left, sections, 0.3)]

    return K.per_sequence(A.sequences(spark, d), f, "similarity double, a string, b string")


@query()
def salient_labels(spark, d):
    return K.per_sequence(A.sequences(spark, d), lambda syms: list(enumerate(G.salient_labels([syms], 3)[0])), "pos int, section int")


@query()
def sections_by_coverage(spark, d):
    return K.per_sequence(A.sequences(spark, d), lambda syms: [(k, "-".join(map(str, s)), n) for k, (s, n) in enumerate(G.sections_by_coverage([syms]))], "ord int, symbols string, n int")


@query()
def flat_labels(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms])
        return [(k, p, x) for k, row in enumerate(G.layer_labels(G.section_layers(left[0], sections))) for p, x in enumerate(row)]

    return K.per_sequence(A.sequences(spark, d), f, "level int, pos int, label int")


@query()
def divided_layers(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms])
        rows = G.divided_layers(G.layer_labels(G.section_layers(left[0], sections)), list(range(0, len(syms), 7)))
        return [(k, p, x) for k, row in enumerate(rows) for p, x in enumerate(row)]

    return K.per_sequence(A.sequences(spark, d), f, "level int, pos int, label int")


@query()
def section_trees(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms])
        return [(f"(S {' '.join(G.tree_text(x, sections) for x in left[0])})",)]

    return K.per_sequence(A.sequences(spark, d), f, "tree string")


@query()
def grammar_probability(spark, d):
    """The logarithm of the probability of each half of a sequence under the grammar of both halves' sections."""

    def f(syms):
        left, sections, _ = G.induce([syms[: len(syms) // 2], syms[len(syms) // 2 :]])

        def tree(x):
            return (x, *[tree(y) for y in sections[x]]) if x in sections else x

        rules = G.grammar_of([("S", *[tree(x) for x in s]) for s in left])
        plain = [[y for x in s for y in G.expanded(x, sections)] for s in left]
        return [(k, round(float(np.log2(G.inside_probability(s, rules, "S"))), 6)) for k, s in enumerate(plain) if s]

    return K.per_sequence(A.sequences(spark, d), f, "half int, logp double")


@query()
def flanked_profile(spark, d):
    """Where each sequence goes through the longest stretch that its song's first sequence repeats (the first of equals)."""
    s = A.sequences(spark, d).withColumn("song", S.song())
    n_symbols = s.agg(F.max("sym")).first()[0] + 1
    runs = M.diag_segments(M.equality_cells(s), ["seq_id"]).withColumn("song", S.song())
    longest = runs.groupBy("song").agg(F.min(F.struct("seq_id", (-F.col("len")).alias("len"), "i0")).alias("x")).select("song", F.col("x.seq_id").alias("seq_id"), F.col("x.i0").alias("low"), (F.col("x.i0") - F.col("x.len")).alias("high"))
    pattern = s.join(longest, ["song", "seq_id"]).where("pos >= low and pos < high").groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]).alias("pattern"))
    packed = K.packed(s).withColumn("song", S.song()).join(pattern, "song")

    def decode(frames):
        for f in frames:
            rows = [(song, q, k, p) for song, q, syms, pat in f[["song", "seq_id", "syms", "pattern"]].itertuples(index=False) for k, p in enumerate(P.decoded(P.flanked([int(x) for x in pat], n_symbols), [int(x) for x in syms]))]
            yield pd.DataFrame(rows, columns=["song", "seq_id", "pos", "state"])

    return packed.mapInPandas(decode, "song long, seq_id long, pos int, state int")


def _song_profiles(spark, d):
    seqs = K.packed(A.sequences(spark, d)).withColumn("song", S.song())
    return (seqs, *H.trained(seqs, 3))


@query()
def trained_profile(spark, d):
    """Each song's sequences aligned by a model that is fitted to them by expected counts."""
    seqs, models, _ = _song_profiles(spark, d)
    return H.aligned(seqs, models).withColumn("score", F.round("score", 6))


@query()
def profile_likelihoods(spark, d):
    """How well songs' models fit their sequences before each round of training."""
    return _song_profiles(spark, d)[2].withColumn("likelihood", F.round("likelihood", 6))


@query()
def onset_hist_peaks(spark, d):
    h = S.onset_hist(A.grid(spark, d, "click"), A.grid(spark, d), 32)

    def f(frame):
        y = np.zeros(32)
        y[frame["bin"]] = frame["n"]
        return [(p,) for p in S.peaks(y, 0.02, 3)]

    return K.per_group(h, "seq_id", f, "bin int")


@query()
def simplified_form(spark, d):
    from ..operators.graphs import markov_form

    s = A.sequences(spark, d).withColumn("song", S.song("seq_id"))
    form = markov_form(s)

    def f(frame):
        edges = [(int(a), int(b)) for a, b in frame[["src", "dst"]].itertuples(index=False, name=None)]
        return sorted(G.without_detours(edges))

    return K.per_group(form.withColumn("form", F.lit(0)), "form", f, "src int, dst int")


def _songs(spark, d, partners=20):
    return R.songs(A.sequences(spark, d), partners, 6, 2, 0.4)


def _song_segments(spark, d, partners=20):
    return R.song_segments(A.sequences(spark, d), partners, 6, 2, 0.4)


def _points(comps, ids):
    return [(k, ids[s], p) for k, c in enumerate(comps) for s, p in c]


@query()
def supported_components(spark, d):
    return N.supported_parts(_song_segments(spark, d), "song", 8, 1)


@query()
def aligned_components(spark, d):
    return N.linked_parts(_song_segments(spark, d), "song", 8)


@query()
def component_chains(spark, d):
    return R.per_song(_songs(spark, d), lambda ids, seqs, segs: [(n, k, c) for n, chain in enumerate(C.chains(C.connected_components(segs, 8), 0.3)) for k, c in enumerate(chain)], "chain int, ord int, comp int")


@query()
def filled_components(spark, d):
    return R.per_song(_songs(spark, d), lambda ids, seqs, segs: _points(C.filled(C.connected_components(segs, 8), seqs, 0.3), ids), "comp int, seq_id long, pos int")


def _labels(rows, ids):
    return [(ids[s], p, x) for s, row in enumerate(rows) for p, x in enumerate(row)]


@query()
def realigned_gaps(spark, d):
    def f(ids, seqs, segs):
        return _labels(C.realigned(C.labels_of(C.connected_components(segs, 8), [len(s) for s in seqs]), seqs, 4, 1, 0.4), ids)

    return R.per_song(_songs(spark, d), f, "seq_id long, pos int, label int")


@query()
def smoothed_labels(spark, d):
    def f(ids, seqs, segs):
        labels = C.labels_of(C.connected_components(segs, 8), [len(s) for s in seqs])
        flat = G.sections_by_coverage([[x + 1 for x in row] for row in labels])
        return _labels(C.smoothed_labels(labels, [([x - 1 for x in s], n) for s, n in flat], (0.3, 0.1, 0.03), 2), ids)

    return R.per_song(_songs(spark, d), f, "seq_id long, pos int, label int")


@query()
def layered_labels(spark, d):
    def f(ids, seqs, segs):
        n = [len(s) for s in seqs]
        layers = [C.labels_of(C.connected_components([s for s in segs if s[4] >= least], 8), n) for least in (6, 8, 10)]
        return _labels(C.layered_labels(layers), ids)

    return R.per_song(_songs(spark, d), f, "seq_id long, pos int, label int")


@query()
def corpus_run(spark, d):
    return R.run(A.sequences(spark, d), 20, 6, 2, 0.4)


@query()
def partner_sweep(spark, d):
    return R.partner_sweep(A.sequences(spark, d), list(range(11)), 6, 2, 0.4)


@query()
def preprocessed(spark, d):
    return R.preprocessed(A.sequences(spark, d), A.grid(spark, d), 0.0002, 0.0006)
