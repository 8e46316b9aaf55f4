"""Training of profile models against a plain hidden Markov model over all states."""

import math

import numpy as np
import pytest

from strophe.operators import training as T


def states(model):
    """All states of a model but begin and end, with what they may lead to: {state: [(next, p)]}, begin being (MATCH, 0) and the end None."""
    t, _, _ = model
    n = t.shape[1] - 1
    out = {}
    for k in range(n + 1):
        for s in (T.INSERT, T.MATCH, T.DELETE):
            if s == T.DELETE and k == 0:
                continue
            to = [((T.INSERT, k), t[s, k, T.INSERT])]
            to.append((None if k == n else (T.MATCH, k + 1), t[s, k, T.MATCH]))
            if k < n:
                to.append(((T.DELETE, k + 1), t[s, k, T.DELETE]))
            out[s, k] = [(x, p) for x, p in to if p > 0]
    return out


def all_ways(model, seq):
    """(probability, states) of every way that emits a sequence."""
    graph, (_, e_i, e_m) = states(model), model

    def go(state, i, p, way):
        for to, q in graph[state]:
            if to is None:
                if i == len(seq):
                    yield p * q, way
            elif to[0] == T.DELETE:
                yield from go(to, i, p * q, [*way, to])
            elif i < len(seq):
                e = (e_i if to[0] == T.INSERT else e_m)[to[1], seq[i]]
                if e > 0:
                    yield from go(to, i + 1, p * q * e, [*way, to])

    return list(go((T.MATCH, 0), 0, 1.0, []))


def plain_counts(model, seqs):
    t, e_i, e_m = (np.zeros_like(x) for x in model)
    total = 0.0
    for seq in seqs:
        ways = all_ways(model, seq)
        whole = sum(p for p, _ in ways)
        total += math.log(whole)
        for p, way in ways:
            at, i = (T.MATCH, 0), 0
            for to in [*way, None]:
                kind = T.MATCH if to is None else to[0]
                t[at[0], at[1], kind] += p / whole
                if to is not None and kind != T.DELETE:
                    (e_i if kind == T.INSERT else e_m)[to[1], seq[i]] += p / whole
                    i += 1
                at = to
    return t, e_i, e_m, total


def some_model(rng, length, symbols):
    t, e_i, e_m = T.initial(length, symbols)
    t = t * rng.uniform(0.2, 1, t.shape)
    t = np.divide(t, t.sum(2, keepdims=True), out=np.zeros_like(t), where=t.sum(2, keepdims=True) > 0)
    e_i, e_m = (e * rng.uniform(0.1, 1, e.shape) for e in (e_i, e_m))
    e_i /= e_i.sum(1, keepdims=True)
    e_m[1:] /= e_m[1:].sum(1, keepdims=True)
    return t, e_i, e_m


@pytest.mark.parametrize("length", [0, 1, 2, 4])
def test_expected_counts_are_those_of_all_ways(length):
    rng = np.random.default_rng(length)
    model = some_model(rng, length, 3)
    seqs = [rng.integers(0, 3, n).tolist() for n in (0, 1, 2, 5, 3, 4) if n or length]
    got, want = T.expected(*model, seqs), plain_counts(model, seqs)
    for g, w in zip(got, want):
        assert np.allclose(g, w, atol=1e-9)


@pytest.mark.parametrize("length", [1, 3, 4])
def test_the_likeliest_way_is_the_best_of_all(length):
    rng = np.random.default_rng(10 + length)
    model = some_model(rng, length, 4)
    for n in (0, 1, 2, 5):
        seq = rng.integers(0, 4, n).tolist()
        p, way = max(all_ways(model, seq))
        path, score = T.likeliest(*model, seq)
        assert math.isclose(score, math.log(p), abs_tol=1e-9)
        assert path == [k - 1 if s == T.MATCH else -1 for s, k in way if s != T.DELETE]


def test_the_start_is_a_model():
    t, e_i, e_m = T.initial(3, 5)
    sums = t.sum(2)
    assert np.allclose(sums[sums > 0], 1) and np.allclose(e_i.sum(1), 1) and np.allclose(e_m.sum(1)[1:], 1)
    assert np.allclose(t[T.MATCH, 1], [0.05, 0.9, 0.05]) and np.allclose(t[T.DELETE, 1], [0.1, 0.45, 0.45]) and np.allclose(t[T.INSERT, 3], [1 / 3, 2 / 3, 0])


def packed(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "song long, seq_id long, syms array<int>, what string")


def some_songs(rng, n=24):
    rows = []
    for song in range(2):
        base = rng.integers(0, 4, 9).tolist()
        for v in range(n):
            rows.append((song, 100 * song + v, [x if rng.random() < 0.85 else int(rng.integers(0, 4)) for x in base if rng.random() < 0.9]))
    return rows


@pytest.mark.parametrize("batch", [5, 256])
def test_rounds_are_those_of_plain_counting_and_never_lower_the_likelihood(spark, monkeypatch, batch):
    monkeypatch.setattr(T, "BATCH", batch)
    rows = some_songs(np.random.default_rng(3))
    models, history = T.trained(packed(spark, rows + [(None, 7, [1]), (5, 8, None)]), 4, dist_inertia=0.3, edge_inertia=0.5, pseudocount=0.0)
    said = {(r.song, r.round): r.likelihood for r in history.collect()}
    got = models.toPandas()
    for song in range(2):
        seqs = [s for g, _, s in rows if g == song]
        lengths = sorted(map(len, seqs))
        median = (lengths[len(lengths) // 2] + lengths[(len(lengths) - 1) // 2]) // 2
        length = min(lengths, key=lambda n: (abs(n - median), n))
        t, e_i, e_m = T.initial(length, max(map(max, seqs)) + 1, 0.999, 0.01)
        for r in range(4):
            n_t, n_i, n_m, total = T.expected(t, e_i, e_m, seqs)
            assert math.isclose(total, said[song, r], rel_tol=1e-9)
            mix = lambda old, n, keep: np.where(n.sum(-1, keepdims=True) > 0, keep * old + (1 - keep) * n / np.maximum(n.sum(-1, keepdims=True), 1e-300), old)
            t, e_i, e_m = mix(t, n_t, 0.5), mix(e_i, n_i, 0.3), mix(e_m, n_m, 0.3)
        a = T._as_arrays(got[got["song"] == song])
        assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(a, (t, e_i, e_m)))
        ways = [said[song, r] for r in range(4)]
        assert all(b >= a - 1e-9 for a, b in zip(ways, ways[1:]))


def test_alignment_finds_what_songs_share(spark):
    """Versions of a song that has a symbol of its own at each place match it at one position each."""
    rng = np.random.default_rng(8)
    rows = [(1, v, [x for x in range(8) if rng.random() < 0.85]) for v in range(40)]
    df = packed(spark, rows)
    models, _ = T.trained(df, 12, 0.9, 0.1, 0.0, 0.0)
    at = {}
    for r in T.aligned(df, models).collect():
        at.setdefault(dict((i, s) for _, i, s in rows)[r.seq_id][r.pos], []).append(r.state)
    common = [max(set(v), key=v.count) for v in at.values()]
    share = sum(v.count(c) for v, c in zip(at.values(), common)) / sum(map(len, at.values()))
    assert share > 0.8 and len({c for c in common if c >= 0}) >= 5


def test_empty_tables(spark):
    models, history = T.trained(packed(spark, []), 1)
    assert models.count() == history.count() == T.aligned(packed(spark, []), models).count() == 0
