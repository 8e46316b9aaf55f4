"""Sequential algorithms over whole tables against plain versions that share none of their code."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from strophe import plans
from strophe.operators import cliques as Q
from strophe.operators import consensus as C
from strophe.operators import grammars as G
from strophe.operators import hierarchies as H
from strophe.operators import kernels as K
from strophe.operators import profiles as P
from strophe.operators import statistics as S
from strophe.operators import structures as T
from strophe.operators import translations as X
from strophe.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seqs(spark):
    out = defaultdict(dict)
    for r in A.sequences(spark, SF).collect():
        out[r.seq_id][r.pos] = r.sym
    return {k: [v[p] for p in sorted(v)] for k, v in out.items()}


def rows(spark, name):
    return [tuple(r) for r in plans.QUERIES[name](spark, SF).collect()]


def runs_of(seq, least):
    out = []
    n = len(seq)
    for d in range(1, n):
        i = 0
        while i + d < n:
            m = 0
            while i + d + m < n and seq[i + m] == seq[i + d + m]:
                m += 1
            if m >= least:
                out.append((i, i + d, m))
            i += m + 1
    return sorted(out)


# Alignment


def plain_local(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (3 if x == y else -3), h[i - 1][j] - 5, h[i][j - 1] - 5)
    path, n, m = [], len(a) + 1, len(b) + 1
    while True:
        best = max((h[i][j], i, j) for i in range(n) for j in range(m)) if n and m else (0, 0, 0)
        if best[0] <= 0:
            return path[::-1]
        path.append((best[1] - 1, best[2] - 1))
        n, m = best[1], best[2]


def test_local_alignments_of_all_pairs(spark, seqs):
    found = defaultdict(list)
    for a, b, k, i, j in rows(spark, "smith_waterman"):
        found[a, b].append((k, i, j))
    pairs = {tuple(r) for r in plans.QUERIES["pairings"](spark, SF).select("a", "b").collect()}
    similar = {(a, b): s for a, b, s in rows(spark, "sw_similarity")}
    for a, b in sorted(pairs)[::4]:
        want = plain_local(seqs[a], seqs[b])
        assert [x[1:] for x in sorted(found[a, b])] == want
        assert similar[a, b] == pytest.approx(len(want) / max(len(seqs[a]), len(seqs[b])), abs=1e-6)


# Curves


def plain_curve(x, y, frac):
    k = max(2, min(len(x), int(frac * len(x) + 1e-10)))
    out = []
    for p in x:
        near = sorted(range(len(x)), key=lambda j: (abs(x[j] - p), j))[:k]
        h = max(abs(x[j] - p) for j in near)
        if h == 0:
            out.append(sum(y[j] for j in near) / k)
            continue
        w = [max(0.0, 1 - (abs(x[j] - p) / h) ** 3) ** 3 for j in near]
        a = np.array([[1.0, x[j] - p] for j in near])
        m = a.T @ (np.array(w)[:, None] * a)
        out.append(float(np.linalg.lstsq(m, a.T @ (np.array(w) * np.array([y[j] for j in near])), rcond=None)[0][0]))
    return out


def dated(spark):
    data = defaultdict(lambda: defaultdict(list))
    for r in plans.evolution._curve(spark, SF).collect():
        data[r.grp][r.x].append(r.y)
    return {g: {x: sum(v) / len(v) for x, v in d.items()} for g, d in data.items()}


def test_curves_are_weighted_regressions(spark):
    data = dated(spark)
    got = {(g, x): y for g, x, y in rows(spark, "lowess")}
    for g, d in sorted(data.items())[:2]:
        xs = sorted(d)
        for x, y in list(zip(xs, plain_curve(xs, [d[v] for v in xs], 0.2)))[::7]:
            assert got[g, x] == pytest.approx(y, abs=2e-5)


def test_bands_leave_out_a_group_each(spark):
    raw = defaultdict(list)
    means = dated(spark)
    for g, d in means.items():
        for x, y in d.items():
            raw[x].append((g, y))
    curves = []
    for left in sorted(means):
        pts = {x: [y for g, y in v if g != left] for x, v in raw.items()}
        xs = sorted(x for x, v in pts.items() if v)
        curves.append(dict(zip(xs, plain_curve(xs, [sum(pts[x]) / len(pts[x]) for x in xs], 0.2))))
    for x, _, lo, hi in sorted(rows(spark, "lowess_loo_band"))[::60]:
        at = [c[x] for c in curves if x in c]
        assert lo == pytest.approx(min(at), abs=2e-5) and hi == pytest.approx(max(at), abs=2e-5)


# Sections


def plain_pairs(seq):
    """Pairs that count, from a list in which repetitions of a pair are numbered."""
    pairs = [tuple(seq[k : k + 2]) for k in range(len(seq) - 1)]
    out, number = [], 0
    for k in range(len(pairs) - 1):
        number = number + 1 if pairs[k] == pairs[k + 1] else 0
        if number % 2 == 0:
            out.append(pairs[k])
    return out


def plain_induction(seq):
    seq, sections, where = list(seq), {}, {}
    at, n = list(range(len(seq))), max(seq) + 1
    while True:
        count = {}
        for p in plain_pairs(seq):
            count[p] = count.get(p, 0) + 1
        best = [p for p in count if count[p] == max(count.values())]
        if not best or count[best[0]] < 2:
            break
        pair, k = best[0], 0
        sections[n], where[n] = list(pair), []
        while k < len(seq) - 1:
            if (seq[k], seq[k + 1]) == pair:
                where[n].append(at[k])
                seq[k : k + 2] = [n]
                at[k : k + 2] = [at[k]]
            k += 1
        n += 1
    return seq, sections, where


def test_sections_of_all_sequences(spark, seqs):
    got = defaultdict(lambda: defaultdict(dict))
    for s, parent, k, child in rows(spark, "pair_induction"):
        got[s][parent][k] = child

    def flat(x, sections):
        return [y for p in sections[x] for y in flat(p, sections)] if x in sections else [x]

    for s, seq in seqs.items():
        left, sections, _ = plain_induction(seq)
        assert [y for x in left for y in flat(x, sections)] == seq
        mine = {p: [c[k] for k in sorted(c)] for p, c in got[s].items()}
        # sections that stand once and inside one other are put into it, so what is left is among the plain ones, by their symbols
        plain = {tuple(flat(x, sections)) for x in sections}
        induced = {p for p in mine if p in sections}
        assert {tuple(flat(p, mine)) for p in induced} <= plain
        for x in set(sections) - induced:
            assert sum(x in v for v in sections.values()) == 1


def test_layers_and_salient_sections(spark, seqs):
    layers = defaultdict(lambda: defaultdict(dict))
    for s, level, k, label, duration in rows(spark, "section_layers"):
        layers[s][level][k] = (label, duration)
    flat = defaultdict(dict)
    for s, level, p, label in rows(spark, "flat_labels"):
        flat[s, level][p] = label
    for s, by_level in layers.items():
        for level, row in by_level.items():
            want = [lab for k in sorted(row) for lab in [row[k][0]] * row[k][1]]
            assert len(want) == len(seqs[s]) and [flat[s, level][p] for p in range(len(want))] == want
    labels = defaultdict(dict)
    for s, p, x in rows(spark, "salient_labels"):
        labels[s][p] = x
    sizes = defaultdict(list)
    for s, section, size, n in rows(spark, "most_salient"):
        sizes[s].append((section, size, n))
    for s, row in labels.items():
        top = {x[0] for x in sorted(sizes[s], key=lambda x: -x[1] * x[2])}
        assert {x for x in row.values() if x >= 0} <= top
        count = Counter(row.values())
        for section, size, n in sizes[s]:
            assert count.get(section, 0) in (0, size * n)


def test_coverage_orders_sections(spark, seqs):
    found = defaultdict(list)
    for s, k, symbols, n in rows(spark, "sections_by_coverage"):
        found[s].append((k, symbols.split("-"), n))
    for s, xs in found.items():
        weight = [len(sym) * n for _, sym, n in sorted(xs)]
        assert weight == sorted(weight, reverse=True)
        for _, sym, _ in xs:
            assert G.occurs_in([int(x) for x in sym], seqs[s])


def test_grammar_probabilities_add_up():
    rules = {"S": [(("A", "B"), 0.6), (("A",), 0.4)], "A": [((1,), 0.5), ((1, 1), 0.5)], "B": [((1,), 0.25), ((2,), 0.75)]}
    plain = defaultdict(float)
    for a, pa in ((1,), 0.5), ((1, 1), 0.5):
        plain[a] += 0.4 * pa
        for b, pb in ((1,), 0.25), ((2,), 0.75):
            plain[a + b] += 0.6 * pa * pb
    for seq, p in plain.items():
        assert G.inside_probability(list(seq), rules, "S") == pytest.approx(p)
    assert sum(G.inside_probability(list(s), rules, "S") for n in (1, 2, 3) for s in itertools.product((1, 2), repeat=n)) == pytest.approx(1)
    assert G.inside_probability([3], rules, "S") == 0 == G.inside_probability([], rules, "S")
    assert G.grammar_of([("S", ("A", 1), 2), ("S", 2, 2)]) == {"S": [(("A", 2), 0.5), ((2, 2), 0.5)], "A": [((1,), 1.0)]}
    assert G.inside_probability([1], {"S": [(("S",), 0.5), ((1,), 0.5)]}, "S") == 0.5


def test_parts_of_sections():
    sections = {10: [1, 2], 11: [10, 3], 12: [11, 11], 13: [4, 4, 4]}
    assert G.parts([12, 5], sections) == [11, 11, 10, 3, 10, 3, 1, 2, 1, 2]
    assert G.split_at_recurring([[1, 2, 3, 1], [4, 3]]) == [[1], [2], [3], [4]]
    assert G.without_homogeneous([[13, 1]], sections)[0] == [[4, 4, 4, 1]] and 13 not in G.without_homogeneous([[13]], sections)[1]
    assert G.without_long_sections([[12, 1, 1, 1, 1]], sections, 0.4) == ([[11, 11, 1, 1, 1, 1]], {10: [1, 2], 11: [10, 3], 13: [4, 4, 4]})
    assert G.homogeneous({1: [2, 3]}) is None
    assert G.dependent([(1.0, (10,), (13,)), (1.0, (11,), (13, 4))], sections) == [(0, 1)]
    assert G.tree_text(11, sections) == "(11 (10 1 2) 3)"
    assert G.divided_layers([[1, 1, 1, 1], [2, 2, 3, 3]], [2]) == [[4, 4, 1, 1], [2, 2, 3, 3]]
    assert G.divided_layers([[1, 1, 1, 1], [2, 3, 2, 3]], [2]) == [[1, 1, 1, 1], [2, 3, 2, 3]]


def test_detours_go():
    edges = [(0, 1), (1, 2), (1, 5), (5, 2), (2, 3), (3, 4), (3, 6), (6, 7)]
    assert G.alternatives(edges) == [[[1, 2], [1, 5, 2]]]
    assert G.without_detours(edges) == [(0, 1), (1, 2), (2, 3), (3, 4), (3, 6), (6, 7)]
    assert G.ways_until_join(1, 2, {1: [3], 2: [1]}) == [[1], [2, 1]]
    assert G.ways_until_join(1, 2, {1: [3, 4], 2: [5, 6]}) is None


# Matrices


def plain_closure(n, segs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j, m in segs:
        for k in range(m):
            a, b = sorted((find(i + k), find(j + k)))
            root[b] = a
    return np.array([[float(find(a) == find(b)) for b in range(n)] for a in range(n)])


def test_closures_and_runs(seqs):
    for seq in seqs.values():
        segs = runs_of(seq, 4)
        if segs:
            n = max(j + m for _, j, m in segs)
            assert np.array_equal(T.noisy_closure(segs, n), plain_closure(n, segs))
        m = np.array([[float(x == y) for y in seq] for x in seq])
        assert sorted(s for s in K.diagonal_runs(m) if s[2] >= 3) == runs_of(seq, 3)


def test_best_segments_are_the_greedy_ones(spark):
    cells = defaultdict(dict)
    for r in plans.matrices.M.ssm(A.features(spark, SF), "label").collect():
        cells[r.label][r.i, r.j] = r.v
    got = defaultdict(list)
    for label, i, j, m in rows(spark, "best_segments"):
        got[label].append((i, j, m))
    for label in sorted(cells)[:2]:
        v = cells[label]
        n = max(i for i, _ in v) + 1
        scores = {}
        for d in range(1, n):
            for p in range(n - d):
                for m in range(5, 13):
                    if p + m <= n - d:
                        scores[d, p, m] = round(sum(v[p + k, p + d + k] for k in range(m)) / m * m**0.2, 12)
        least = max(np.percentile(list(scores.values()), 90), 0.05)
        left = {k for k, s in scores.items() if s > least}
        want = []
        for d, p, m in sorted(left, key=lambda k: (-scores[k], k)):
            if (d, p, m) in left:
                left -= {x for x in left if abs(x[0] - d) < 2 and x[1] >= p and x[1] + x[2] <= p + m}
                want.append((p, p + d, m))
        assert sorted(got[label]) == sorted(want)


def test_filtered_segments(spark, seqs):
    got = defaultdict(list)
    for s, i, j, m in rows(spark, "filter_segments"):
        got[s].append((i, j, m))
    for s, seq in list(seqs.items())[:6]:
        left = [x for x in runs_of(seq, 2) if x[1] - x[0] > 1]
        taken, refs = [], [(0, 0, 10**9)]

        def weight(x, refs=refs):
            near = [abs((x[1] - x[0]) - (r[1] - r[0])) for r in refs if set(range(x[0], x[0] + x[2])) & set(range(r[0], min(r[0] + r[2], 10**4)))]
            return x[2] * min(near, default=1)

        if len(left) > 10:
            while left and len(taken) < 10:
                best = min(left, key=lambda x: (-weight(x), x))
                taken.append(best)
                refs.append(best)
                new = []
                for i, j, m in left:
                    if (i, j, m) == best:
                        continue
                    keep = [k for k in range(m) if abs((j - i) - (best[1] - best[0])) >= 2 or not best[0] <= i + k < best[0] + best[2]]
                    for _, g in itertools.groupby(enumerate(keep), lambda x: x[1] - x[0]):
                        g = [k for _, k in g]
                        if len(g) >= 2:
                            new.append((i + g[0], j + g[0], len(g)))
                left = new
            assert sorted(got[s]) == sorted(taken)
        else:
            assert sorted(got[s]) == sorted(left)


def test_constructed_matrices_are_closed_and_keep_their_distances(spark):
    cells = defaultdict(set)
    for label, i, j in rows(spark, "transitive_construction"):
        cells[label].add((i, j))
    assert cells
    for found in cells.values():
        n = max(j for _, j in found) + 1
        assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if plain_closure(n, [(a, b, 1) for a, b in found])[i, j]}
        assert all(j - i >= 4 for i, j in found)


def test_greedy_hierarchies_never_get_worse(spark, seqs):
    cells = defaultdict(set)
    for s, i, j in rows(spark, "make_hierarchical"):
        cells[s].add((i, j))
    for s, found in cells.items():
        n = len(seqs[s])
        assert found == {(int(a), int(b)) for a, b in np.argwhere(np.triu(plain_closure(n, [(a, b, 1) for a, b in found]), 1))}
        target = {(a, b) for a in range(n) for b in range(a + 1, n) if seqs[s][a] == seqs[s][b]}

        def f(m, target=target):
            hit = len(m & target)
            p, r = hit / max(1, len(m)), hit / max(1, len(target))
            return (1 + 0.25**2) * p * r / (0.25**2 * p + r) if hit else 0.0

        first = max((x for x in runs_of(seqs[s], 4)), key=lambda x: (x[2], -x[0], -x[1]), default=None)
        if first:
            alone = {(int(a), int(b)) for a, b in np.argwhere(np.triu(plain_closure(n, [first]), 1))}
            assert f(found) >= f(alone) - 1e-9


def test_beam_search_is_no_worse_than_its_first_step(seqs):
    for seq in list(seqs.values())[:8]:
        segs = runs_of(seq, 2)
        n = max(j + m for _, j, m in segs)
        target = np.zeros((n, n))
        for s in segs:
            target[T.cells_of(s)] = 1
        long = [s for s in segs if s[2] >= 4]
        got = T.beam_hierarchical(long, target, 3, 2)
        full = np.maximum(target, target.T) > 0
        if long:
            best = min(T.distance(plain_closure(n, [v]), full) for s in long for v in [s])
            assert T.distance(plain_closure(n, got), full) <= best + 1e-9
    assert T.variations((3, 8, 4), 20, 2) == [(1, 6, 6), (2, 7, 5), (3, 8, 4), (4, 9, 3), (5, 10, 2)]
    assert T.variations((3, 8, 4), 13, 2, True) == [(3, 8, 5), (3, 8, 4), (3, 8, 3), (3, 8, 2)]


def test_pruned_matrices_have_no_isolated_cells(seqs):
    for seq in seqs.values():
        segs = runs_of(seq, 3)
        if not segs:
            continue
        n = max(j + m for _, j, m in segs)
        m = plain_closure(n, segs)
        plain = {(i, j) for i in range(n) for j in range(n) if m[i, j] and not (i and j and m[i - 1, j - 1]) and not (i < n - 1 and j < n - 1 and m[i + 1, j + 1])}
        assert {(int(a), int(b)) for a, b in np.argwhere(T.isolated(m))} == plain
        for how in (T.without_isolated_components, lambda x: T.without_isolated_rows(x, True)):
            p = how(m)
            off = T.isolated(p) & ~np.eye(n, dtype=bool)
            assert not off.any() and (p <= m).all()
        assert (T.without_isolated_rows(m) <= m).all()
        t = T.trimmed_components(m)
        assert np.array_equal(t, plain_closure(n, [(int(a), int(b), 1) for a, b in np.argwhere(np.triu(t, 1))])) and (t <= m).all()


def test_hierarchical_patterns_are_closed(seqs):
    for seq in list(seqs.values())[:8]:
        segs = runs_of(seq, 4)
        if segs:
            n = max(j + m for _, j, m in segs)
            got = X.hierarchical_patterns(segs, n, 2)
            m = plain_closure(n, got)
            cells = {(i + k, j + k) for i, j, s in got for k in range(s)}
            longer = {c for c in map(tuple, np.argwhere(np.triu(m, 1)).tolist())}
            assert cells <= longer
            assert len(segs) == 0 or got


# Graphs


def plain_cliques(near):
    out = []

    def grow(taken, left):
        if not any(all(v in near[u] for u in taken) for v in range(len(near)) if v not in taken):
            out.append(tuple(sorted(taken)))
        for k, v in enumerate(left):
            grow(taken | {v}, [w for w in left[k + 1 :] if w in near[v]])

    for v in range(len(near)):
        grow({v}, [w for w in range(v + 1, len(near)) if w in near[v]])
    return set(out)


@pytest.mark.parametrize("seed", range(4))
def test_maximal_cliques_of_random_graphs(seed):
    r = np.random.default_rng(seed)
    a = np.triu(r.random((12, 12)) < 0.5, 1).astype(float)
    near = [set(np.flatnonzero(a[v] + a[:, v]).tolist()) for v in range(12)]
    assert {tuple(c) for c in K.maximal_cliques(a)} == plain_cliques(near)


def test_maximal_cliques_of_all_sequences(spark, seqs):
    got = defaultdict(lambda: defaultdict(set))
    for s, c, p in rows(spark, "maximal_cliques"):
        got[s][c].add(p)
    for s, seq in list(seqs.items())[:6]:
        n = len(seq)
        near = [set() for _ in range(n)]
        for i, j, m in runs_of(seq, 4):
            for k in range(m):
                near[i + k].add(j + k)
                near[j + k].add(i + k)
        assert {tuple(sorted(c)) for c in got[s].values()} == {c for c in plain_cliques(near) if len(c) > 2}


def plain_components(edges, least):
    comps = []
    for p, q in edges:
        a = next((c for c in comps if p in c), None)
        b = next((c for c in comps if q in c), None)
        new = (a or {p}) | (b or {q})
        if a is not None and a is b:
            continue
        added = new - (a or b or set()) if a is None or b is None else new  # a single point is held against the others
        far = all(x[0] != y[0] or abs(x[1] - y[1]) >= least for x, y in itertools.combinations(new, 2) if x in added or y in added)
        if far or (a is None and b is None):
            comps = [c for c in comps if c is not a and c is not b] + [new]
    return {tuple(sorted(c)) for c in comps}


def test_constrained_components_of_all_sequences(spark, seqs):
    got = defaultdict(lambda: defaultdict(set))
    for s, c, p in rows(spark, "constrained_components"):
        got[s][c].add((0, p))
    for s, seq in list(seqs.items())[:8]:
        order = sorted(runs_of(seq, 3), key=lambda x: (-x[2], x[0], x[1]))
        edges = [((0, i + k), (0, j + k)) for i, j, m in order for k in range(m)]
        assert {tuple(sorted(c)) for c in got[s].values()} == plain_components(edges, 8)


def test_unions_of_sets_without_rivals():
    group = {1: 0, 2: 1, 3: 2, 4: 0, 5: 3}
    sets = {(1, 2): 3, (2, 3): 2, (3, 4): 4, (5,): 1}
    got = Q.union_cliques(sets, group)
    every = {}
    for n in range(1, 5):
        for some in itertools.combinations(sets, n):
            u = tuple(sorted(set().union(*some)))
            if len({group[x] for x in u}) == len(u):
                every[u] = max(every.get(u, 0), sum(sets[s] for s in some))
    assert max(got.values()) == max(every.values()) and min(got, key=lambda s: (-got[s], s)) in every
    assert Q.absorbed({(1,): 2, (1, 2): 1, (1, 2, 3): 5, (4,): 1}) == {(1, 2, 3): 8, (4,): 1}
    assert Q.rival_groups([(0, 10, 3), (0, 11, 3), (5, 30, 2)]) == [0, 0, 2]
    assert Q.runs_of([3, 1, 2, 7]) == [[1, 2, 3], [7]]


def test_reinforced_segments_have_no_rivals(seqs):
    for seq in seqs.values():
        segs = runs_of(seq, 4)
        group = dict(zip(segs, Q.rival_groups(segs)))
        got = Q.reinforced_segments(segs, 0)
        assert set(got) <= set(segs) and len({group[s] for s in got}) == len(got)
        assert bool(got) == bool(segs)


def test_choices_of_neighbours():
    a = np.zeros((8, 8))
    for i, j in [(0, 3), (0, 4), (0, 7), (4, 7)]:
        a[i, j] = 1
    assert Q.neighbour_choices(a)[0] == [4, 7] and Q.neighbour_choices(a, greedy=True)[0] == [3, 7]
    assert Q.neighbour_choices(a)[1] == []
    import itertools

    r = np.random.default_rng(9)
    for n, p in ((9, 0.4), (12, 0.6), (14, 0.5)):
        a = np.triu(r.random((n, n)) < p, 0).astype(float)
        full = (a + a.T) > 0
        for v, got in enumerate(Q.neighbour_choices(a)):
            runs = Q.runs_of(np.flatnonzero(full[v]).tolist())
            assert got == list(max(itertools.product(*runs), key=lambda c: (int(full[np.ix_(c, c)].sum()), tuple(-x for x in c))))


def test_blocks_of_a_divided_graph():
    r = np.random.default_rng(1)
    a = (r.random((30, 30)) < 0.05).astype(float)
    a[:15, :15] = r.random((15, 15)) < 0.9
    a[15:, 15:] = r.random((15, 15)) < 0.9
    got = Q.blocks(np.triu(a, 1))
    assert len(set(got[:15])) == 1 and len(set(got[15:])) == 1 and got[0] != got[15]
    assert Q.blocks(np.zeros((0, 0))) == [] and Q.blocks(np.zeros((3, 3))) == [0, 0, 0]


def test_reachability_is_that_of_the_plain_algorithm():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, (12, 2)), r.normal(8, 1, (10, 2)), [[50, 50]]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order, reach = K.optics(d, 4)
    core = [sorted(row)[3] for row in d]
    left, seen, want = dict.fromkeys(range(len(x)), math.inf), [], []
    while left:
        k = min(left, key=lambda v: (left[v], v))
        want.append(left.pop(k))
        seen.append(k)
        for v in left:
            left[v] = min(left[v], max(core[k], d[k, v]))
    assert order.tolist() == seen and np.allclose([reach[k] for k in seen], want)


def test_levels_of_clusters(spark):
    found = defaultdict(dict)
    for label, level, p, c in rows(spark, "laplacian_labels"):
        found[label, level][p] = c
    for (_, level), row in found.items():
        assert len(set(row.values())) <= level + 1 and (level or len(set(row.values())) == 1)


# Profiles


def plain_profile_path(s, model, n, emit, match=0.999, delete=0.01):
    """The log probability of the best way through match, insert and delete states, by recursion on states."""
    from functools import lru_cache

    other, d_other = math.log((1 - match) / 2), math.log((1 - delete) / 2)
    go = {("M", "M"): math.log(match), ("I", "M"): math.log(1 / 3), ("D", "M"): d_other, ("M", "I"): other, ("I", "I"): math.log(1 / 3), ("D", "I"): math.log(delete), ("M", "D"): other, ("I", "D"): math.log(1 / 3), ("D", "D"): d_other}

    @lru_cache(None)
    def best(kind, i, j):
        if i < 0 or j < 0:
            return -math.inf
        if i == 0 and j == 0:
            return 0.0 if kind == "I" else -math.inf
        if kind == "M":
            return max(best(k, i - 1, j - 1) + go[k, "M"] for k in "MID") + math.log(emit[j - 1][s[i - 1]]) if i and j else -math.inf
        if kind == "I":
            return max(best(k, i - 1, j) + go[k, "I"] for k in "MID") - math.log(n) if i else -math.inf
        return max(best(k, i, j - 1) + go[k, "D"] for k in "MID") if j else -math.inf

    return max(best(k, len(s), len(model)) for k in "MID")


def path_value(s, path, model, n, emit, match=0.999, delete=0.01):
    """The log probability of a way that is given by the match position of each symbol."""
    other, d_other = math.log((1 - match) / 2), math.log((1 - delete) / 2)
    go = {("M", "M"): math.log(match), ("I", "M"): math.log(1 / 3), ("D", "M"): d_other, ("M", "I"): other, ("I", "I"): math.log(1 / 3), ("D", "I"): math.log(delete), ("M", "D"): other, ("I", "D"): math.log(1 / 3), ("D", "D"): d_other}
    options = {("I", 0): 0.0}  # state and position so far to the value
    for k, x in enumerate(path):
        new = {}
        for (kind, j), v in options.items():
            ways = [(kind, j, v)]
            while ways:
                kd, at, value = ways.pop()
                if x >= 0 and at == x:
                    key, w = ("M", x + 1), value + go[kd, "M"] + math.log(emit[x][s[k]])
                    new[key] = max(new.get(key, -math.inf), w)
                if x < 0:
                    key, w = ("I", at), value + go[kd, "I"] - math.log(n)
                    new[key] = max(new.get(key, -math.inf), w)
                if at < len(model) and (x < 0 or at < x):
                    ways.append(("D", at + 1, value + go[kd, "D"]))
        options = new
    best = -math.inf
    for (kind, j), v in options.items():
        while j < len(model):
            v, kind, j = v + go[kind, "D"], "D", j + 1
        best = max(best, v)
    return best


def test_profile_alignments_are_the_likeliest():
    r = np.random.default_rng(5)
    base = r.integers(0, 4, 9).tolist()
    for _ in range(25):
        s = [x for x in base if r.random() > 0.15]
        for _ in range(int(r.integers(0, 3))):
            s.insert(int(r.integers(0, len(s) + 1)), int(r.integers(0, 4)))
        if len(s) == len(base):
            s.append(0)
        path = K.profile_msa([base, s, base], 4, rounds=0)[1]
        emit = np.ones((9, 4))
        emit[np.arange(9), base] += 10
        emit /= emit.sum(1, keepdims=True)
        assert path_value(s, path, base, 4, emit) == pytest.approx(plain_profile_path(tuple(s), tuple(base), 4, emit), abs=1e-9)


def test_flanked_profiles_find_their_pattern():
    pattern = [1, 3, 2, 0, 3, 1, 2, 3]
    model = P.flanked(pattern, 4)
    assert np.allclose(model.transitions.sum(1) + model.ends, 1) and model.starts.sum() == pytest.approx(1)
    r = np.random.default_rng(2)
    noise = lambda n: [0] * n
    for before in (0, 5, 12):
        got = P.decoded(model, noise(before) + pattern + noise(7))
        assert [k for k, x in enumerate(got) if x >= 0] == list(range(before, before + 8)) and [x for x in got if x >= 0] == list(range(8))
    short = P.decoded(model, noise(4) + pattern[2:6] + noise(4))
    assert [x for x in short if x >= 0][:2] == [2, 3]
    long = P.flanked([1, 3, 2, 3, 1, 2, 2, 3, 1, 1, 3, 2, 1, 2], 4, emphasis=100)
    dropped = P.decoded(long, noise(4) + [1, 3, 2, 3, 1, 2, 3, 1, 1, 3, 2, 1, 2] + noise(4))
    assert [x for x in dropped if x >= 0] in ([0, 1, 2, 3, 4, 5, *range(7, 14)], [0, 1, 2, 3, 4, *range(6, 14)])
    again = P.Profile.from_json(model.to_json())
    assert again.names == model.names and P.decoded(again, r.integers(0, 4, 20).tolist()) is not None
    assert P.decoded(model, []) == []


# Components over sequences


def test_supported_components_take_the_best_supported_pairs_first():
    segs = [(0, 1, 0, 0, 3), (0, 1, 0, 0, 2), (0, 1, 1, 0, 2), (1, 2, 0, 0, 1)]
    count = Counter()
    for a, b, i, j, n in segs:
        for k in range(n):
            count[(a, i + k), (b, j + k)] += 1
    order = [p for p, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))]
    assert {tuple(c) for c in C.supported_components(segs, 4)} == plain_components(order, 4)


def test_components_need_support():
    segs = [(0, 1, 0, 0, 6), (1, 2, 0, 0, 5), (0, 2, 0, 0, 4), (0, 3, 0, 9, 3), (1, 3, 0, 0, 3), (2, 3, 0, 0, 3)]
    comps = C.connected_components(segs, 4)
    at = {x: k for k, c in enumerate(comps) for x in c}
    assert len({at[s, 0] for s in range(3)}) == 1 and len({at[s, 4] for s in range(3)}) == 1
    for c in comps:
        assert all(x[0] != y[0] or abs(x[1] - y[1]) >= 4 for x, y in itertools.combinations(c, 2))
    assert C.entropy([[(0, 0), (1, 0)], [(0, 1), (1, 1)]], [[1, 1], [1, 2]]) == (1.0, 2, 4)
    assert C.comps_of(C.labels_of(comps, [20] * 4)) == [sorted(c) for c in comps]


def test_chains_follow_their_components():
    comps = [[(0, 0), (1, 3), (2, 1)], [(0, 1), (1, 4), (2, 2)], [(0, 2), (1, 5)], [(0, 9)]]
    assert C.follow_share(comps[0], comps[1]) == 1 and C.follow_share(comps[1], comps[2]) == pytest.approx(2 / 3)
    assert C.chains(comps, 0.5) == [[0, 1, 2], [3]]
    assert C.passages([0, 1, 2], comps, 3) == [[0, 0, 1, 2], [1, 3, 4, 5], [2, 1, 2, None]]
    assert C.filled(comps, [[0] * 10, [0] * 10, [0] * 4], 0.5) == [[(0, 0), (1, 3), (2, 1)], [(0, 1), (1, 4), (2, 2)], [(0, 2), (1, 5), (2, 3)]]
    assert C.filled(comps, [[0] * 10, [0] * 10, [0] * 3], 0.5)[2] == [(0, 2), (1, 5)]  # the sequence ends before
    assert C.tiny_chains_joined([[(0, 0), (1, 0), (2, 0)], [(0, 1), (1, 1), (2, 1)], [(0, 2)]], 0.9) == [[0, 1, 2]]


def plain_smoothed(row, r):
    return [int(sum(row[k - r : k + r + 1]) > r) if r <= k < len(row) - r else row[k] for k in range(len(row))]


def test_gaps_take_the_labels_that_they_are_aligned_with():
    r = np.random.default_rng(4)
    base = r.integers(0, 6, 40).tolist()
    seqs = [base, base, base[:]]
    labels = [list(range(40)) for _ in range(3)]
    labels[1][10:22] = [-1] * 12
    assert C.realigned(labels, seqs, 6, 1, 0.2)[1] == list(range(40))
    assert C.stretches([0, -1, -1, 3, -1]) == [(1, 2), (4, 1)]
    assert C.strict_mode([1, 2, 2]) == 2 and C.strict_mode([1, 2]) == -1 and C.mode([2, 1]) == 1
    for _ in range(10):
        row = r.integers(0, 2, 17).astype(np.int8)
        assert K.median_rows(row[None], np.array([17]), 2)[0].tolist() == plain_smoothed(row.tolist(), 2)
        assert K.median_rows(np.append(row, [0, 0, 0])[None].astype(np.int8), np.array([17]), 2)[0, :17].tolist() == plain_smoothed(row.tolist(), 2)


def test_alignments_are_those_of_the_relational_operator(spark, seqs):
    got = defaultdict(set)
    for a, b, i, j, n in rows(spark, "mutual_align"):
        got[a, b].add((i, j, n))
    for a, b in sorted(got)[:12]:
        assert set(C.alignments(seqs[a], seqs[b], 6, 2, 0.4)) == got[a, b]


def test_alignments_by_cells_are_those_by_sequences(spark):
    from strophe.operators import matrices as M

    s = A.sequences(spark, SF)
    pairs = S.pairings(s, 6)
    assert sorted(map(tuple, M.cells_align(s, pairs, 6, 2, 0.4).collect())) == sorted(map(tuple, M.mutual_align(s, pairs, 6, 2, 0.4).collect()))
    one = K.common_segments(list(range(50)) * 2, list(range(50)), 5, 1, 0.2)
    assert one == K.common_segments(list(range(50)) * 2, list(range(50)), 5, 1, 0.2, at_once=100) == [(50, 0, 50), (0, 0, 50)]
    assert K.common_segments([], [1]) == [] and K.common_segments([1, 2, 3], [1, 2, 3], 2, 0, 0, True) == []


def test_labels_are_smoothed_by_sections_that_fit():
    section = list(range(20))
    rows_ = [section[:], section[:], section[:8] + [-1] * 4 + section[12:], [50 + k for k in range(20)]]
    got = C.smoothed_labels(rows_, [(section, 6)], (0.75,), 5)
    assert got[:3] == [section] * 3 and got[3] == rows_[3]
    assert C.smoothed_labels(rows_, [(section, 4)], (0.75,), 5) == rows_
    assert C.likeness([1, -1, 3], [1, 2, 4, 5]) == (2 / 3, 1 / 3, [0, 1])
    assert C.best_of_length([([1], 9), ([1, 2], 3), ([2, 1], 3)], 2) == ([1, 2], 3)


def test_layers_and_wildcards():
    assert C.wildcard_groups([(1, 2), (1, -1), (3, 4), (-1, 4, 5)]) == [0, 0, 2, 3]
    got = C.layered_labels([[[0, 0, 1, 1]], [[5, -1, 6, 6]]])
    assert got[0][0] == got[0][1] and got[0][2] == got[0][3] and got[0][0] != got[0][2]
    assert C.part_similarity([1, 2, 3], [1, 2, 3, 4]) == 1.0 and C.part_similarity([], [1]) == 0.0


# Peaks and measures


def plain_peaks(y, prominence, distance):
    n = len(y)
    top = [k for k in range(1, n - 1) if y[k - 1] < y[k] > y[k + 1]]
    while True:
        bad = [(y[a], a) if (y[a], a) < (y[b], b) else (y[b], b) for a, b in itertools.combinations(top, 2) if abs(a - b) < distance]
        if not bad:
            break
        # the highest of all goes first, with what is near it
        for p in sorted(top, key=lambda p: (y[p], p), reverse=True):
            near = [q for q in top if q != p and abs(p - q) < distance and (y[q], q) < (y[p], p)]
            if near:
                top = [q for q in top if q not in near]
                break
    out = []
    for p in top:
        left = next((k for k in range(p - 1, -1, -1) if y[k] > y[p]), -1)
        right = next((k for k in range(p + 1, n) if y[k] > y[p]), n)
        if y[p] - max(min(y[left + 1 : p + 1]), min(y[p:right])) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_peaks(seed):
    y = np.round(np.random.default_rng(seed).random(60), 6).tolist()
    for prominence, distance in ((0, 1), (0.2, 1), (0, 5), (0.3, 4)):
        assert S.peaks(y, prominence, distance) == plain_peaks(y, prominence, distance)
    assert S.peaks([0, 1, 1, 1, 0]) == [2] and S.peaks([0, 1, 1, 0]) == [1] and S.peaks([1, 1]) == []


def test_order_transitivity_against_all_pairs(spark):
    hier = H.make_monotonic(A.hierarchy(spark, SF))
    groups = defaultdict(list)
    for r in H.children(hier).collect():
        if r.parts != r.label:
            groups[r.item, r.level, r.label].append(r.parts.split("|"))
    want = defaultdict(list)
    for (item, _, _), cs in groups.items():
        pairs = list(itertools.combinations(cs, 2))
        want[item].append(sum(len(plain_local(a, b)) >= max(len(a), len(b)) - 1 for a, b in pairs) / len(pairs) if pairs else 1.0)
    got = dict(rows(spark, "transitivity_of_order"))
    assert got.keys() == want.keys()
    for item, shares in want.items():
        assert got[item] == pytest.approx(sum(shares) / len(shares), abs=1e-6)


def plain_structure(seqs, partners):
    """(entropy, comps, points) of one song, by plain searches over the whole of it: its segments, components, holes, gaps."""
    import hashlib

    from tests.test_chains import plain_filled

    ids = sorted(seqs)
    half = (partners + 1) // 2
    ring = sorted(ids, key=lambda k: (hashlib.md5(f"3:{k}".encode()).hexdigest(), k))
    pairs = {(min(a, b), max(a, b)) for k, a in enumerate(ring) for s in range(1, min(half, len(ring) - 1) + 1) for b in [ring[(k + s) % len(ring)]]}
    aligned = [(ids.index(a), ids.index(b), i, j, n) for a, b in pairs for i, j, n in C.alignments(seqs[a], seqs[b], 6, 2, 0.4)]
    own = [(k, k, i, j, n) for k, a in enumerate(ids) for i, j, n in C.alignments(seqs[a], seqs[a], 6, 2, 0.4) if j - i >= 6]
    lists = [seqs[k] for k in ids]
    comps = plain_filled(C.connected_components(sorted(aligned + own), 8), [len(s) for s in lists], 0.5, 3)
    labels = C.realigned(C.labels_of([comps[k] for k in sorted(comps)], [len(s) for s in lists]), lists, 4, 1)
    e, n, p = C.entropy(C.comps_of(labels), lists)
    return round(e, 6), n, p


def test_corpus_run_is_the_structure_of_each_song(spark, seqs):
    (song, entropy, comps, points, positions), *rest = rows(spark, "corpus_run")
    assert not rest and song == 0 and positions == sum(map(len, seqs.values())) and 0 < points <= positions and comps > 0 and entropy > 0
    assert plain_structure(seqs, 20) == (entropy, comps, points)


def test_partner_sweep_is_a_run_for_each_number(spark, seqs):
    got = {r[0]: r[1:] for r in rows(spark, "partner_sweep")}
    assert sorted(got) == list(range(11))
    for partners in (0, 1, 6, 10):
        song, entropy, comps, points, positions = got[partners]
        assert plain_structure(seqs, partners) == (entropy, comps, points) and song == 0 and positions == sum(map(len, seqs.values()))


def test_preprocessing_reaches_a_state_that_it_has_seen(spark):
    from strophe.operators import corpus as R

    s, g = A.sequences(spark, SF), A.grid(spark, SF)
    once = sorted(tuple(r) for r in R.preprocessed(s, g, 0.0002, 0.0006, rounds=1).collect())
    more = sorted(tuple(r) for r in R.preprocessed(s, g, 0.0002, 0.0006, rounds=4).collect())
    assert once and more and {r[0] for r in more} <= {r[0] for r in once}
