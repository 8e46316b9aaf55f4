"""Cliques of small graphs, sets that can be had together, and blocks. A graph is one task's work."""

from __future__ import annotations

from collections import Counter

import numpy as np

from .kernels import maximal_cliques


def compatible(nodes, group) -> bool:
    """Whether no two nodes are of one group."""
    groups = [group[x] for x in nodes]
    return len(set(groups)) == len(groups)


def runs_of(values) -> list[list[int]]:
    """Sorted values in runs of neighbours."""
    out: list[list[int]] = []
    for x in sorted(values):
        if out and x - out[-1][-1] == 1:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def union_cliques(sets: dict[tuple[int, ...], int], group, keep: int = 10, at_once: int = 25) -> dict[tuple[int, ...], int]:
    """Rated unions of sets without two nodes of one group. Sets are taken by falling size, `at_once` at a time (in order of their nodes): to every union so far is added what fits it and one another (the maximal cliques of "fits", and what fits alone), with the sum of the ratings, in which a set counts once; the `keep` best rated stay, ties to the smaller nodes."""
    left = sorted(sets, key=lambda s: (-len(s), s))
    unions: dict[tuple[int, ...], int] = {}
    while left:
        size = len(left[0])
        part = [s for s in left[:at_once] if len(s) == size]
        left = left[len(part) :]
        if not unions:
            unions = {s: sets[s] for s in part}
        fits = np.array([[b > a and compatible(set(x) | set(y), group) for b, y in enumerate(part)] for a, x in enumerate(part)])
        grown = {}
        for u, rating in unions.items():
            own = [k for k, s in enumerate(part) if not set(s) <= set(u) and compatible(set(u) | set(s), group)]
            if own:
                for clique in maximal_cliques(fits[np.ix_(own, own)].astype(float)):
                    some = [part[own[k]] for k in clique]
                    grown[tuple(sorted(set(u).union(*some)))] = rating + sum(sets[s] for s in some)
        unions |= grown
        unions = dict(sorted(unions.items(), key=lambda x: (-x[1], x[0]))[:keep])
    return unions


def absorbed(sets: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], int]:
    """The sets that no larger one holds, rated by themselves and all that they hold."""
    top = {s: n for s, n in sets.items() if not any(set(s) < set(t) for t in sets)}
    return {s: n + sum(m for t, m in sets.items() if set(t) < set(s)) for s, n in top.items()}


def rival_groups(segs: list[tuple[int, int, int]]) -> list[int]:
    """For each segment (i0, j0, len) its group: segments that lead from one position to neighbouring ones, directly or by others, are rivals."""
    root = list(range(len(segs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    at: dict[int, list[tuple[int, int]]] = {}
    for n, (i, j, m) in enumerate(segs):
        for k in range(m):
            at.setdefault(i + k, []).append((j + k, n))
            at.setdefault(j + k, []).append((i + k, n))
    for ends in at.values():
        ends.sort()
        for (x, a), (y, b) in zip(ends, ends[1:]):
            if y - x <= 1:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [find(k) for k in range(len(segs))]


def reinforced_segments(segs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """The segments that reinforce one another most: every maximal clique of a position and what it is aligned with names a set of segments; sets with rivals go, smaller sets count for those that hold them, and of the unions that can be had together the best rated is taken."""
    of: dict[tuple[int, int], int] = {}
    for k, (i, j, m) in enumerate(segs):
        for x in range(m):
            of.setdefault((min(i, j) + x, max(i, j) + x), k)
    near: dict[int, set[int]] = {}
    for a, b in of:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    count: Counter = Counter()
    for v, others in sorted(near.items()):
        some = sorted(others | {v})
        sub = np.array([[float((a, b) in of) for b in some] for a in some])
        for clique in maximal_cliques(sub):
            nodes = [some[k] for k in clique]
            edges = {of[min(v, w), max(v, w)] for w in nodes if w != v} if v in nodes else set()
            if edges:
                count[tuple(sorted(edges))] += 1
    group = rival_groups(segs)
    sets = {s: c for s, c in count.items() if compatible(s, group)}
    if not sets:
        return []
    unions = union_cliques(absorbed(sets), group)
    return sorted(segs[k] for k in min(unions, key=lambda s: (-unions[s], s)))


def neighbour_choices(adjacency: np.ndarray, greedy: bool = False) -> list[list[int]]:
    """For each vertex one neighbour of every run of neighbouring ones, so that most edges run between them and the vertex; the first of equals. Choices are gone through run by run, and left where even the best of the runs to come cannot beat the best so far. greedy: each run only chooses what has most edges to those before."""
    a = (adjacency + adjacency.T) > 0
    edges = 2 * a.astype(int)
    np.fill_diagonal(edges, a.diagonal())
    return [_chosen(edges, runs_of(np.flatnonzero(row).tolist()), greedy) for row in a]


def _chosen(edges: np.ndarray, runs: list[list[int]], greedy: bool) -> list[int]:
    if greedy:
        taken: list[int] = []
        for r in runs:
            taken.append(max(r, key=lambda x: (int(edges[x, taken].sum()) if taken else 0, -x)))
        return taken
    # what a vertex can have at most with one of each later run
    later = {x: sum(int(edges[x, s].max()) for s in runs[k + 1 :]) + int(edges[x, x]) for k, r in enumerate(runs) for x in r}
    best, top = [], -1

    def go(k: int, taken: list[int], value: int, have: np.ndarray) -> None:
        nonlocal best, top
        if k == len(runs):
            if value > top:
                best, top = taken, value
            return
        if value + sum(max(int(have[x]) + later[x] for x in r) for r in runs[k:]) <= top:
            return
        for x in runs[k]:
            go(k + 1, [*taken, x], value + int(have[x]) + int(edges[x, x]), have + edges[x])

    go(0, [], 0, np.zeros(len(edges), int))
    return best


def _changes(e: np.ndarray, size: np.ndarray, entropy) -> np.ndarray:
    """What the union of every two blocks x < y changes in the description of the edges; infinite elsewhere. Only the rows of the two change."""
    b = len(size)
    pairs = np.outer(size, size)
    own = entropy(np.diag(e), size * (size - 1) / 2)
    apart = entropy(e, pairs)
    np.fill_diagonal(apart, 0)
    joint = entropy(e[:, None, :] + e[None, :, :], (size[:, None] + size[None, :])[:, :, None] * size[None, None, :])
    k = np.arange(b)
    joint[k, :, k] = 0
    joint[:, k, k] = 0
    s = size[:, None] + size[None, :]
    inner = entropy(np.diag(e)[:, None] + np.diag(e)[None, :] + e, s * (s - 1) / 2)
    before = apart.sum(1)[:, None] + apart.sum(1)[None, :] - apart + own[:, None] + own[None, :]
    out = joint.sum(2) + inner - before
    out[np.tril_indices(b)] = np.inf
    return out


def blocks(adjacency: np.ndarray) -> list[int]:
    """Vertices in blocks by least description length: from one block for each set of neighbours, the two whose union shortens it most are joined (the first of equals), until none does. The length is that of the edges given the blocks' densities, of the densities, and of the assignment. Blocks are numbered by their first vertex."""
    a = ((adjacency + adjacency.T) > 0).astype(float)
    np.fill_diagonal(a, 0)
    n = len(a)
    edges = a.sum() / 2

    def entropy(e: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        p = np.divide(e, pairs, out=np.zeros_like(e, dtype=float), where=pairs > 0)
        inner = np.where((p > 0) & (p < 1), p * np.log(np.where(p > 0, p, 1)) + (1 - p) * np.log(np.where(p < 1, 1 - p, 1)), 0)
        return -pairs * inner

    def length(e: np.ndarray, size: np.ndarray) -> float:
        b = len(size)
        pairs = np.outer(size, size)
        np.fill_diagonal(pairs, size * (size - 1) / 2)
        upper = np.triu_indices(b)
        return float(entropy(e[upper], pairs[upper]).sum() + b * (b + 1) / 2 * np.log(edges + 1) + n * np.log(b))

    # vertices with the same neighbours are alike in every division, so they begin as one block
    rows: dict[bytes, int] = {}
    label = np.array([rows.setdefault(r.tobytes(), len(rows)) for r in a], int)
    member = np.eye(len(rows))[label] if n else np.zeros((0, 0))
    size, e = member.sum(0), member.T @ a @ member
    e[np.diag_indices_from(e)] /= 2
    best = length(e, size) if n else 0.0
    while len(size) > 1:
        change = _changes(e, size, entropy)
        x, y = divmod(int(np.round(change, 9).argmin()), len(size))
        joined = e.copy()
        inner = e[x, x] + e[y, y] + e[x, y]
        joined[x] += e[y]
        joined[:, x] = joined[x]
        joined[x, x] = inner
        keep = np.delete(np.arange(len(size)), y)
        new_size = size.copy()
        new_size[x] += size[y]
        new = length(joined[np.ix_(keep, keep)], new_size[keep])
        if new >= best - 1e-9:
            break
        best, e, size = new, joined[np.ix_(keep, keep)], new_size[keep]
        label = np.where(label == y, x, label)
        label = np.where(label > y, label - 1, label)
    first = {v: k for k, v in enumerate(dict.fromkeys(label.tolist()))}
    return [first[v] for v in label.tolist()]
