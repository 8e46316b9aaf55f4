"""Closed matrices near a target: searches with beams and variations, and pruning."""

from __future__ import annotations

import numpy as np

from .kernels import close, diagonal_runs


def distance(matrix: np.ndarray, target: np.ndarray, power: float = 0.9) -> float:
    """How far a matrix is from a target: what it misses and, raised to a power, what it has besides, over the target's cells and one."""
    m, t = matrix > 0, target > 0
    n = t.sum() + 1
    return float((t & ~m).sum() / n + ((m & ~t).sum() / n) ** power)


def variations(seg: tuple[int, int, int], n: int, most: int = 10, end: bool = False) -> list[tuple[int, int, int]]:
    """A segment (i0, j0, len) with its begin (or end) moved by up to `most` cells on its diagonal, longest first."""
    i, j, m = seg
    room = min(n - (i + m), n - (j + m), most) if end else min(i, j, most)
    if end:
        return [(i, j, m + k) for k in range(room, -min(most, m - 1) - 1, -1)]
    return [(i - k, j - k, m + k) for k in range(room, -min(most, m - 1) - 1, -1)]


def cells_of(seg: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(seg[2])
    return seg[0] + k, seg[1] + k


def with_segment(matrix: np.ndarray, seg: tuple[int, int, int]) -> np.ndarray:
    """The closure of a matrix and a segment."""
    new = matrix.copy()
    new[cells_of(seg)] = 1
    return close(new)


def beam_hierarchical(segs: list[tuple[int, int, int]], target: np.ndarray, beam: int = 5, vary: int = 10) -> list[tuple[int, int, int]]:
    """Segments of a closed matrix near a target (both triangles), by beam search: to each of the best matrices so far every segment that it has not wholly is added; the best sums have their segment's begin varied, the best of these its end; while the best of these are nearer than the worst of the beam, the beam is made of the best of both. Of equals the shorter segments count."""
    n = len(target)
    wanted = np.nonzero(np.maximum(target, target.T) > 0)
    size = len(wanted[0])
    # a closed matrix is the number, by first position, of each position's class; so adding a segment is joining classes, and no matrix is closed again
    best: list[tuple[float, np.ndarray]] = [(np.inf, np.arange(n))]

    def joined(label: np.ndarray, seg: tuple[int, int, int]) -> np.ndarray:
        new = label.copy()
        i, j, m = seg
        for k in range(m):
            x, y = new[i + k], new[j + k]
            if x != y:
                new[new == max(x, y)] = min(x, y)
        return new

    def apart(label: np.ndarray) -> float:
        """distance() of the matrix from the target."""
        both = (label[wanted[0]] == label[wanted[1]]).sum()
        return float((size - both) / (size + 1) + (((np.bincount(label) ** 2).sum() - both) / (size + 1)) ** 0.9)

    def top(found: list[tuple[np.ndarray, tuple[int, int, int]]]) -> list[tuple[float, np.ndarray, tuple[int, int, int]]]:
        rated, seen = [], set()
        for m, s in sorted(found, key=lambda x: (x[1][2], x[1])):
            if (key := m.tobytes()) not in seen:
                seen.add(key)
                rated.append((round(apart(m), 12), len(rated), m, s))
        return [(d, m, s) for d, _, m, s in sorted(rated, key=lambda x: x[:2])[:beam]]

    while True:
        found = top([(joined(m, s), s) for _, m in best for s in segs if not np.array_equal(m[s[0] : s[0] + s[2]], m[s[1] : s[1] + s[2]])])
        if not found:
            break
        for end in (False, True):
            found = top([(joined(m, v), v) for _, m, s in found for v in variations(s, n, vary, end)])
        if found[0][0] >= max(d for d, _ in best):
            break
        keys = {m.tobytes() for _, m in best}
        before = [d for d, _ in best]
        best = sorted([*best, *((d, m) for d, m, _ in found if m.tobytes() not in keys)], key=lambda x: x[0])[:beam]
        if [d for d, _ in best] == before:
            break
    label = best[0][1]
    return diagonal_runs((label[:, None] == label[None, :]).astype(float))


def diagonal_neighbours(matrix: np.ndarray) -> np.ndarray:
    """For each cell how many of the two cells beside it on its diagonal are set."""
    m = matrix > 0
    out = np.zeros(m.shape, int)
    out[1:, 1:] += m[:-1, :-1]
    out[:-1, :-1] += m[1:, 1:]
    return out


def isolated(matrix: np.ndarray) -> np.ndarray:
    """Set cells without a neighbour on their diagonal."""
    return (matrix > 0) & (diagonal_neighbours(matrix) == 0)


def without_isolated_components(matrix: np.ndarray) -> np.ndarray:
    """A closed matrix without the components that have an isolated cell, again and again until none has; the main diagonal stays."""
    m = matrix.copy()
    while (bad := np.unique(np.nonzero(isolated(m))[0])).size:
        first = (m[bad] > 0).argmax(1)
        drop = np.isin((m > 0).argmax(1), first)
        was = m.copy()
        m[drop] = 0
        m[:, drop] = 0
        np.fill_diagonal(m, 1)
        if np.array_equal(m, was):
            break
    return m


def without_isolated_rows(matrix: np.ndarray, worst: bool = False) -> np.ndarray:
    """A matrix without the rows and columns that have isolated cells; with `worst` only the one that has most goes (the first of equals), again and again until none has."""
    m = matrix.copy()
    while True:
        n = isolated(m).sum(1)
        bad = np.flatnonzero(n == n.max())[:1] if worst else np.flatnonzero(n)
        if not n.any():
            return m
        was = m.copy()
        m[bad] = 0
        m[:, bad] = 0
        np.fill_diagonal(m, 1)
        if not worst or np.array_equal(m, was):
            return m


def trimmed_components(matrix: np.ndarray) -> np.ndarray:
    """A closed matrix in which, of every component with more isolated cells than cells that lack a predecessor or than cells that lack a successor, the isolated cells go with the fewer of these; closed again, until nothing changes."""
    m = (matrix > 0).astype(float)
    while True:
        new = m.copy()
        for c in np.unique((m > 0).argmax(1)):
            rows = np.flatnonzero((m > 0).argmax(1) == c)
            x, y = np.repeat(rows, len(rows)), np.tile(rows, len(rows))
            before = (x > 0) & (y > 0) & (m[x - 1, y - 1] > 0)
            after = (x < len(m) - 1) & (y < len(m) - 1) & (m[np.minimum(x + 1, len(m) - 1), np.minimum(y + 1, len(m) - 1)] > 0)
            alone, first, last = ~before & ~after, ~before & after, before & ~after
            if alone.sum() > min(first.sum(), last.sum()):
                drop = alone | (last if first.sum() >= last.sum() else first)
                new[x[drop], y[drop]] = 0
        np.fill_diagonal(new, 1)
        if np.array_equal(new, m):
            return close(m)
        m = new


def noisy_closure(segs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The closure of some segments."""
    m = np.zeros((n, n))
    for s in segs:
        m[cells_of(s)] = 1
    return close(m)

