"""Sequential algorithms: numpy functions on one sequence or pair, and operators that apply them group by group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Cells of scores that are worked on at once.
CELLS = 1 << 20


def _scores(a: np.ndarray, b: np.ndarray, same, match: int, gap: int) -> np.ndarray:
    """Smith-Waterman scores of pairs (a row of a and of b each): +-match on the diagonal, -gap for a step aside, at least 0. same(x, b) tells where a column of a is like b. Rows of scores follow one another; within a row the step from the left is a running maximum of what cells have and how far on they are."""
    n, m = a.shape[1], b.shape[1]
    h = np.zeros((len(a), n + 1, m + 1), np.int64)
    far = gap * np.arange(1, m + 1)
    for i in range(n):
        diagonal = h[:, i, :-1] + np.where(same(a[:, i, None], b), match, -match)
        best = np.maximum(np.maximum(diagonal, h[:, i, 1:] - gap), 0)
        h[:, i + 1, 1:] = np.maximum.accumulate(best + far, axis=1) - far
    return h


def local_scores(a: list, b: list, match: int = 3, gap: int = 5, ignore: tuple = ()) -> np.ndarray:
    """The scores of one pair; symbols in ignore match any."""
    same = lambda x, y: (x == y) | np.isin(x, ignore) | np.isin(y, ignore)
    return _scores(np.array([a]).reshape(1, -1), np.array([b]).reshape(1, -1), same, match, gap)[0]


def local_paths(pairs: list[tuple[list, list]], match: int = 3, gap: int = 5, ignore: tuple = ()) -> list[list[tuple[int, int]]]:
    """For each pair of sequences the index pairs from the last maximum of their scores back: each next one is the last maximum of what is above and to the left, until that is 0. Symbols in ignore match any. Pairs of like sizes are worked on together."""
    codes: dict = {}
    wild = {codes.setdefault(x, len(codes)) for x in ignore}
    coded = [[np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in p] for p in pairs]
    wild = np.array(sorted(wild), np.int64)

    def same(x: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = x == b
        if len(wild):  # what fills up short sequences is below zero and matches nothing
            out |= (np.isin(x, wild) & (b >= 0)) | (np.isin(b, wild) & (x >= 0))
        return out

    out: list[list[tuple[int, int]]] = [[] for _ in pairs]
    order = sorted((k for k in range(len(pairs)) if len(coded[k][0]) and len(coded[k][1])), key=lambda k: (len(coded[k][0]), len(coded[k][1])))
    while order:
        n, m, size = 0, 0, 0
        while size < len(order):  # as many as fit with the longest among them
            a, b = coded[order[size]]
            big, wide = max(n, len(a)), max(m, len(b))
            if size and (size + 1) * (big + 1) * (wide + 1) > CELLS:
                break
            n, m, size = big, wide, size + 1
        now, order = order[:size], order[size:]
        a, b = np.full((size, n), -1, np.int64), np.full((size, m), -2, np.int64)
        for r, k in enumerate(now):
            a[r, : len(coded[k][0])], b[r, : len(coded[k][1])] = coded[k]
        h = _scores(a, b, same, match, gap)
        # scores with their places, so that the greatest of all cells above and to the left is a running maximum that ends at the last of equals
        place = h * ((n + 1) * (m + 1)) + np.arange((n + 1) * (m + 1)).reshape(n + 1, m + 1)
        np.maximum.accumulate(place, axis=1, out=place)
        np.maximum.accumulate(place, axis=2, out=place)
        at = place[:, n, m]
        rows = np.arange(size)
        while len(rows):
            score, cell = np.divmod(at, (n + 1) * (m + 1))
            rows, cell = rows[score > 0], cell[score > 0]
            i, j = np.divmod(cell, m + 1)
            for r, x, y in zip(rows.tolist(), (i - 1).tolist(), (j - 1).tolist()):
                out[now[r]].append((x, y))
            at = place[rows, i - 1, j - 1]
    return [p[::-1] for p in out]


def smith_waterman(a: list, b: list, match: int = 3, gap: int = 5, ignore: tuple = ()) -> list[tuple[int, int]]:
    return local_paths([(a, b)], match, gap, ignore)[0]


def packed(seq: DataFrame) -> DataFrame:
    """Sequences as arrays: (seq_id, syms). Rows with a null sequence, position or symbol are left out."""
    return seq.dropna(subset=["seq_id", "pos", "sym"]).groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sym"))), lambda x: x["sym"]).alias("syms"))


def local_alignments(seq: DataFrame, pairs: DataFrame) -> DataFrame:
    """Smith-Waterman paths of pairs (a, b): (a, b, k, i, j)."""
    p = packed(seq)
    x = pairs.join(p.select(F.col("seq_id").alias("a"), F.col("syms").alias("x")), "a").join(p.select(F.col("seq_id").alias("b"), F.col("syms").alias("y")), "b").select("a", "b", "x", "y")

    def run(frames):
        for f in frames:
            paths = local_paths([(list(u), list(v)) for u, v in zip(f["x"], f["y"])])
            rows = [(a, b, k, i, j) for a, b, path in zip(f["a"], f["b"], paths) for k, (i, j) in enumerate(path)]
            yield pd.DataFrame(rows, columns=["a", "b", "k", "i", "j"])

    return x.mapInPandas(run, "a long, b long, k int, i int, j int")


def sw_similarity(seq: DataFrame, pairs: DataFrame) -> DataFrame:
    """The length of a pair's path over the longer sequence's: (a, b, similarity)."""
    n = seq.groupBy("seq_id").agg(F.count("*").alias("n"))
    m = local_alignments(seq, pairs).groupBy("a", "b").agg(F.count("*").alias("m"))
    x = pairs.join(m, ["a", "b"], "left").join(n.select(F.col("seq_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("n").alias("nb")), "b")
    return x.select("a", "b", (F.coalesce("m", F.lit(0)) / F.greatest("na", "nb")).alias("similarity"))


def best_segments(matrix: np.ndarray, min_len: int = 20, max_len: int = 44, min_dist: int = 1, percentile: float = 0, emphasis: float = 0, min_val: float = 0.6) -> list[tuple[int, int, int]]:
    """Segments (i0, j0, len) of a matrix above its main diagonal, best first: windows of min_len to max_len cells of a diagonal by mean value times length ** emphasis, while above the percentile of all scores and min_val; a taken one suppresses what it contains on diagonals nearer than min_dist. min_len is at most max_len less 5. Then empty cells at both ends go, and what is shorter than min_len."""
    n = len(matrix)
    min_len = max(1, min(min_len, max_len - 5))
    many = max_len - min_len + 1
    scores, numbers = [], []
    for d in range(1, n):
        c = np.concatenate(([0.0], np.cumsum(np.diagonal(matrix, d))))
        for m in range(min_len, min(max_len, n - d) + 1):
            scores.append((c[m:] - c[:-m]) / m * m**emphasis)
            numbers.append((d, m))
    if not scores:
        return []
    least = max(np.percentile(np.concatenate(scores), percentile), min_val)
    # a window's number is its place in order of diagonal, start and length
    for k, (d, m) in enumerate(numbers):
        s = np.round(scores[k], 12)
        at = np.flatnonzero(s > least)
        scores[k], numbers[k] = s[at], (d * n + at) * many + m - min_len
    s, ids = np.concatenate(scores), np.concatenate(numbers)
    ids = ids[np.lexsort((ids, -s))]
    del scores, numbers, s
    # what a window of each length contains lies at the same distances from it
    pad = max(0, min_dist - 1) * n * many
    within = [np.array([x * n * many + p * many + k - m for x in range(1 - min_dist, min_dist) for p in range(m + 1) for k in range(m - p + 1)], np.int64) for m in range(many)]
    gone = bytearray(n * n * many + 2 * pad)
    mark, out = np.frombuffer(gone, np.uint8), []
    for k in (ids + pad).tolist():
        if gone[k]:
            continue
        place, m = divmod(k - pad, many)
        d, p = divmod(place, n)
        mark[k + within[m]] = 1
        m += min_len
        if m > 1 and matrix[p, p + d] and matrix[p + m - 1, p + d + m - 1]:
            out.append((p, p + d, m))
            continue
        hit = np.flatnonzero(np.diagonal(matrix, d)[p : p + m])
        if len(hit) > 1 and hit[-1] - hit[0] + 1 >= min_len:
            out.append((int(p + hit[0]), int(p + hit[0] + d), int(hit[-1] - hit[0] + 1)))
    return out


def filter_segments(segs: list[tuple[int, int, int]], count: int, min_len: int, min_dist: int, symmetric: bool) -> list[tuple[int, int, int]]:
    """Segments by length times distance to what was taken, best first; with a count, so many, and around each taken one a band of diagonals nearer than min_dist is cut off the others. In the symmetric case the main diagonal is taken first, with a band of max(min_dist, min_len)."""

    def cut(s, ref, pad):
        i, j, m = s
        a, b, n = ref
        if abs((j - i) - (b - a)) >= pad:
            return [s]
        parts = [(i, j, a - i), (a + n, j + a + n - i, i + m - a - n)]
        return [p for p in ((x, y, min(k, m)) for x, y, k in parts) if p[2] >= min_len] if i < a + n and a < i + m else [s]

    def distance(s, refs):
        near = [abs((s[1] - s[0]) - (r[1] - r[0])) for r in refs if s[0] < r[0] + r[2] and r[0] < s[0] + s[2]]
        return min(near, default=1)

    left = [s for s in segs if s[2] >= min_len]
    refs = []
    if symmetric:
        left = [s for s in left if s[1] - s[0] > max(min_dist - 1, min_len - 1)]
        refs = [(0, 0, 1 << 60)]
    rank = lambda ss: sorted(ss, key=lambda s: (-s[2] * distance(s, refs), s))
    left = rank(left)
    if not 0 < count < len(left):
        return left
    taken = []
    while left and len(taken) < count:
        best, left = left[0], left[1:]
        taken.append(best)
        refs.append(best)
        left = rank([p for s in left for p in cut(s, best, min_dist)])
    return taken


def median_rows(rows: np.ndarray, inside: np.ndarray, radius: int) -> np.ndarray:
    """0-1 rows after a median filter of 2 * radius + 1 cells; inside: how many cells of a row count. The first and last `radius` cells are as they were."""
    wide = 2 * radius + 1
    if not radius or rows.shape[1] < wide:
        return rows
    c = np.concatenate((np.zeros((len(rows), 1), np.int32), np.cumsum(rows, 1, dtype=np.int32)), 1)
    out = rows.copy()
    k = np.arange(radius, rows.shape[1] - radius)
    full = k[None, :] < (inside - radius)[:, None]
    out[:, radius : rows.shape[1] - radius] = np.where(full, (c[:, wide:] - c[:, :-wide]) > radius, rows[:, radius : rows.shape[1] - radius])
    return out


def common_segments(a, b, min_len: int = 16, gaps: int = 4, ratio: float = 0.2, symmetric: bool = False, at_once: int = 1 << 21) -> list[tuple[int, int, int]]:
    """Segments (i0, j0, len) that two sequences have in common: equal symbols, smoothed twice along diagonals (the first result and the raw cells together once more), from the first to the last raw cell of a run, of which there are two at least; of min_len at least and with at most a ratio of others, if both that and gaps are positive. symmetric: only above the main diagonal. Diagonals are worked on together, some two million cells at a time."""
    _, i, j, n = common_segments_of_all(a, [b], min_len, gaps, ratio, symmetric, at_once)
    return list(zip(i.tolist(), j.tolist(), n.tolist()))


def common_segments_of_all(a, many: list, min_len: int = 16, gaps: int = 4, ratio: float = 0.2, symmetric: bool = False, at_once: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """common_segments of a sequence and each of many, as arrays (which of the many, i0, j0, len): the diagonals of all of them are worked on together."""
    a = np.asarray(a)
    n = len(a)
    sizes = np.array([len(b) for b in many], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([np.asarray(b) for b in many]) if len(many) else np.zeros(0, np.int64)
    out: list[tuple] = []
    if n and len(flat):
        low = 1 if symmetric else 1 - n
        rows = np.where(sizes > 0, np.maximum(sizes - low, 0), 0)
        which = np.repeat(np.arange(len(many)), rows)
        diagonals = low + np.arange(len(which)) - np.repeat(np.cumsum(rows) - rows, rows)
        wide = min(n, int(sizes.max()))
        step = max(1, at_once // wide)
        for at in range(0, len(diagonals), step):
            w, d = which[at : at + step], diagonals[at : at + step]
            i0 = np.maximum(0, -d)
            size = np.minimum(n - i0, sizes[w] - np.maximum(0, d))
            k = np.arange(wide)
            i = i0[:, None] + k
            j = (starts[w] + d)[:, None] + i
            raw = ((k < size[:, None]) & (a[np.minimum(i, n - 1)] == flat[np.clip(j, 0, len(flat) - 1)])).astype(np.int8)
            v = median_rows(np.maximum(median_rows(raw, size, gaps), raw), size, gaps) if gaps else raw
            edge = np.diff(v, prepend=np.int8(0), append=np.int8(0), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            some = end - begin >= min_len
            row, begin, end = row[some], begin[some], end[some]
            hits = np.flatnonzero(raw)
            first, last = np.searchsorted(hits, row * wide + begin), np.searchsorted(hits, row * wide + end)
            total = last - first
            some = total > 1
            row, total = row[some], total[some]
            first, last = hits[first[some]] - row * wide, hits[last[some] - 1] - row * wide
            length = last - first + 1
            some = length >= min_len
            if gaps > 0 and ratio > 0:
                some &= total >= np.round((1 - ratio) * length, 9)
            row, first = row[some], first[some]
            out.append((w[row], i0[row] + first, i0[row] + first + d[row], length[some]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(z) for z in zip(*out))


def matrix_of(n: int, i, j) -> np.ndarray:
    m = np.zeros((n, n))
    m[i, j] = 1
    return m


def close(matrix: np.ndarray) -> np.ndarray:
    """The 0-1 matrix of "in one component", with the diagonal of all positions."""
    n = len(matrix)
    label = np.arange(n)
    link = (matrix + matrix.T) > 0
    while True:
        low = np.where(link, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return (label[:, None] == label[None, :]).astype(float)
        label = new


def diagonal_runs(matrix: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of nonzero cells above the main diagonal."""
    out = []
    for d in range(1, len(matrix)):
        x = np.diagonal(matrix, d) != 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], x.astype(int), [0]))))
        out += [(int(a), int(a + d), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]
    return out


def component_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest one of its component by links (i, j)."""
    label = np.arange(n)
    while True:
        new, low = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def pairs_within(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of positions of one component."""
    o = np.argsort(label, kind="stable")
    ends = np.searchsorted(label[o], label[o], "right")
    many = ends - np.arange(len(o)) - 1
    i = np.repeat(np.arange(len(o)), many)
    return o[i], o[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)]


def pruned_labels(label: np.ndarray, min_len: int) -> np.ndarray:
    """Components by the segments of min_len or more of a closed matrix, given by its components; min_len is halved while three or fewer are left."""
    i, j = pairs_within(label)
    o = np.lexsort((i, j - i))
    i, j = i[o], j[o]
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1)))) if len(i) else np.zeros(0, int)
    sizes = np.diff(np.append(begin, len(i)))
    while min_len > 1 and (sizes >= min_len).sum() <= 3:
        min_len //= 2
    keep = np.repeat(sizes >= min_len, sizes)
    return component_labels(len(label), i[keep], j[keep])


def transitive_construction(target: np.ndarray, min_dist: int = 4, min_len: int = 4, size_factor: float = 3, region: float = 0.6, smooth: float = 1, neighbours: float = 1) -> np.ndarray:
    """A closed 0-1 matrix near a target, by its components: see transitive_labels."""
    label = transitive_labels(target, min_dist, min_len, size_factor, region, smooth, neighbours)
    return (label[:, None] == label[None, :]).astype(float)


def transitive_labels(target: np.ndarray, min_dist: int = 4, min_len: int = 4, size_factor: float = 3, region: float = 0.6, smooth: float = 1, neighbours: float = 1) -> np.ndarray:
    """For each position the smallest one of its component in a closed 0-1 matrix near a target. Of the largest cells (a beam of n / region), one after another is added, with all that it makes one component, if none of that conflicts: cells nearer than min_dist to taken ones, but on their diagonal, are out, and components have at most n / min_dist / size_factor positions. The next one is that with the highest mean target value of all taken cells, raised by the share of new cells with a diagonal neighbour. When nothing can be added, short segments go and it starts again from there; when that has been seen, the beam doubles while under 0.3 of positions are covered.

    Cells are put in order once, and what is known of two components (whether a cell of theirs is out, the sum of their cells, how many of these have a diagonal neighbour) is kept when one of them grows, so that a step only looks it up for the beam."""
    n = len(target)
    full = np.triu(target.astype(float), 1)
    most = max(2, round(n / min_dist / size_factor))
    r = round(min_len * smooth)
    if r > 1:
        for d in range(1, n):
            x = np.diagonal(full, d)
            c = np.concatenate(([0.0], np.cumsum(x)))
            k = np.arange(len(x))
            lo, hi = np.maximum(k - r, 0), np.minimum(k + r + 1, len(x))
            full[k, k + d] = x * ((c[hi] - c[lo]) / (hi - lo))
    positive = int((full > 0).sum())
    i, j = np.nonzero(np.triu(full > 0, max(1, min_dist)))
    order = i * n + j
    order = order[np.argsort(-full[i, j], kind="stable")]
    del i, j
    full += full.T
    offsets = np.array([(x, y) for x in range(-min_dist + 1, min_dist) for y in range(-min_dist + 1, min_dist) if abs(x) + abs(y) <= min_dist - 1 and x != y]).reshape(-1, 2)
    power = 10.0**-neighbours
    beam = int(np.ceil(n / region))
    label, seen = np.arange(n), set()

    while True:
        by = np.argsort(label, kind="stable")
        begin = np.flatnonzero(np.diff(label[by], prepend=-1))
        heads = label[by][begin]

        def by_two(cells: np.ndarray, add: np.ufunc, kind: type) -> np.ndarray:
            out = np.zeros((n, n), kind)
            out[np.ix_(heads, heads)] = add.reduceat(add.reduceat(cells[np.ix_(by, by)], begin, 0, dtype=kind), begin, 1, dtype=kind)
            return out

        matrix = label[:, None] == label[None, :]
        left = np.zeros(n * n, bool)
        left[order] = True
        left = left.reshape(n, n)
        left |= left.T

        def blocked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = (x[:, None] + offsets[:, 0]).ravel(), (y[:, None] + offsets[:, 1]).ravel()
            ok = (a >= 0) & (a < n) & (b >= 0) & (b < n)
            a, b = a[ok], b[ok]
            ok = ~matrix[a, b]
            a, b = a[ok], b[ok]
            left[a, b] = left[b, a] = False
            return a, b

        x, y = pairs_within(label)
        blocked(x, y)
        total, count = full[x, y].sum(), len(x)
        near = np.zeros((n, n), bool)  # cells with a diagonal neighbour
        near[1:, 1:] |= matrix[:-1, :-1]
        near[:-1, :-1] |= matrix[1:, 1:]
        # of two components
        out, sums, nears = by_two(~left, np.logical_or, bool), by_two(full, np.add, float), by_two(near, np.add, np.int32)
        size = np.bincount(label, minlength=n)
        own = {int(c): np.flatnonzero(label == c) if size[c] > 1 else np.array([c]) for c in heads}
        free, fresh = left.ravel(), True
        beamed, at = np.zeros(0, np.int64), 0  # the beam, and how much of the order it has seen
        i = j = beamed  # cells of the beam that may still be taken: components only grow, so what conflicts once does so until it starts again
        while True:
            some = [beamed[free[beamed]]]
            need = beam - len(some[0])
            while need > 0 and at < len(order):
                next_ = order[at : at + max(need, 1024)]
                good = np.flatnonzero(free[next_])[:need]
                at += int(good[-1]) + 1 if len(good) == need else len(next_)
                some.append(next_[good])
                need -= len(good)
            beamed = np.concatenate(some)
            i, j = (np.concatenate(z) for z in zip((i, j), *(np.divmod(z, n) for z in some[1:])))
            u, v = label[i], label[j]
            many, more = size[u], size[v]
            k = np.flatnonzero((u != v) & (many + more <= most) & ~out[u, v])
            i, j, u, v, new = i[k], j[k], u[k], v[k], (many * more)[k]
            # of single cells without a diagonal neighbour the first is the best
            plain = np.flatnonzero((new == 1) & ~near[i, j])
            k = np.ones(len(i), bool)
            k[plain[1:]] = False
            u, v, new = u[k], v[k], new[k]
            best, chosen = 0.0, None
            if len(u):
                rating = (total + sums[u, v]) / (count + new)
                beside = nears[u, v]
                k = np.flatnonzero(beside)
                rating[k] *= (1 + beside[k] / new[k]) ** power
                for z in np.flatnonzero(rating >= rating.max() - 2e-12).tolist():  # the first of those that are equal when rounded
                    if round(float(rating[z]), 12) > round(best, 12):
                        best, chosen = float(rating[z]), z
            if chosen is None:
                break
            u, v = int(u[chosen]), int(v[chosen])
            a, b = own.pop(u), own.pop(v)
            c = min(u, v)
            x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            total, count = total + sums[u, v], count + len(x)
            matrix[x, y] = matrix[y, x] = True
            own[c] = np.sort(np.concatenate((a, b)))
            label[own[c]] = c
            size[c] = len(own[c])
            out[c] = out[:, c] = out[u] | out[v]
            sums[c] = sums[:, c] = sums[u] + sums[v]
            nears[c] = nears[:, c] = nears[u] + nears[v]
            e, f = (label[z] for z in blocked(x, y))
            out[e, f] = out[f, e] = True
            if fresh:
                left[matrix] = False
                fresh = False
            left[x, y] = left[y, x] = False
            for step in (-1, 1):
                e, f = x + step, y + step
                ok = (e >= 0) & (e < n) & (f >= 0) & (f < n)
                e, f = e[ok], f[ok]
                ok = ~near[e, f]
                e, f = e[ok], f[ok]
                near[e, f] = near[f, e] = True
                np.add.at(nears, (label[e], label[f]), 1)
                np.add.at(nears, (label[f], label[e]), 1)
        if beam >= np.triu(left, 1).sum() and beam >= positive:
            break
        label = pruned_labels(label, min_len)
        key = label.tobytes()
        if key in seen:
            if (label != np.arange(n)).mean() >= 0.3 or beam >= positive:
                break
            beam *= 2
        seen.add(key)
    return pruned_labels(label, min_len)


def greedy_hierarchical(segs: list[tuple[int, int, int]], target: np.ndarray, min_len: int, beta: float = 0.25, vary: int = 10) -> np.ndarray:
    """A closed matrix from segments: longest first, a segment is added, with its ends moved by up to `vary`, if the closure's F-beta against the target rises."""
    n = len(target)
    upper = np.triu(target > 0, 1)

    def f(m: np.ndarray) -> float:
        u = np.triu(m, 1) > 0
        hit = (u & upper).sum()
        if not hit:
            return 0.0
        p, r = hit / u.sum(), hit / upper.sum()
        return (1 + beta**2) * p * r / (beta**2 * p + r)

    best, score = np.eye(n), 0.0
    for i, j, m in sorted((s for s in segs if s[2] >= min_len), key=lambda s: (-s[2], s)):
        if best[i + np.arange(m), j + np.arange(m)].all():
            continue
        tried = []
        for shift in range(0, vary + 1):
            for a, k in ((i, m - shift), (i + shift, m - shift)):
                if k >= min_len:
                    x = np.arange(k)
                    new = best.copy()
                    new[a + x, a + j - i + x] = 1
                    new = close(new)
                    tried.append((-round(f(new), 12), shift, a, k, new))
        if tried:
            low = min(tried, key=lambda x: x[:4])
            if -low[0] > score:
                score, best = -low[0], low[4]
    return best


def constrained_components(edges: list[tuple[tuple[int, int], tuple[int, int]]], min_dist: int = 16) -> list[list[tuple[int, int]]]:
    """Components of points (sequence, position) by edges in the given order; a point or a merge is refused where two points of one sequence would come nearer than min_dist."""
    comps: list[list[tuple[int, int]]] = []
    at: dict[tuple[int, int], int] = {}
    refused = set()

    def fits(points: list[tuple[int, int]]) -> bool:
        return all(a[0] != b[0] or b[1] - a[1] >= min_dist for a, b in zip(points, points[1:]))

    for p, q in edges:
        a, b = at.get(p), at.get(q)
        if a is None and b is None:
            at[p] = at[q] = len(comps)
            comps.append([p, q])
        elif a is None or b is None:
            c, new = (b, p) if a is None else (a, q)
            both = sorted([*comps[c], new])
            k = both.index(new)
            if fits(both[max(0, k - 1) : k + 2]):
                comps[c] = both
                at[new] = c
        elif a != b and (a, b) not in refused:
            both = sorted(comps[a] + comps[b])
            if fits(both):
                comps[a], comps[b] = both, []
                at.update({x: a for x in both})
            else:
                refused.add((a, b))
    return [c for c in comps if c]


def kmeans(x: np.ndarray, k: int, restarts: int = 10, rounds: int = 100, seed: int = 1) -> np.ndarray:
    """Labels of the best of some seeded k-means runs, numbered by first appearance."""
    r = np.random.default_rng(seed)
    best, low = np.zeros(len(x), int), np.inf
    for _ in range(restarts):
        c = [x[r.integers(len(x))]]
        for _ in range(k - 1):
            d = np.min([((x - y) ** 2).sum(1) for y in c], axis=0)
            c.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[r.integers(len(x))])
        c = np.array(c)
        for _ in range(rounds):
            lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[lab == m].mean(0) if (lab == m).any() else c[m] for m in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[lab]) ** 2).sum()
        if cost < low - 1e-12:
            best, low = lab, cost
    first = {v: n for n, v in enumerate(dict.fromkeys(best.tolist()))}
    return np.array([first[v] for v in best.tolist()])


#: Positions up to which eigenvectors come from a dense matrix, and columns that a basis for more of them has at most.
DENSE, BASIS = 2048, 264


def laplacian_labels(affinity: np.ndarray, most: int = 11, smooth: int = 9, whole: bool = True) -> list[np.ndarray]:
    """Of an affinity matrix, cut down to whole numbers if `whole`: for k = 1 to `most` the labels of k clusters of positions by the first k eigenvectors of the normalised Laplacian, median-filtered along time and scaled by their norm; labels of each level are those of the level before that they have most in common with, greedily."""
    a = np.maximum(affinity, affinity.T).astype(int if whole else float).astype(float)
    np.fill_diagonal(a, 0)
    deg = a.sum(1)
    root = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    lap = np.diag((deg > 0).astype(float)) - root[:, None] * a * root[None]
    return _levels(np.linalg.eigh(lap)[1][:, :most], most, smooth)  # no level looks at more


def laplacian_labels_of_cells(i: np.ndarray, j: np.ndarray, v: np.ndarray, most: int = 11, smooth: int = 9, whole: bool = True) -> list[np.ndarray]:
    """laplacian_labels of a matrix that is given by its cells, each once. Beyond DENSE positions no matrix is made: what is held are the cells and a basis of BASIS columns."""
    n = int(max(i.max(), j.max())) + 1 if len(i) else 0
    if n <= DENSE:
        a = np.zeros((n, n))
        a[i, j] = v
        return laplacian_labels(a, most, smooth, whole)
    code = np.minimum(i, j).astype(np.int64) * n + np.maximum(i, j)
    o = np.argsort(code, kind="stable")
    code, v = code[o], np.asarray(v, float)[o]
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    one = np.diff(np.append(begin, len(code))) == 1  # the cell on the other side is zero
    code, v = code[begin], np.maximum.reduceat(v, begin)
    v = np.where(one, np.maximum(v, 0), v)
    v = v.astype(int).astype(float) if whole else v
    i, j = np.divmod(code, n)
    keep = (i != j) & (v != 0)
    i, j, v = i[keep], j[keep], v[keep]
    row, column, v = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((v, v))
    o = np.argsort(row, kind="stable")
    row, column, v = row[o], column[o], v[o]
    deg = np.bincount(row, v, n)
    root = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    v = v * root[row] * root[column]
    alone = (deg <= 0).astype(float)
    some, begin = np.unique(row, return_index=True)

    def product(x: np.ndarray) -> np.ndarray:
        out = alone[:, None] * x
        for k in range(x.shape[1]):
            out[some, k] += np.add.reduceat(v * x[column, k], begin)
        return out

    # the Laplacian's diagonal and the cells beside it, which is nearly all where few positions but neighbours are alike
    beside = np.zeros(n)
    at = np.flatnonzero(column == row + 1)
    beside[row[at] + 1] = -v[at]
    pivot, step = [], []
    for x, d in zip(beside.tolist(), (1 + 1e-8 - alone).tolist()):
        step.append(x / pivot[-1] if pivot else 0.0)
        pivot.append(d - x * step[-1])

    def solved(x: np.ndarray) -> np.ndarray:
        rows = list(x.copy())
        for k in range(1, n):
            if step[k]:
                rows[k] -= step[k] * rows[k - 1]
        rows[-1] /= pivot[-1]
        for k in range(n - 2, -1, -1):
            rows[k] /= pivot[k]
            if step[k + 1]:
                rows[k] -= step[k + 1] * rows[k + 1]
        return np.array(rows)

    return _levels(leading(product, solved, n, most), most, smooth)


def leading(product, solved, n: int, most: int, tolerance: float = 1e-12) -> np.ndarray:
    """The eigenvectors of the `most` greatest eigenvalues of a symmetric matrix of n rows, from the greatest, by its product with some columns (Davidson's method): a basis grows by what is left over of all of them (so that equal eigenvalues are all found), taken to where they lie by solved(), a near inverse; it is cut down to its best when it has BASIS columns. It ends when what is left over is below the tolerance."""
    q, mq, h = np.empty((n, BASIS)), np.empty((n, BASIS)), np.zeros((BASIS, BASIS))
    block, size = np.random.default_rng(1).standard_normal((n, most)), 0
    while True:
        for _ in range(2):
            block = block - q[:, :size] @ (q[:, :size].T @ block)
            block = np.linalg.qr(block)[0]
        new, size = slice(size, size + block.shape[1]), size + block.shape[1]
        q[:, new], mq[:, new] = block, product(block)
        h[:size, new] = q[:, :size].T @ mq[:, new]
        h[new, :size] = h[:size, new].T
        value, y = np.linalg.eigh(h[:size, :size])
        value, y = value[::-1], y[:, ::-1]
        best = q[:, :size] @ y[:, :most]
        left = mq[:, :size] @ y[:, :most] - best * value[:most]
        norm = np.linalg.norm(left, axis=0)
        if norm.max() < tolerance:
            return best
        if size + most > BASIS:
            keep = BASIS // 4
            q[:, :keep], mq[:, :keep] = q[:, :size] @ y[:, :keep], mq[:, :size] @ y[:, :keep]
            h[:keep, :keep], size = np.diag(value[:keep]), keep
        block = solved(left[:, norm >= tolerance])


def _levels(v: np.ndarray, most: int, smooth: int) -> list[np.ndarray]:
    """The labels of laplacian_labels by eigenvectors."""
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)  # eigenvectors have no sign of their own
    h = smooth // 2
    n = len(v)
    idx = np.arange(n)[:, None] + np.arange(-h, h + 1)[None]
    idx = idx % (2 * n)
    idx = np.where(idx < n, idx, 2 * n - 1 - idx)
    v = np.median(v[idx], axis=1)
    norm = np.sqrt(np.cumsum(v**2, 1))
    out: list[np.ndarray] = []
    for k in range(1, min(most, n) + 1):
        x = np.clip(np.nan_to_num(np.divide(v[:, :k], norm[:, k - 1 : k], out=np.zeros((n, k)), where=norm[:, k - 1 : k] > 0)), -1, 1)
        lab = kmeans(x, k)
        if out:
            prev = out[-1]
            over = sorted(((-int(((lab == a_) & (prev == b_)).sum()), a_, b_) for a_ in np.unique(lab) for b_ in np.unique(prev)))
            names: dict[int, int] = {}
            for c, a_, b_ in over:
                if c < 0 and a_ not in names and b_ not in names.values():
                    names[a_] = b_
            fresh = iter(x for x in range(2 * n) if x not in set(names.values()))
            lab = np.array([names[q] if q in names else names.setdefault(q, next(fresh)) for q in lab.tolist()])
        out.append(lab)
    return out


def profile_msa(seqs: list[list[int]], n_symbols: int, match: float = 0.999, delete_insert: float = 0.01, rounds: int = 1, inertia: float = 0.8, pseudocount: float = 0.2) -> list[list[int]]:
    """A multiple alignment by a profile model: match, insert and delete states for each position of the sequence nearest to the median length (the first of equals); emissions begin even, but for the match states, which lean to that sequence's symbols, and are fitted by Viterbi rounds with inertia. For each sequence and position the match state, -1 for an insert."""
    lengths = np.array([len(s) for s in seqs])
    model = seqs[int(np.abs(lengths - np.median(lengths)).argmin())]
    n = len(model)
    emit = np.full((n, n_symbols), 1.0)
    emit[np.arange(n), model] += 10
    emit /= emit.sum(1, keepdims=True)
    other, d_other = np.log((1 - match) / 2), np.log((1 - delete_insert) / 2)
    mm, di, third, flat = np.log(match), np.log(delete_insert), np.log(1 / 3), -np.log(n_symbols)
    steps = np.arange(n + 1)
    of_length: dict[int, list[int]] = {}
    for k, s in enumerate(seqs):
        of_length.setdefault(len(s), []).append(k)
    batches = [some[at : at + most] for m, some in of_length.items() for most in [max(1, CELLS // ((m + 1) * (n + 1)))] for at in range(0, len(some), most)]
    for step in range(rounds + 1):
        paths: list[list[int]] = [[] for _ in seqs]
        counts = np.full((n, n_symbols), pseudocount)
        le = np.log(emit)
        for some in batches:  # sequences of one length, a symbol's rows at a time
            m, wide = len(seqs[some[0]]), len(some)
            syms = np.array([seqs[k] for k in some], int).reshape(wide, m)
            vm, vi, vd = (np.full((wide, m + 1, n + 1), -np.inf) for _ in range(3))
            back = np.zeros((3, wide, m + 1, n + 1), np.int8)
            vi[:, 0, 0] = 0.0
            for i in range(m + 1):
                if i:
                    c = np.stack((vm[:, i - 1, :-1] + mm, vi[:, i - 1, :-1] + third, vd[:, i - 1, :-1] + d_other))
                    back[0, :, i, 1:] = c.argmax(0)
                    vm[:, i, 1:] = c.max(0) + le.T[syms[:, i - 1]]
                    c = np.stack((vm[:, i - 1] + other, vi[:, i - 1] + third, vd[:, i - 1] + di))
                    back[1, :, i] = c.argmax(0)
                    vi[:, i] = c.max(0) + flat
                # deletions go on along the row, each at the same cost, so the best begin of one is a running maximum
                begin = np.maximum(vm[:, i] + other, vi[:, i] + third)
                vd[:, i, 1:] = np.maximum.accumulate(begin - d_other * steps, axis=1)[:, :-1] + d_other * steps[:-1]
                c = np.stack((vm[:, i, :-1] + other, vi[:, i, :-1] + third, vd[:, i, :-1] + d_other))
                back[2, :, i, 1:] = np.where(c[:2].max(0) >= c[2] - 1e-9, c[:2].argmax(0), 2)
            last = np.stack((vm[:, m, n], vi[:, m, n], vd[:, m, n])).argmax(0)
            for r, own in enumerate(some):
                s, way = seqs[own], back[:, r]
                k, i, j = int(last[r]), m, n
                path = [-1] * m
                while i or j:
                    was = int(way[k, i, j])
                    if k == 0:
                        path[i - 1] = j - 1
                        counts[j - 1, s[i - 1]] += 1
                        i, j = i - 1, j - 1
                    elif k == 1:
                        i -= 1
                    else:
                        j -= 1
                    k = was
                paths[own] = path
        if step < rounds:
            emit = inertia * emit + (1 - inertia) * counts / counts.sum(1, keepdims=True)
    return paths


def optics(d: np.ndarray, least: int = 5, xi: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """The order and the reachability of points by distances (OPTICS): the next point is the one that is reached nearest from those so far, the first of equals."""
    n = len(d)
    least = min(least, n)
    core = np.sort(d, 1)[:, least - 1]
    reach, done, order = np.full(n, np.inf), np.zeros(n, bool), []
    for _ in range(n):
        k = int(np.where(done, np.inf, reach).argmin()) if np.isfinite(reach[~done]).any() else int(np.flatnonzero(~done)[0])
        done[k] = True
        order.append(k)
        new = np.maximum(core[k], d[k])
        reach = np.where(done, reach, np.minimum(reach, new))
    return np.array(order), reach


def optics_clusters(d: np.ndarray, least: int = 5, steep: float = 1.5) -> np.ndarray:
    """Cluster numbers by cutting the reachability plot at `steep` times its median; -1 for what no cluster of `least` points has."""
    if not len(d):
        return np.empty(0, int)
    order, reach = optics(d, least)
    finite = reach[np.isfinite(reach)]
    cut = steep * np.median(finite) if len(finite) else 0.0
    lab, current = np.full(len(d), -1), -1
    for k in order:
        if reach[k] > cut:
            current += 1
        lab[k] = current
    sizes = np.bincount(lab, minlength=current + 1)
    keep = {c: n for n, c in enumerate(c for c in dict.fromkeys(lab[order].tolist()) if sizes[c] >= min(least, len(d)))}
    return np.array([keep.get(c, -1) for c in lab.tolist()])


def maximal_cliques(adjacency: np.ndarray) -> list[list[int]]:
    """All sets of vertices, each joined to each, that no vertex can be added to: largest first, then by their vertices. A stack of (set, candidates, excluded) with pivots."""
    near = [set(np.flatnonzero(row).tolist()) - {k} for k, row in enumerate((adjacency + adjacency.T) > 0)]
    out, todo = [], [([], set(range(len(near))), set())]
    while todo:
        taken, left, gone = todo.pop()
        if not left:
            if not gone and taken:
                out.append(sorted(taken))
            continue
        pivot = max(sorted(left | gone), key=lambda v: len(near[v] & left))
        for v in sorted(left - near[pivot]):
            todo.append(([*taken, v], left & near[v], gone & near[v]))
            left = left - {v}
            gone = gone | {v}
    return sorted(out, key=lambda c: (-len(c), c))


def simple_structure(target: np.ndarray, min_len: int = 4, min_dist: int = 4) -> list[tuple[list[int], list[int]]]:
    """Label layers (labels, durations) of a sequence by its similarity matrix: a closed matrix near the target, its components as symbols, and the section dictionary of these."""
    from .grammars import induce, section_layers

    first = transitive_labels(target, min_dist, min_len).tolist()
    number = {v: k for k, v in enumerate(sorted(set(first)))}
    left, sections, _ = induce([[number[v] for v in first]])
    return section_layers(left[0], sections)


#: Rows of results that a task gathers before it hands them on.
HANDED_ON = 1 << 14


def handed_on(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of HANDED_ON at most, so that what a task holds does not grow with its part of the table."""
    rows = iter(rows)
    while some := list(islice(rows, HANDED_ON)):
        yield pd.DataFrame(some, columns=names, dtype=object)


def per_sequence(seq: DataFrame, f, columns: str) -> DataFrame:
    """Applies f(symbols) to every sequence; it gives rows for the columns after seq_id."""
    names = ["seq_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(frames):
        for frame in frames:
            yield from handed_on(((s, *row) for s, syms in frame.itertuples(index=False) for row in f([int(x) for x in syms])), names)

    return packed(seq).mapInPandas(run, f"seq_id long, {columns}")


def by_number(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to as many tasks as shuffles have. Groups may be little to read and much work: unless a number is named, Spark puts them into few tasks by their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def by_key(frames: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key as a frame, from frames in order of the key."""
    open_: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[key].to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if open_ and open_[-1][key].iloc[-1] != k[0]:
            yield pd.concat(open_, ignore_index=True) if len(open_) > 1 else open_[0]
            open_ = []
        for a, b in zip(cuts, cuts[1:]):
            part = frame.iloc[a:b].reset_index(drop=True)
            if b < len(k):
                yield pd.concat([*open_, part], ignore_index=True) if open_ else part
                open_ = []
            else:
                open_.append(part)
    if open_:
        yield pd.concat(open_, ignore_index=True) if len(open_) > 1 else open_[0]


def per_group(df: DataFrame, key: str, f, columns: str) -> DataFrame:
    """Applies f(frame) to the rows of every key but null; it gives rows for the columns after the key. A key is one task's work. Keys are mostly small, so a batch of rows comes with many of them: what Spark and Arrow do for a group of their own took 13 ms, most of such queries' time."""
    names = [key, *[c.split()[0] for c in columns.split(", ")]]

    def run(frames):
        yield from handed_on(((frame[key].iloc[0], *row) for frame in by_key(frames, key) for row in f(frame)), names)

    dealt = by_number(df.where(F.col(key).isNotNull()), key).sortWithinPartitions(key)
    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")


def per_rows(df: DataFrame, key: str, of: list[str], f, columns: str) -> DataFrame:
    """Like per_group, but f gets a key's rows as tuples of the columns `of`, in order. They come from arrays: a frame for each key takes longer than most of what is done with it."""
    names = [key, *[c.split()[0] for c in columns.split(", ")]]

    def groups(frames):
        now, held = None, []
        for frame in frames:
            k, rows = frame[key].to_numpy(), list(zip(*(frame[c].tolist() for c in of)))
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if held and k[a] != now:
                    yield now, sorted(held)
                    held = []
                now = k[a]
                held += rows[a:b]
        if held:
            yield now, sorted(held)

    def run(frames):
        yield from handed_on(((k, *row) for k, rows in groups(frames) for row in f(rows)), names)

    dealt = by_number(df.where(F.col(key).isNotNull()), key).sortWithinPartitions(key).select(key, *of)
    return dealt.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {columns}")
