"""Patterns as a first place, a length and translations: (key, p, len, t), t an array that begins with 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import close, diagonal_runs
from .sequences import overlap_join

PATTERN = ["p", "len"]


def occurrences(patterns: DataFrame, key: str) -> DataFrame:
    """Where a pattern begins and ends: (key, p, len, start, end), a row for each translation."""
    return patterns.select(key, *PATTERN, F.explode("t").alias("t")).select(key, *PATTERN, (F.col("p") + F.col("t")).alias("start"), (F.col("p") + F.col("t") + F.col("len")).alias("end"))


def boundaries(patterns: DataFrame, key: str) -> DataFrame:
    """The begins and ends of a pattern's occurrences, each once: (key, p, len, pos)."""
    return occurrences(patterns, key).select(key, *PATTERN, F.explode(F.array("start", "end")).alias("pos")).distinct()


def indices(patterns: DataFrame, key: str) -> DataFrame:
    """The positions of a pattern's occurrences, each once: (key, p, len, pos)."""
    return occurrences(patterns, key).select(key, *PATTERN, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct()


def coverage(patterns: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """For patterns and others (q, qlen) that have positions in common: how many, and whether all of the other's are among the pattern's: (key, p, len, q, qlen, common, contains)."""
    a = indices(patterns, key)
    b = indices(other, key).select(key, F.col("p").alias("q"), F.col("len").alias("qlen"), "pos")
    size = b.groupBy(key, "q", "qlen").agg(F.count("*").alias("n"))
    common = a.join(b, [key, "pos"]).groupBy(key, *PATTERN, "q", "qlen").agg(F.count("*").alias("common"))
    return common.join(size, [key, "q", "qlen"]).select(key, *PATTERN, "q", "qlen", "common", (F.col("common") == F.col("n")).alias("contains"))


def _meeting(a: DataFrame, b: DataFrame, key: str, width: int = 16) -> DataFrame:
    """Pairs of spans (start, end) that overlap, by buckets; b's columns have the suffix _b."""
    return overlap_join(a, b, key, width)


def first_overlaps(patterns: DataFrame, key: str) -> DataFrame:
    """Pairs of patterns whose first occurrences overlap: by how much, the share of the longer one, and whether the second lies within the first: (key, p, len, q, qlen, overlap, share, contained). A pair is given both ways, none with itself."""
    a = patterns.select(key, *PATTERN, F.col("p").alias("start"), (F.col("p") + F.col("len")).alias("end")).distinct()
    x = _meeting(a, a, key).where("p != p_b or len != len_b")
    n = F.least("end", "end_b") - F.greatest("start", "start_b")
    return x.select(key, *PATTERN, F.col("p_b").alias("q"), F.col("len_b").alias("qlen"), n.alias("overlap"), (n / F.greatest("len", "len_b")).alias("share"), (n == F.col("len_b")).alias("contained"))


def internal_positions(patterns: DataFrame, key: str, proportion: float = 1.0) -> DataFrame:
    """Where, relative to the begin of a pattern's occurrence, another one's occurrence stands of which at least a proportion lies within: (key, p, len, q, qlen, at), each once."""
    o = occurrences(patterns, key)
    x = _meeting(o, o, key).where("p != p_b or len != len_b")
    n = F.least("end", "end_b") - F.greatest("start", "start_b")
    return x.where(n >= F.round(F.col("len_b") * proportion, 9)).select(key, *PATTERN, F.col("p_b").alias("q"), F.col("len_b").alias("qlen"), (F.col("start_b") - F.col("start")).alias("at")).distinct()


def partial_appearances(patterns: DataFrame, key: str) -> DataFrame:
    """Which part of another pattern's occurrence lies within one of a pattern: its first n symbols (at, 0, n) if it begins there, at the place relative to the occurrence, else its last n (0, qlen - n, n): (key, p, len, q, qlen, at, skip, n), each once."""
    o = occurrences(patterns, key)
    x = _meeting(o, o, key).where("p != p_b or len != len_b")
    n = F.least("end", "end_b") - F.greatest("start", "start_b")
    begins = F.col("start_b") >= F.col("start")
    at, skip = F.when(begins, F.col("start_b") - F.col("start")).otherwise(0), F.when(begins, 0).otherwise(F.col("len_b") - n)
    return x.select(key, *PATTERN, F.col("p_b").alias("q"), F.col("len_b").alias("qlen"), at.alias("at"), skip.alias("skip"), n.alias("n")).distinct()


def divided(patterns: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """Patterns cut at positions (key, pos): wherever a cut falls within any occurrence, all are cut there, and each piece is a pattern with the same translations: (key, p, len, t)."""
    o = occurrences(patterns, key).select(key, *PATTERN, "start", "end")
    at = _meeting(o, cuts.select(key, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")).distinct(), key).where("start_b > start").select(key, *PATTERN, (F.col("start_b") - F.col("start")).alias("cut")).distinct()
    own = patterns.select(key, *PATTERN).distinct().withColumn("cut", F.lit(0))
    w = Window.partitionBy(key, *PATTERN).orderBy("cut")
    pieces = own.unionByName(at.select(own.columns)).withColumn("next", F.coalesce(F.lead("cut").over(w), F.col("len")))
    return pieces.join(patterns, [key, *PATTERN]).select(key, (F.col("p") + F.col("cut")).alias("p"), (F.col("next") - F.col("cut")).cast("int").alias("len"), "t").distinct()


def sparse(patterns: DataFrame, key: str, min_dist: int = 1) -> DataFrame:
    """Patterns in which, of translations that follow each other within min_dist, only the one that most of the key's patterns have stays, the smallest of equals; patterns with one translation left go."""
    each = patterns.select(key, *PATTERN, F.explode("t").alias("t"))
    freq = each.groupBy(key, "t").agg(F.count("*").alias("freq"))
    w = Window.partitionBy(key, *PATTERN).orderBy("t")
    g = each.withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > min_dist).cast("int"), F.lit(0))).withColumn("area", F.sum("new").over(w))
    best = g.join(freq, [key, "t"]).groupBy(key, *PATTERN, "area").agg(F.min_by("t", F.struct((-F.col("freq")).alias("a"), F.col("t").alias("b"))).alias("t"))
    return best.groupBy(key, *PATTERN).agg(F.array_sort(F.collect_list("t")).alias("t")).where(F.size("t") > 1)


def integrated(patterns: DataFrame, key: str) -> DataFrame:
    """Patterns with, besides their own, the translations of all patterns whose first occurrence holds theirs; those of one first occurrence are one: (key, p, len, t)."""
    own = patterns.select(key, *PATTERN, F.explode("t").alias("t"))
    held = first_overlaps(patterns, key).where("contained").select(key, F.col("p").alias("_p"), F.col("len").alias("_len"), F.col("q").alias("p"), F.col("qlen").alias("len"))
    more = held.join(own.select(key, F.col("p").alias("_p"), F.col("len").alias("_len"), "t"), [key, "_p", "_len"]).select(key, *PATTERN, "t")
    return own.unionByName(more).groupBy(key, *PATTERN).agg(F.array_sort(F.collect_set("t")).alias("t"))


def far_from(segs: DataFrame, refs: DataFrame, key: str, min_dist: int) -> DataFrame:
    """Segments (key, i0, j0, len) without those of which some reference's diagonal, but not their own, is nearer than min_dist where their rows overlap; with the least such distance, null for none."""
    span = lambda d: d.select(key, F.col("i0").alias("start"), (F.col("i0") + F.col("len")).alias("end"), "j0", "len")
    x = overlap_join(span(segs), span(refs), key, 16)
    d = F.abs((F.col("j0") - F.col("start")) - (F.col("j0_b") - F.col("start_b")))
    near = x.withColumn("dist", d).where("dist > 0").groupBy(key, F.col("start").alias("i0"), "j0", "len").agg(F.min("dist").alias("dist"))
    return segs.join(near, [key, "i0", "j0", "len"], "left").where(F.col("dist").isNull() | (F.col("dist") >= min_dist)).select(key, "i0", "j0", "len", "dist")


def hierarchical_patterns(segs: list[tuple[int, int, int]], n: int, min_len: int) -> list[tuple[int, int, int]]:
    """Segments of a closed matrix that do not cut into one another: the pattern with the most positions (length times occurrences, the first of equals) is taken and the matrix closed; all others are cut at the boundaries that there are now, and what the matrix has already, or is shorter than min_len, goes. Ends when nothing is left; gives the runs of min_len at least."""
    left: dict[tuple[int, int], set[int]] = {}
    for i, j, m in segs:
        left.setdefault((i, m), {0}).add(j - i)
    matrix = np.zeros((n, n))
    while left:
        (p, m), t = max(left.items(), key=lambda x: (x[0][1] * len(x[1]), -x[0][0], -x[0][1]))
        del left[p, m]
        starts = sorted(p + x for x in t if p + x + m <= n)
        k = np.arange(m)
        for a in range(len(starts)):
            for b in starts[a + 1 :]:
                matrix[starts[a] + k, b + k] = 1
        matrix = close(matrix)
        runs = diagonal_runs(matrix)
        edges = sorted({e for i, j, size in runs for s in (i, j) for e in (s, s + size)})
        cut: dict[tuple[int, int], set[int]] = {}
        for (q, size), ts in left.items():
            inside = sorted({0, size} | {e - q - x for x in ts for e in edges if 0 < e - q - x < size})
            for a, b in zip(inside, inside[1:]):
                if b - a >= min_len:
                    cut.setdefault((q + a, b - a), set()).update(ts)
        left = {}
        for (q, size), ts in cut.items():
            at = sorted(q + x for x in ts if q + x + size <= n)
            k = np.arange(size)
            if len(at) > 1 and not all(matrix[a + k, b + k].all() for x, a in enumerate(at) for b in at[x + 1 :]):
                left[q, size] = ts
    return [s for s in diagonal_runs(matrix) if s[2] >= min_len]
