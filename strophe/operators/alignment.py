"""Alignment of real-valued series, and what is measured along segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matrices as M
from . import tiles
from .sequences import islands


def thresholded(cells: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The cells (keys, i, j) of a matrix (keys, i, j, v) that count: local peaks of rows for a threshold of 0, the nearest neighbours of each row for one of up to 10, and what reaches the percentile of values scaled by column beyond that."""
    if threshold == 0:
        return M.peak_threshold(cells, keys)
    return M.knn_threshold(cells, keys, threshold) if threshold <= 10 else M.percentile_threshold(cells, keys, threshold)


def thresholded_series(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """thresholded cells of the similarities of two series (keys, pos, vec), without these similarities as a table."""
    if threshold == 0:
        return tiles.peaks(left, right, keys, 0.25)
    return M.nearest_cells(left, right, keys, threshold) if threshold <= 10 else tiles.above_percentile(left, right, keys, threshold)


def self_align(feat: DataFrame, key: str, threshold: float = 1, min_len: int = 16, min_dist: int = 1, gaps: int = 4, gap_ratio: float = 0.2) -> DataFrame:
    """Segments (key, i0, j0, len) in which a series of vectors (key, pos, vec) repeats itself: thresholded cosine similarities above the main diagonal, smoothed along diagonals, none nearer to it than max(min_dist, min_len)."""
    n = feat.groupBy(key).agg(F.count("*").cast("int").alias("ni")).withColumn("nj", F.col("ni"))
    cells = thresholded_series(feat, feat, [key], threshold).where("j > i")
    s = M.segments(M.smoothed(cells, n, [key], gaps), [key], min_len, gap_ratio, gaps)
    return s.where(F.col("j0") - F.col("i0") >= max(min_dist, min_len))


def mutual_align(feat: DataFrame, pairs: DataFrame, key: str, threshold: float = 1, min_len: int = 16, gaps: int = 4, gap_ratio: float = 0.2) -> DataFrame:
    """Segments (a, b, i0, j0, len) that two series of vectors have in common."""
    n = feat.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    sizes = pairs.join(n.select(F.col(key).alias("a"), F.col("n").alias("ni")), "a").join(n.select(F.col(key).alias("b"), F.col("n").alias("nj")), "b").select("a", "b", "ni", "nj")
    left, right = (pairs.join(feat.select(F.col(key).alias(x), "pos", "vec"), x).select("a", "b", "pos", "vec") for x in "ab")
    cells = thresholded_series(left, right, ["a", "b"], threshold)
    return M.segments(M.smoothed(cells, sizes, ["a", "b"], gaps), ["a", "b"], min_len, gap_ratio, gaps)


def longest_segment(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest segment by keys; of equal ones the one on the lowest diagonal, then the first."""
    best = F.min_by(F.struct("i0", "j0", "len"), F.struct((-F.col("len")).alias("a"), (F.col("j0") - F.col("i0")).alias("b"), F.col("i0").alias("c")))
    return segs.groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")


def widest_gap(smoothed: DataFrame, keys: list[str], min_len: int) -> DataFrame:
    """For each run of smoothed cells (keys, i, d, raw), from its first to its last raw cell, of min_len at least: how many cells in a row are not raw: (keys, i0, j0, len, gap)."""
    by = [*keys, "d", "grp"]
    r = M.runs(smoothed, keys)
    ends = r.where("raw = 1").groupBy(*by).agg(F.min("i").alias("i0"), F.max("i").alias("i1"))
    inside = r.join(ends, by).where("i >= i0 and i <= i1")
    w = Window.partitionBy(*by).orderBy("i")
    g = islands(inside, by, "i", F.col("raw") != F.lag("raw").over(w), "stretch")
    holes = g.groupBy(*by, "i0", "i1", "stretch").agg(F.sum(1 - F.col("raw")).alias("hole"))
    out = holes.groupBy(*by, "i0", "i1").agg(F.max("hole").alias("gap"))
    return out.select(*keys, F.col("i0").cast("int").alias("i0"), (F.col("i0") + F.col("d")).cast("int").alias("j0"), (F.col("i1") - F.col("i0") + 1).cast("int").alias("len"), "gap").where(F.col("len") >= min_len)


def convolved(cells: DataFrame, keys: list[str], kernel: list[list[float]]) -> DataFrame:
    """The convolution of a full matrix (keys, i, j, v) with a kernel, where the kernel lies wholly within: (keys, i, j, v), by the upper left of what it covers. A cell gives its share to each of the places that see it."""
    h, w = len(kernel), len(kernel[0])
    shares = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(float(kernel[h - 1 - x][w - 1 - y])).alias("w")) for x in range(h) for y in range(w)])
    k = cells.select(*keys, "i", "j", "v", F.explode(shares).alias("k"))
    g = k.groupBy(*keys, (F.col("i") - F.col("k.x")).alias("i"), (F.col("j") - F.col("k.y")).alias("j")).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"), F.count("*").alias("n"))
    return g.where(F.col("n") == h * w).drop("n")


def largest_cells(cells: DataFrame, keys: list[str], n: int, least: float) -> DataFrame:
    """The n largest cells above `least` by keys, ties to the smaller row and column."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v"), "i", "j"))
    return cells.where(F.col("v") > least).withColumn("k", k).where(F.col("k") <= n).select(*keys, "i", "j", "v")


def _shared(cells: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    a = cells.select(*keys, "i", "j").distinct().withColumn("a", F.lit(1))
    b = target.select(*keys, "i", "j").distinct().withColumn("b", F.lit(1))
    u = a.join(b, [*keys, "i", "j"], "full").na.fill(0, ["a", "b"])
    return u.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("b")).alias("both"))


def noise_factor(cells: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The share of cells that the target does not have, times the share of the target's that are among them: (keys, noise); null where either is empty."""
    return _shared(cells, target, keys).select(*keys, (F.try_divide(F.col("na") - F.col("both"), F.col("na")) * F.try_divide(F.col("both"), F.col("nb"))).alias("noise"))


def target_distance(cells: DataFrame, target: DataFrame, keys: list[str], power: float = 0.9) -> DataFrame:
    """How far cells are from a target: the target's that they miss, and, raised to a power, those that it does not have, both over the target's number and one: (keys, distance)."""
    n = F.col("nb") + 1
    return _shared(cells, target, keys).select(*keys, ((F.col("nb") - F.col("both")) / n + F.pow((F.col("na") - F.col("both")) / n, F.lit(power))).alias("distance"))


def time_lag_median(cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """A full matrix with each value replaced by the median of the 2 * radius + 1 values around it on its diagonal; beyond the ends are zeros."""
    w = Window.partitionBy(*keys, "d").orderBy("i").rowsBetween(-radius, radius)
    c = cells.withColumn("d", F.col("j") - F.col("i")).withColumn("around", F.collect_list("v").over(w))
    full = F.concat("around", F.array_repeat(F.lit(0.0), F.lit(2 * radius + 1) - F.size("around")))
    return c.select(*keys, "i", "j", F.element_at(F.array_sort(full), radius + 1).alias("v"))


def without_positions(cells: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose row and column are none of the positions (keys, pos)."""
    out = cells.join(positions.select(*keys, F.col("pos").alias("i")), [*keys, "i"], "left_anti")
    return out.join(positions.select(*keys, F.col("pos").alias("j")), [*keys, "j"], "left_anti").select(*cells.columns)


def mixed(parts: list[tuple[Column, float]]) -> Column:
    """Feature vectors side by side, each times its weight."""
    def times(v: Column, w: float) -> Column:
        return F.transform(v, lambda x: x * w)

    return F.concat(*[times(v, w) for v, w in parts])


def synced(frames: DataFrame, beats: DataFrame, key: str) -> DataFrame:
    """The mean vector of the frames (key, frame, vec) between beats (key, pos, frame): (key, pos, vec). Frames before the first beat are left out, those after the last belong to it; a beat without frames has no row."""
    from .sequences import as_of

    at = as_of(frames.select(key, F.col("frame").cast("double").alias("t"), "vec"), beats.select(key, F.col("frame").cast("double").alias("t"), F.col("pos").alias("beat")), "beat", [key])
    x = at.where("beat is not null").select(key, F.col("beat").alias("pos"), F.posexplode("vec").alias("k", "v"))
    m = x.groupBy(key, "pos", "k").agg(F.avg("v").alias("v"))
    return m.groupBy(key, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("vec"))


def convolution(matrix: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """What convolved() gives, for one matrix."""
    view = np.lib.stride_tricks.sliding_window_view(matrix, kernel.shape)
    return np.einsum("ijxy,xy->ij", view, kernel[::-1, ::-1])
