"""Similarity matrices as tables of cells (keys, i, j, v), their thresholds, diagonals and segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .sequences import islands


def lengths(seq: DataFrame, key: str = "seq_id") -> DataFrame:
    return seq.groupBy(key).agg(F.count("*").cast("int").alias("n"))


def equality_cells(seq: DataFrame, key: str = "seq_id", value: str = "sym") -> DataFrame:
    """Cells (i, j), i < j, of equal symbols of a sequence: an equi-join on sequence and symbol."""
    a = seq.select(key, value, F.col("pos").alias("i"))
    b = seq.select(key, value, F.col("pos").alias("j"))
    return a.join(b, [key, value]).where("i < j").select(key, "i", "j")


def pair_cells(seq: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells (a, b, i, j) of equal symbols of the pairs' sequences."""
    x = pairs.join(seq.select(F.col("seq_id").alias("a"), "sym", F.col("pos").alias("i")), "a")
    return x.join(seq.select(F.col("seq_id").alias("b"), "sym", F.col("pos").alias("j")), ["b", "sym"]).select("a", "b", "i", "j")


def ssm(feat: DataFrame, key: str, upper: bool = False, within: int | None = None, digits: int | None = None) -> DataFrame:
    """Cosine similarities (key, i, j, v) of all positions of a series (key, pos, vec), worked out in tiles; upper: only with j >= i; within: only with i and j no further apart; digits: rounded to so many."""
    return tiles.similarities(feat, feat, [key], upper, within, digits)


def neighbours(n: Column, emphasis: float, width: int = 1) -> Column:
    """How many cells of a row the nearest-neighbour threshold keeps in a matrix of n rows and columns."""
    return F.bround(2 * F.ceil(F.sqrt(n * emphasis - 2 * width + 1))).cast("int")


def knn_threshold(cells: DataFrame, keys: list[str], emphasis: float) -> DataFrame:
    """The largest cells of each row, ties to the smaller j."""
    size = cells.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "i").orderBy(F.desc("v"), "j"))
    return cells.withColumn("k", rank).join(size, keys).where(F.col("k") <= neighbours(F.col("n"), emphasis)).select(*keys, "i", "j")


def nearest_cells(left: DataFrame, right: DataFrame, keys: list[str], emphasis: float) -> DataFrame:
    """knn_threshold of the similarities of two series (keys, pos, vec), without their cells."""
    size = left.groupBy(*keys).agg(neighbours(F.max("pos") + 1, emphasis).alias("num_a"))
    return tiles.nearest(left.join(size, keys), right, keys, tiles.by_similarity).select(*keys, "i", "j")


def percentile_threshold(cells: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """Cells whose value, scaled to 0 to 1 by column, reaches the percentile of all."""
    w = Window.partitionBy(*keys, "j")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    c = cells.withColumn("v", F.round(F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)), 9))
    cut = c.groupBy(*keys).agg(F.percentile("v", percent / 100).alias("cut"))
    return c.join(cut, keys).where(F.col("v") >= F.round("cut", 9)).select(*keys, "i", "j")


def peak_threshold(cells: DataFrame, keys: list[str], height: float = 0.25, distance: int = 1) -> DataFrame:
    """Local maxima of rows that reach the height: runs of equal values with smaller ones on both sides, at their middle (the earlier of two). Of those nearer than `distance` the greater stays, on ties the later: the greatest first, each if it is far enough from those that stay."""
    row = [*keys, "i"]
    w = Window.partitionBy(*row).orderBy("j")
    runs = islands(cells, row, "j", F.col("v") != F.lag("v").over(w)).groupBy(*row, "grp").agg(F.min("j").alias("a"), F.max("j").alias("b"), F.first("v").alias("v"))
    g = Window.partitionBy(*row).orderBy("grp")
    peaks = runs.withColumn("before", F.lag("v").over(g)).withColumn("after", F.lead("v").over(g)).where((F.col("before") < F.col("v")) & (F.col("after") < F.col("v")) & (F.col("v") >= height))
    at = F.floor((F.col("a") + F.col("b")) / 2).cast("int").alias("j")
    if distance <= 1:
        return peaks.select(*row, at)
    order = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("v"), (-at).alias("j"))))
    far = lambda kept, x: F.forall(kept, lambda k: F.abs(k + x["j"]) >= distance)
    apart = F.aggregate("order", F.array().cast("array<int>"), lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(-x["j"]))).otherwise(kept))
    return peaks.groupBy(*row).agg(order.alias("order")).select(*row, F.explode(apart).alias("j"))


def smoothed(cells: DataFrame, sizes: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Cells after two median filters along diagonals, with what they were (raw): the first filter's result and the raw cells together are filtered again, so beginnings before a gap stay. sizes (keys, ni, nj). A median makes no ones from zeros alone, so beside cells only the places within twice the radius of one are looked at. radius 0: as they are."""
    c = cells.select(*keys, "i", (F.col("j") - F.col("i")).alias("d"))
    if not radius:
        return c.select(*keys, "i", "d", F.lit(1).alias("raw"))
    w = Window.partitionBy(*keys, "d").orderBy("i")
    x = c.join(sizes, keys).withColumn("lo", F.greatest(F.lit(0), -F.col("d"))).withColumn("hi", F.least(F.col("ni"), F.col("nj") - F.col("d")) - 1)
    # a cell brings the places around it, those before it as far as the cell before doesn't bring them
    first = F.greatest(F.col("i") - 2 * radius, F.coalesce(F.lag("i").over(w) + 2 * radius + 1, F.col("lo")), F.col("lo"))
    last = F.least(F.col("i") + 2 * radius, F.coalesce(F.lead("i").over(w) - 1, F.col("hi")), F.col("hi"))
    x = x.withColumn("first", F.least(first, F.col("i"))).withColumn("last", F.greatest(last, F.col("i")))
    v = x.select(*keys, "d", "lo", "hi", F.col("i").alias("at"), F.explode(F.sequence("first", "last")).alias("i")).withColumn("raw", (F.col("i") == F.col("at")).cast("int"))
    frame = w.rangeBetween(-radius, radius)
    whole = (F.col("i") - radius >= F.col("lo")) & (F.col("i") + radius <= F.col("hi"))
    # the median of an odd number of zeros and ones is one if more than half are
    median = lambda x: F.when(whole, (F.sum(x).over(frame) > radius).cast("int")).otherwise(F.col(x))
    v = v.withColumn("once", F.greatest(median("raw"), F.col("raw")))
    v = v.withColumn("v", median("once"))
    return v.where("v > 0").select(*keys, "i", "d", "raw")


def runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal runs of cells (keys, i, d) along diagonals: (keys, d, grp, ...) as cells with the run's number."""
    w = Window.partitionBy(*keys, "d").orderBy("i")
    return cells.withColumn("grp", F.col("i") - F.row_number().over(w))


def diag_segments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (keys, i0, j0, len): maximal runs of cells (keys, i, j) along diagonals."""
    r = runs(cells.select(*keys, "i", (F.col("j") - F.col("i")).alias("d")), keys)
    return r.groupBy(*keys, "d", "grp").agg(F.min("i").alias("i0"), F.count("*").cast("int").alias("len")).select(*keys, "i0", (F.col("i0") + F.col("d")).alias("j0"), "len")


def segments(cells: DataFrame, keys: list[str], min_len: int, gap_ratio: float, gaps: int) -> DataFrame:
    """Segments of smoothed cells (keys, i, d, raw): each run from its first to its last raw cell, of which there are two at least; of min_len at least; and with at most gap_ratio of other cells, if gaps and gap_ratio are positive."""
    r = runs(cells, keys).groupBy(*keys, "d", "grp").agg(F.min(F.when(F.col("raw") == 1, F.col("i"))).alias("i0"), F.max(F.when(F.col("raw") == 1, F.col("i"))).alias("i1"), F.sum("raw").alias("hits"))
    r = r.withColumn("len", (F.col("i1") - F.col("i0") + 1).cast("int")).where((F.col("hits") > 1) & (F.col("len") >= min_len))
    if gaps > 0 and gap_ratio > 0:
        r = r.where(F.col("hits") >= F.round((1 - gap_ratio) * F.col("len"), 9))
    return r.select(*keys, F.col("i0").cast("int").alias("i0"), (F.col("i0") + F.col("d")).cast("int").alias("j0"), "len")


def self_align(seq: DataFrame, min_len: int = 16, min_dist: int = 1, gaps: int = 4, gap_ratio: float = 0.2) -> DataFrame:
    """Segments (seq_id, i0, j0, len) in which a sequence repeats itself, none nearer to the main diagonal than max(min_dist, min_len). A sequence is a row, and its cells never leave the task."""
    from .kernels import common_segments, per_sequence

    least = max(min_dist, min_len)
    return per_sequence(seq, lambda s: [x for x in common_segments(s, s, min_len, gaps, gap_ratio, True) if x[1] - x[0] >= least], "i0 int, j0 int, len int")


def mutual_align(seq: DataFrame, pairs: DataFrame, min_len: int = 16, gaps: int = 4, gap_ratio: float = 0.2) -> DataFrame:
    """Segments (a, b, i0, j0, len) that the pairs' sequences have in common. Sequences travel packed, once for each pair, and a pair's cells never leave the task."""
    import pandas as pd

    from .kernels import common_segments, packed

    p = packed(seq)
    x = pairs.join(p.select(F.col("seq_id").alias("a"), F.col("syms").alias("x")), "a").join(p.select(F.col("seq_id").alias("b"), F.col("syms").alias("y")), "b").select("a", "b", "x", "y")

    def run(frames):
        for f in frames:
            rows = [(a, b, *s) for a, b, u, v in f.itertuples(index=False) for s in common_segments(u, v, min_len, gaps, gap_ratio)]
            yield pd.DataFrame(rows, columns=["a", "b", "i0", "j0", "len"])

    return x.mapInPandas(run, "a long, b long, i0 int, j0 int, len int")


def cells_align(seq: DataFrame, pairs: DataFrame, min_len: int = 16, gaps: int = 4, gap_ratio: float = 0.2) -> DataFrame:
    """mutual_align as joins and windows over cells, for sequences too long for a task."""
    n = lengths(seq)
    sizes = pairs.join(n.select(F.col("seq_id").alias("a"), F.col("n").alias("ni")), "a").join(n.select(F.col("seq_id").alias("b"), F.col("n").alias("nj")), "b").select("a", "b", "ni", "nj")
    return segments(smoothed(pair_cells(seq, pairs), sizes, ["a", "b"], gaps), ["a", "b"], min_len, gap_ratio, gaps)


def segment_cells(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (keys, i, j) of segments, each once."""
    k = segs.select(*keys, "i0", "j0", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    return k.select(*keys, (F.col("i0") + F.col("k")).alias("i"), (F.col("j0") + F.col("k")).alias("j")).distinct()


def endpoint_hist(segs: DataFrame, keys: list[str]) -> DataFrame:
    """How many segments begin or end at each column: (keys, j, n)."""
    ends = F.when(F.col("len") > 1, F.array("j0", F.col("j0") + F.col("len") - 1)).otherwise(F.array("j0"))
    return segs.select(*keys, F.explode(ends).alias("j")).groupBy(*keys, "j").agg(F.count("*").alias("n"))


def checkerboard(radius: int, var: float) -> tuple[float, float]:
    """The rate and the sum of absolute weights of a Gaussian checkerboard: the weight at (x, y) is sign(x) sign(y) exp(-rate (x x + y y)) over the sum."""
    rate = 0.5 / (radius * var) ** 2
    side = sum(math.exp(-rate * x * x) for x in range(-radius, radius + 1) if x)
    return rate, side * side


def novelty_curve(cells: DataFrame, keys: list[str], radius: int = 10, var: float = 0.5, exclude: bool = False) -> DataFrame:
    """The correlation of a checkerboard with a matrix's surroundings along its main diagonal: (keys, pos, novelty). Only the band around the diagonal takes part; beyond the edges are zeros. exclude: the first and last `radius` values are 0."""
    rate, total = checkerboard(radius, var)
    size = cells.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    band = cells.where(F.abs(F.col("i") - F.col("j")) <= 2 * radius).join(size, keys)
    band = band.select(*keys, "n", "i", "j", "v", F.explode(F.sequence(F.greatest("i", "j") - radius, F.least("i", "j") + radius)).alias("pos")).where("pos >= 0 and pos < n")
    x, y = F.col("i") - F.col("pos"), F.col("j") - F.col("pos")
    weight = F.signum(x.cast("double")) * F.signum(y.cast("double")) * F.exp(-rate * (x * x + y * y)) / total
    out = band.groupBy(*keys, "pos").agg(F.sum(weight * F.col("v")).alias("novelty"), F.first("n").alias("n"))
    value = F.when((F.col("pos") < radius) | (F.col("pos") >= F.col("n") - radius), 0.0).otherwise(F.col("novelty")) if exclude else F.col("novelty")
    return out.select(*keys, F.col("pos").cast("int").alias("pos"), value.alias("novelty"))


def _mirrored(curve: DataFrame, keys: list[str], value: str, before: int, after: int) -> DataFrame:
    """Each position with the values around it (k, v); beyond the ends the curve is mirrored."""
    size = curve.groupBy(*keys).agg(F.count("*").alias("n"))
    at = curve.join(size, keys).select(*keys, "pos", "n", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("k"))
    m = F.pmod(F.col("pos") + F.col("k"), 2 * F.col("n"))
    at = at.withColumn("src", F.when(m < F.col("n"), m).otherwise(2 * F.col("n") - 1 - m).cast("int"))
    return at.join(curve.select(*keys, F.col("pos").alias("src"), F.col(value).alias("v")), [*keys, "src"])


def novelty_peaks(curve: DataFrame, keys: list[str], median_len: int = 16, offset: float = 0.05, sigma: float = 4.0) -> DataFrame:
    """Peaks of a curve (keys, pos, novelty): local maxima after a Gaussian that lie above a running median plus `offset` times the mean: (keys, pos)."""
    r = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1))
    g = _mirrored(curve, keys, "novelty", r, r).groupBy(*keys, "pos").agg(F.sum(F.col("v") * F.exp(-0.5 * F.pow(F.col("k") / sigma, F.lit(2.0))) / total).alias("s"))
    h = median_len // 2
    m = _mirrored(g, keys, "s", h, median_len - h - 1).groupBy(*keys, "pos").agg(F.element_at(F.array_sort(F.collect_list("v")), h + 1).alias("median"))
    mean = curve.groupBy(*keys).agg((F.avg("novelty") * offset).alias("offset"))
    w = Window.partitionBy(*keys).orderBy("pos")
    x = g.join(m, [*keys, "pos"]).join(mean, keys).withColumn("before", F.lag("s").over(w)).withColumn("after", F.lead("s").over(w))
    return x.where((F.col("before") < F.col("s")) & (F.col("s") > F.col("after")) & (F.col("s") > F.col("median") + F.col("offset"))).select(*keys, "pos")


def pruned(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Of every group of adjacent positions the last, of the last group the first: (keys, pos)."""
    w = Window.partitionBy(*keys).orderBy("pos")
    g = islands(boundaries, keys, "pos", F.col("pos") - F.lag("pos").over(w) > 1).groupBy(*keys, "grp").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return g.select(*keys, F.when(F.col("grp") == F.max("grp").over(Window.partitionBy(*keys)), F.col("a")).otherwise(F.col("b")).alias("pos"))


def binary_boundaries(cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Positions that no row up to there reaches across, in a matrix with cells (keys, i, j): (keys, pos). An empty row counts as reaching the end."""
    rows = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    x = rows.join(cells.groupBy(*keys, "i").agg(F.max("j").alias("last")), [*keys, "i"], "left").withColumn("last", F.coalesce("last", F.col("n") - 1))
    w = Window.partitionBy(*keys).orderBy("i")
    x = x.withColumn("most", F.max("last").over(w)).where("most = i and last = i")
    return pruned(x.select(*keys, F.col("i").alias("pos"), "n"), keys).join(sizes, keys).select(*keys, (F.col("pos") + 1).alias("pos"), "n").where("pos < n").drop("n")


def discontinuity_boundaries(cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Positions where no cell above the main diagonal goes on diagonally from the row before: (keys, pos)."""
    up = cells.where("j > i").select(*keys, "i", "j")
    on = up.join(up.select(*keys, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")), [*keys, "i", "j"], "left_semi").select(*keys, "i").distinct()
    rows = sizes.where("n > 1").select(*keys, F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i"))
    return pruned(rows.join(on, [*keys, "i"], "left_anti").select(*keys, F.col("i").alias("pos")), keys).select(*keys, (F.col("pos") + 1).alias("pos"))


def fractal_dimension(cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The box-counting dimension of a binary matrix (keys, i, j): minus the slope of the logarithm of boxes neither empty nor full over that of the side, for sides from the largest power of two within the matrix down to 4. Sides without such a box are left out; null for fewer than two."""
    top = F.floor(F.log2(F.col("n"))).cast("int")
    sides = sizes.withColumn("top", top).where("top >= 2").select(*keys, F.explode(F.sequence(F.lit(2), F.col("top"))).alias("e")).select(*keys, F.pow(F.lit(2), F.col("e")).cast("int").alias("k"))
    boxes = cells.join(sides, keys).groupBy(*keys, "k", F.floor(F.col("i") / F.col("k")).alias("bi"), F.floor(F.col("j") / F.col("k")).alias("bj")).agg(F.count("*").alias("s")).where(F.col("s") < F.col("k") * F.col("k"))
    n = boxes.groupBy(*keys, "k").agg(F.count("*").alias("boxes"))
    return n.groupBy(*keys).agg((-F.regr_slope(F.log("boxes"), F.log("k"))).alias("dimension"))


def matrix_rating(cells: DataFrame, sizes: DataFrame, keys: list[str], longest: bool) -> DataFrame:
    """How promising a binary matrix (keys, i, j) is: the share of rows that are not empty, times the logarithm of the mean length of segments, over the coefficient of variation of row means; only segments over 2 count. longest: of the greatest length instead, with all segments, but none of the main diagonal. A matrix without cells has 0."""
    segs = diag_segments(cells.where("i != j"), keys) if longest else diag_segments(cells, keys).where("len > 2")
    length = segs.groupBy(*keys).agg((F.max("len") if longest else F.avg("len")).alias("length"))
    rows = segment_cells(segs, keys).groupBy(*keys, "i").agg(F.count("*").alias("c"))
    r = rows.groupBy(*keys).agg(F.count("*").alias("filled"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
    x = sizes.join(r, keys, "left").join(length, keys, "left")
    mean = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean))
    return x.select(*keys, F.coalesce(F.try_divide(F.col("filled") / F.col("n") * F.log("length"), deviation / mean), F.lit(0.0)).alias("rating"))


def closure(comp: DataFrame, keys: list[str]) -> DataFrame:
    """All cells (keys, i, j), i < j, between positions of one component: comp (keys, pos, comp)."""
    return comp.select(*keys, "comp", F.col("pos").alias("i")).join(comp.select(*keys, "comp", F.col("pos").alias("j")), [*keys, "comp"]).where("i < j").select(*keys, "i", "j")


def f_measure(cells: DataFrame, target: DataFrame, keys: list[str], beta: float = 1.0) -> DataFrame:
    """Precision, recall and F of weighted cells (keys, i, j, v) against a target's: what they have in common over each one's sum."""
    a = cells.groupBy(*keys, "i", "j").agg(F.sum("v").alias("x"))
    b = target.groupBy(*keys, "i", "j").agg(F.sum("v").alias("y"))
    u = a.join(b, [*keys, "i", "j"], "full").na.fill(0.0, ["x", "y"])
    s = u.groupBy(*keys).agg(F.sum(F.when(F.col("x") > 0, F.col("y")).otherwise(0.0)).alias("hit"), F.sum((F.col("x") > 0).cast("double")).alias("n"), F.sum("y").alias("total"))
    p, r = F.try_divide(F.col("hit"), F.col("n")), F.try_divide(F.col("hit"), F.col("total"))
    return s.select(*keys, p.alias("p"), r.alias("r"), F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r).alias("f"))


def components_of(feat: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors as rows (keys, k, v)."""
    return feat.select(*keys, F.posexplode("vec").alias("k", "v"))


def scaled(feat: DataFrame, key: str) -> DataFrame:
    """Series of vectors (key, pos, vec) with each component scaled to 0 to 1 within its series, 0 where it is constant."""
    f = components_of(feat, [key, "pos"])
    w = Window.partitionBy(key, "k")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    s = f.withColumn("v", F.coalesce(F.try_divide(F.col("v") - lo, hi - lo), F.lit(0.0)))
    return s.groupBy(key, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("vec"))


def median_bits(feat: DataFrame) -> DataFrame:
    """Vectors as patterns (vec_id, bits): a one for each component above its median over all vectors."""
    f = components_of(feat, ["vec_id"])
    m = f.groupBy("k").agg(F.percentile("v", 0.5).alias("m"))  # a row for each component
    b = f.join(F.broadcast(m), "k")
    return b.groupBy("vec_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("v") > F.col("m")).cast("int").alias("b")))), lambda x: x["b"].cast("string"))).alias("bits"))
