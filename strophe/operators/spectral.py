"""Affinity of recurrence and path, balanced by degrees, as cells (keys, i, j, v) of what isn't zero; and studies over its parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import redealt, stored
from . import tiles
from .matrices import diag_segments, matrix_rating, neighbours, segment_cells


def recurrence(feat: DataFrame, key: str, width: int = 9) -> DataFrame:
    """For series (key, pos, vec): exp(-d / b) for positions that are among one another's nearest, d being the cosine distance and b the median over rows of the greatest distance kept. A row keeps 2 ceil(sqrt(n - 2 width + 1)) positions, n - 1 at most, none nearer to itself than width; ties go to the smaller j."""
    def far(i, j, v, null):
        d = tiles.half_up(1 - v, 9)
        return np.where(null, np.inf, np.where(np.isnan(d), -np.inf, -d)), np.abs(j - i) >= width

    most = F.least(F.count("*") - 1, 2 * F.ceil(F.sqrt(F.greatest(F.lit(0), F.count("*") - 2 * width + 1))))
    rows = feat.join(feat.groupBy(key).agg(most.alias("num_a")), key)
    d = F.when(F.col("v") == float("inf"), None).when(F.col("v") == float("-inf"), float("nan")).otherwise(0.0 - F.col("v"))
    near = stored(tiles.nearest(rows, feat, [key], far).select(key, "i", "j", d.alias("d")), "nearest")
    both = near.join(near.select(key, F.col("j").alias("i"), F.col("i").alias("j")), [key, "i", "j"], "left_semi")
    rows = both.groupBy(key, "i").agg(F.max("d").alias("d")).groupBy(key).agg(F.percentile("d", 0.5).alias("b"))
    return both.join(redealt(rows, key), key).select(key, "i", "j", F.exp(-F.coalesce(F.try_divide("d", "b"), F.lit(0.0))).alias("v"))


def lag_median(cells: DataFrame, feat: DataFrame, key: str, radius: int = 4) -> DataFrame:
    """Cells with each value replaced by the median of the 2 radius + 1 values around it on its diagonal, where cells that aren't there and places beyond the ends are zeros. A median above zero needs more than radius cells there, so only places near cells are looked at."""
    n = feat.groupBy(key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key, "lag").orderBy("i")
    c = cells.select(key, (F.col("j") - F.col("i")).alias("lag"), "i", "v")
    # a cell brings the places around it, those before it as far as the cell before doesn't bring them
    first = F.greatest(F.col("i") - radius, F.coalesce(F.lag("i").over(w) + radius + 1, F.col("i") - radius))
    last = F.least(F.col("i") + radius, F.coalesce(F.lead("i").over(w) - 1, F.col("i") + radius))
    c = c.withColumn("first", F.least(first, F.col("i"))).withColumn("last", last)
    near = c.select(key, "lag", F.col("i").alias("at"), "v", F.explode(F.sequence("first", "last")).alias("i"))
    g = near.withColumn("vs", F.collect_list(F.when(F.col("i") == F.col("at"), F.col("v"))).over(w.rangeBetween(-radius, radius))).where(F.size("vs") > radius)
    g = g.withColumn("vs", F.array_sort("vs")).join(n, key).withColumn("j", F.col("i") + F.col("lag")).where("i >= 0 and j >= 0 and i < n and j < n")
    return g.select(key, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.element_at("vs", F.size("vs") - radius).alias("v"))


def path(feat: DataFrame, key: str) -> DataFrame:
    """For series (key, pos, vec): exp(-d / s) for neighbouring positions, both ways, d being the squared distance and s the series' median of these."""
    w = Window.partitionBy(key).orderBy("pos")
    square = F.aggregate(F.zip_with("vec", "next", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    d = feat.select(key, F.col("pos").alias("i"), "vec", F.lead("vec").over(w).alias("next")).where("next IS NOT NULL").select(key, "i", square.alias("d"))
    s = d.groupBy(key).agg(F.percentile("d", 0.5).alias("s"))
    v = d.join(redealt(s, key), key).select(key, "i", F.exp(-F.coalesce(F.try_divide("d", "s"), F.lit(0.0))).alias("v"))
    ends = F.array(F.struct(F.col("i").alias("i"), (F.col("i") + 1).alias("j")), F.struct((F.col("i") + 1).alias("i"), F.col("i").alias("j")))
    return v.select(key, F.explode(ends).alias("e"), "v").select(key, "e.i", "e.j", "v")


def balance(rec: DataFrame, step: DataFrame, key: str) -> DataFrame:
    """(key, mu), the weight of recurrence beside path that evens their degrees out: the path degrees times all degrees over the squares of all degrees."""
    degree = lambda c, r, p: c.groupBy(key, "i").agg(F.sum("v").alias("x")).select(key, "i", r("x"), p("x"))
    zero = lambda name: lambda c: F.lit(0.0).alias(name)
    own = lambda name: lambda c: F.col(c).alias(name)
    d = degree(rec, own("r"), zero("p")).unionByName(degree(step, zero("r"), own("p"))).groupBy(key, "i").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    both = F.col("p") + F.col("r")
    return d.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.col("p") * both), F.sum(both * both)), F.lit(0.0)).alias("mu"))


def balanced(rec: DataFrame, step: DataFrame, key: str) -> DataFrame:
    """mu times recurrence and 1 - mu times path."""
    mu = redealt(balance(rec, step, key), key)
    u = rec.select(key, "i", "j", F.col("v").alias("r"), F.lit(0.0).alias("p")).unionByName(step.select(key, "i", "j", F.lit(0.0).alias("r"), F.col("v").alias("p")))
    u = u.groupBy(key, "i", "j").agg(F.sum("r").alias("r"), F.sum("p").alias("p")).join(mu, key)
    return u.select(key, "i", "j", (F.col("mu") * F.col("r") + (1 - F.col("mu")) * F.col("p")).alias("v"))


def affinity(rep: DataFrame, loc: DataFrame, key: str, width: int = 9, radius: int = 4) -> DataFrame:
    """The balanced affinity of series: recurrence of rep (key, pos, vec), smoothed along its diagonals, and path of loc."""
    return balanced(stored(lag_median(recurrence(rep, key, width), rep, key, radius), "recurrence"), stored(path(loc, key), "path"), key)


def foremost(feat: DataFrame, sizes: DataFrame, key: str, sigmas: list[float]) -> DataFrame:
    """The cells (key, i, j, v) of series that parameter_study keeps for any of the sigmas, found row by row where similarities are worked out; the others are never rows."""
    most = F.greatest(*[neighbours(F.col("n"), s) for s in sigmas]) if len(sigmas) > 1 else neighbours(F.col("n"), sigmas[0])
    return tiles.nearest(feat.join(sizes.select(key, most.alias("num_a")), key), feat, [key], tiles.by_similarity)


def parameter_study(cells: DataFrame, sizes: DataFrame, key: str, sigmas: list[float], betas: list[int]) -> DataFrame:
    """How promising the matrices of series (key, i, j, v; sizes: key, n) are that sigma (how many of a row's largest cells are kept) and beta (the least length of segments) give: (key, sigma, beta, rating, best_sigma, best), best_sigma and best telling whether sigma has the highest mean rating of its key, and beta the highest rating of that one; ties go to the smaller ones.

    Parameters are columns of one plan. Cells are ranked once; a cell is kept for the sigmas that reach its rank, and a segment for the betas that it is long enough for. Ratings are rounded before they are compared.
    """
    rank = F.row_number().over(Window.partitionBy(key, "i").orderBy(F.desc("v"), "j"))
    all_ = F.array(*[F.lit(float(s)) for s in sigmas])
    reach: Column = F.filter(all_, lambda s: F.col("rank") <= neighbours(F.col("n"), s))
    kept = cells.withColumn("rank", rank).join(sizes, key).select(key, "i", "j", F.explode(reach).alias("sigma"))
    segs = stored(diag_segments(kept, [key, "sigma"]), "segments")
    long = segs.select(key, "sigma", "i0", "j0", "len", F.explode(F.filter(F.array(*map(F.lit, betas)), lambda b: F.col("len") >= b)).alias("beta"))
    keys = [key, "sigma", "beta"]
    grid = sizes.select(key, "n", F.explode(all_).alias("sigma")).select(key, "n", "sigma", F.explode(F.array(*map(F.lit, betas))).alias("beta"))
    r = stored(matrix_rating(segment_cells(long, keys), grid, keys, True).withColumn("rating", F.round("rating", 6)), "ratings")
    mean = r.groupBy(key, "sigma").agg(F.round(F.avg("rating"), 6).alias("mean")).groupBy(key).agg(F.min_by("sigma", F.struct(-F.col("mean"), "sigma")).alias("s"))
    top = r.join(mean, key).where("sigma = s").groupBy(key).agg(F.first("s").alias("s"), F.min_by("beta", F.struct(-F.col("rating"), "beta")).alias("b"))
    own = F.col("sigma") == F.col("s")
    return r.join(redealt(top, key), key).select(key, "sigma", "beta", "rating", own.alias("best_sigma"), (own & (F.col("beta") == F.col("b"))).alias("best"))
