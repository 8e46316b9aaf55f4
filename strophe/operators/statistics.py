"""Histograms, divergences, tempo and outliers of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import redealt
from .sequences import as_of, by_pos


def frequency_hist(seq: DataFrame, relative: bool = False) -> DataFrame:
    """Counts, or shares, of symbols: (seq_id, sym, n)."""
    n = seq.groupBy("seq_id", "sym").agg(F.count("*").alias("n"))
    return share(n, ["seq_id"]) if relative else n


def share(hist: DataFrame, keys: list[str]) -> DataFrame:
    """n over its sum by keys."""
    return hist.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def tuple_hist(seq: DataFrame, size: int, relative: bool = False, uniform_only: bool = False) -> DataFrame:
    """Counts, or shares, of the tuples of `size` symbols that follow one another; the tuple is given as text, joined by "-"."""
    w = by_pos()
    parts = [F.lead("sym", k).over(w).alias(f"s{k}") for k in range(size)]
    t = seq.select("seq_id", *parts).where(f"s{size - 1} is not null")
    if uniform_only:
        t = t.where(" and ".join(f"s0 = s{k}" for k in range(1, size)))
    n = t.groupBy("seq_id", F.concat_ws("-", *[F.col(f"s{k}").cast("string") for k in range(size)]).alias("gram")).agg(F.count("*").alias("n"))
    return share(n, ["seq_id"]) if relative else n


def freq_trans_hist(seq: DataFrame) -> DataFrame:
    """Shares of symbols and of pairs together: (seq_id, gram, n)."""
    one = frequency_hist(seq).select("seq_id", F.col("sym").cast("string").alias("gram"), "n")
    return share(one.unionByName(tuple_hist(seq, 2)), ["seq_id"])


def song(seq: str = "seq_id", size: int = 50) -> Column:
    """The song that a sequence is a version of, where tables do not say: `size` sequences with neighbouring ids."""
    return F.floor(F.col(seq) / size)


def chi2_distances(hist: DataFrame) -> DataFrame:
    """Chi-squared distances of all pairs of sequences of a song, itself included, over (seq_id, gram, n): (song, a, b, d). Only the bins that a sequence has are stored: over those that both have, the joined terms count; bins of one alone count n * n / (n + 1e-6), which is what the sum over all of a sequence's bins leaves when the common ones are taken off. So pairs meet on common bins and no vector is as wide as the dictionary."""
    h = hist.select(song().alias("song"), "seq_id", "gram", F.col("n").cast("double").alias("n"))
    alone = F.col("n") * F.col("n") / (F.col("n") + 1e-6)
    total = h.groupBy("song", "seq_id").agg(F.sum(alone).alias("all"))
    a = h.select("song", F.col("seq_id").alias("a"), "gram", F.col("n").alias("x"))
    b = h.select("song", F.col("seq_id").alias("b"), "gram", F.col("n").alias("y"))
    of = lambda n: n * n / (n + 1e-6)
    x, y = F.col("x"), F.col("y")
    common = a.join(b, ["song", "gram"]).groupBy("a", "b").agg(F.sum((x - y) * (x - y) / (x + y + 1e-6) - of(x) - of(y)).alias("both"))
    pairs = total.select("song", F.col("seq_id").alias("a"), F.col("all").alias("ta")).join(total.select("song", F.col("seq_id").alias("b"), F.col("all").alias("tb")), "song")
    return pairs.join(common, ["a", "b"], "left").select("song", "a", "b", (F.lit(0.5) * (F.col("ta") + F.col("tb") + F.coalesce("both", F.lit(0.0)))).alias("d"))


def entropy(df: DataFrame, keys: list[str], value: str, base: float = 2.0) -> DataFrame:
    """Entropy of the values by keys."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    # log(N) - sum(n log n) / N, from two sums
    e = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    return n.groupBy(*keys).agg((e / F.log(F.lit(base))).alias("entropy"))


def tempo(grid: DataFrame) -> DataFrame:
    """60 over the mean step of a grid; null for fewer than two points."""
    return grid.groupBy("seq_id").agg(F.try_divide(F.lit(60.0) * (F.count("*") - 1), F.max("t") - F.min("t")).alias("tempo"))


def onset_position(onsets: DataFrame, grid: DataFrame) -> DataFrame:
    """Where in its beat, in [0, 1), an onset is: (seq_id, pos, rel). Onsets before the first and from the last beat on are left out."""
    w = by_pos()
    beats = grid.select("seq_id", "t", F.struct(F.col("t").alias("start"), F.lead("t").over(w).alias("end")).alias("beat"))
    x = as_of(onsets, beats, "beat", ["seq_id"])
    return x.where("beat is not null and beat.end is not null and beat.end > beat.start").select("seq_id", "pos", ((F.col("t") - F.col("beat.start")) / (F.col("beat.end") - F.col("beat.start"))).alias("rel"))


def onset_hist(onsets: DataFrame, grid: DataFrame, bins: int = 200) -> DataFrame:
    """Shares of onsets by place in the beat: (seq_id, bin, n). Bins are equal parts of a sequence's least to greatest place; if all are one place, of the unit around it."""
    p = onset_position(onsets, grid)
    w = Window.partitionBy("seq_id")
    lo, hi = F.min("rel").over(w), F.max("rel").over(w)
    p = p.select("seq_id", "rel", F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))
    bin_ = F.least(F.floor((F.col("rel") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return share(p.groupBy("seq_id", bin_.alias("bin")).agg(F.count("*").alias("n")), ["seq_id"])


def outlier_scores(distances: DataFrame) -> DataFrame:
    """How many deviations of all distances of its song a sequence's mean distance (to itself too) is from their mean: (seq_id, z). Deviations are of the population."""
    mean = distances.groupBy("song", "a").agg(F.avg("d").alias("m"))
    total = distances.groupBy("song").agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sd"))
    return mean.join(total, "song").select(F.col("a").alias("seq_id"), F.abs(F.try_divide(F.col("m") - F.col("mu"), F.col("sd"))).alias("z"))


def reject_outliers(df: DataFrame, value: str, m: float = 2.0) -> DataFrame:
    """Rows within m population deviations of the mean."""
    s = df.agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return df.crossJoin(F.broadcast(s)).where(F.abs(F.col(value) - F.col("_mu")) < m * F.col("_sd")).drop("_mu", "_sd")


def outlier_filter(scores: list[DataFrame], least: float = 2.5, several: int = 2, most: float = 4.0) -> DataFrame:
    """Sequences that fewer than `several` scores put beyond `least` deviations and none beyond `most`: (seq_id)."""
    u = scores[0]
    for s in scores[1:]:
        u = u.unionByName(s)
    g = u.groupBy("seq_id").agg(F.sum((F.col("z") > least).cast("int")).alias("far"), F.max("z").alias("z"))
    return g.where((F.col("far") < several) & (F.col("z") <= most)).select("seq_id")


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """(seq_id, z): absolute deviations of a value from the mean of all, in population deviations."""
    s = df.agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    return df.crossJoin(F.broadcast(s)).select("seq_id", F.abs(F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd"))).alias("z"))


def adjusted(seq: DataFrame, factor: str) -> DataFrame:
    """A sequence at another tempo: "1" as it is, "2" each symbol twice, "1/2" the mode of every two, "2/3" each twice and the mode of every three."""
    from .sequences import downsample_mode

    twice = seq.select("seq_id", "pos", "sym", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("seq_id", (2 * F.col("pos") + F.col("k")).cast("int").alias("pos"), "sym")
    return {"1": lambda: seq.select("seq_id", "pos", "sym"), "2": lambda: twice, "1/2": lambda: downsample_mode(seq, 2), "2/3": lambda: downsample_mode(twice, 3)}[factor]()


FACTORS = {"1": 1.0, "2": 2.0, "1/2": 0.5, "2/3": 2 / 3}


def adjusted_each(seq: DataFrame, choice: DataFrame) -> DataFrame:
    """Every sequence (seq_id, pos, sym) at its own tempo, as adjusted() has them for one: choice (seq_id, factor) names it; sequences without one stay as they are. One pass: symbols are repeated by the factor's numerator, and the mode of every so many as its denominator says is taken."""
    name = F.coalesce("factor", F.lit("1"))
    times, every = F.when(name.isin("2", "2/3"), 2).otherwise(1), F.when(name == "1/2", 2).when(name == "2/3", 3).otherwise(1)
    d = seq.select("seq_id", "pos", "sym").join(choice.select("seq_id", "factor"), "seq_id", "left").select("seq_id", "pos", "sym", times.alias("times"), every.alias("every"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("pos", F.floor((F.col("pos") * F.col("times") + F.col("k")) / F.col("every")).cast("int"))
    d = d.groupBy("seq_id", "pos", "every", "sym").agg(F.count("*").alias("n")).groupBy("seq_id", "pos", "every").agg(F.sum("n").alias("n"), F.min_by("sym", F.struct(-F.col("n"), "sym")).alias("sym"))
    return d.where("n = every").select("seq_id", "pos", "sym")


def double_time_choice(seq: DataFrame, grid: DataFrame, low: float, high: float, size: int = 4) -> DataFrame:
    """For each sequence the tempo factor, among 1, 2, 1/2 and 2/3, whose n-gram histogram is nearest by chi-squared to the mean histogram of all and whose tempo is nearest to the mean tempo: the least sum of both distances, each over its greatest value. Factors count only if the new tempo is in the range and within half and double the mean; 1 always does. Ties go to the earlier one."""
    t = tempo(grid).where("tempo is not null")
    mean = F.broadcast(t.agg(F.avg("tempo").alias("mean")))
    g1 = tuple_hist(seq, size, relative=True)
    n_all = F.broadcast(seq.agg(F.count_distinct("seq_id").alias("n_all")))
    centre = g1.groupBy("gram").agg(F.sum("n").alias("c")).crossJoin(n_all).select("gram", (F.col("c") / F.col("n_all")).alias("c"))
    parts = []
    for k, (name, f) in enumerate(FACTORS.items()):
        h = tuple_hist(adjusted(seq, name), size, relative=True)
        own = F.col("n") * F.col("n") / (F.col("n") + 1e-6)
        c = F.col("c")
        d = h.join(centre, "gram", "left").groupBy("seq_id").agg(F.sum(F.when(c.isNull(), own).otherwise((F.col("n") - c) * (F.col("n") - c) / (F.col("n") + c + 1e-6) - c * c / (c + 1e-6))).alias("d"))
        parts.append(d.select("seq_id", F.lit(k).alias("k"), F.lit(name).alias("factor"), F.lit(f).alias("f"), "d"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    base = F.broadcast(centre.agg(F.sum(F.col("c") * F.col("c") / (F.col("c") + 1e-6)).alias("base")))
    u = u.crossJoin(base).withColumn("d", F.lit(0.5) * (F.col("d") + F.col("base")))
    u = u.join(t, "seq_id").crossJoin(mean).withColumn("new", F.col("tempo") * F.col("f"))
    u = u.withColumn("td", F.abs(F.col("new") - F.col("mean")))
    w = Window.partitionBy("seq_id")
    fits = (F.col("k") == 0) | ((F.col("new") >= low) & (F.col("new") <= high) & (F.col("new") >= F.col("mean") / 2) & (F.col("new") <= F.col("mean") * 2))
    score = F.coalesce(F.try_divide("d", F.max("d").over(w)), F.lit(0.0)) + F.coalesce(F.try_divide("td", F.max("td").over(w)), F.lit(0.0))
    u = u.withColumn("score", F.round(score, 9)).where(fits)
    return u.groupBy("seq_id").agg(F.min_by("factor", F.struct("score", "k")).alias("factor"))


def multiset_overlap(seq: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of sequences: common, the size of the common part of their symbols as multisets, isect, common over the longer one's length, and jaccard, common over the united size."""
    n = frequency_hist(seq)
    size = seq.groupBy("seq_id").agg(F.count("*").alias("len"))
    x = pairs.join(n.select(F.col("seq_id").alias("a"), "sym", F.col("n").alias("x")), "a").join(n.select(F.col("seq_id").alias("b"), "sym", F.col("n").alias("y")), ["b", "sym"])
    c = x.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("common"))
    p = pairs.join(size.select(F.col("seq_id").alias("a"), F.col("len").alias("la")), "a").join(size.select(F.col("seq_id").alias("b"), F.col("len").alias("lb")), "b").join(c, ["a", "b"], "left")
    common = F.coalesce("common", F.lit(0))
    return p.select("a", "b", common.alias("common"), (common / F.greatest("la", "lb")).alias("isect"), (common / (F.col("la") + F.col("lb") - common)).alias("jaccard"))


def ring_pairs(seq: DataFrame, partners: int = 20, seed: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of a song's sequences, and how far apart they are (step) in the order of a seeded hash, as a ring, up to half of `partners`; nearer pairs do not hang on `partners`."""
    ids = seq.select(song().alias("song"), "seq_id").distinct()
    w = Window.partitionBy("song").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq_id").cast("string"))), "seq_id")
    ring = ids.withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("song")))
    half = (partners + 1) // 2
    step = ring.select("song", F.col("seq_id").alias("x"), "n", F.explode(F.sequence(F.lit(1), F.lit(half))).alias("s") if half else F.lit(0).alias("s"), "k").where("s > 0 and s < n").select("song", "x", "s", F.pmod(F.col("k") + F.col("s"), F.col("n")).alias("k"))
    p = step.join(ring.select("song", F.col("seq_id").alias("y"), "k"), ["song", "k"]).where("x <> y")
    return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("s").alias("step"))


def pairings(seq: DataFrame, partners: int = 20, seed: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of a song's sequences in which each has at least `partners` others if there are so many: sequences in the order of a seeded hash, as a ring; each is paired with the next ones."""
    return ring_pairs(seq, partners, seed).select("a", "b")


def freq_variation(seq: DataFrame) -> DataFrame:
    """The mean rank, from 0, of a sequence's symbols by falling frequency."""
    n = frequency_hist(seq)
    r = n.withColumn("k", F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("n"), "sym")) - 1)
    return r.groupBy("seq_id").agg((F.sum(F.col("k") * F.col("n")) / F.sum("n")).alias("variation"))


def min_max(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The value scaled to 0 to 1 by keys; null where all are one value."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.try_divide(F.col(value) - lo, hi - lo))


def tempo_factor(tempo: Column, low: float, high: float) -> Column:
    """The power of two that brings a tempo to at least `low`, and then to at most `high`."""
    up = F.when(tempo < low, F.ceil(F.log2(low / tempo))).otherwise(0)
    t = tempo * F.pow(F.lit(2.0), up)
    down = F.when(t > high, F.ceil(F.log2(t / high))).otherwise(0)
    return F.pow(F.lit(2.0), up - down)


def adjusted_grid(grid: DataFrame, factor: str) -> DataFrame:
    """A grid at another tempo: "2" with the middles between its points, "1/2" and "1/3" every second or third point, "2/3" every third with the middles."""
    from .sequences import interpolate_grid

    def every(g: DataFrame, n: int) -> DataFrame:
        return g.where(F.col("pos") % n == 0).select("seq_id", (F.col("pos") / n).cast("int").alias("pos"), "t")

    return {"1": lambda: grid.select("seq_id", "pos", "t"), "2": lambda: interpolate_grid(grid), "1/2": lambda: every(grid, 2), "1/3": lambda: every(grid, 3), "2/3": lambda: every(interpolate_grid(grid), 3)}[factor]()


def chi2_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chi-squared distances of every sequence of one histogram table (seq_id, gram, n) to every one of its song in another: (song, a, b, d), over stored bins as in chi2_distances."""
    alone = F.col("n") * F.col("n") / (F.col("n") + 1e-6)
    of = lambda n: n * n / (n + 1e-6)
    x, y = F.col("x"), F.col("y")

    def side(h: DataFrame, name: str, value: str) -> tuple[DataFrame, DataFrame]:
        h = h.select(song().alias("song"), F.col("seq_id").alias(name), "gram", F.col("n").cast("double").alias("n"))
        return h.withColumnRenamed("n", value), h.groupBy("song", name).agg(F.sum(alone).alias(f"t{name}"))

    (a, ta), (b, tb) = side(left, "a", "x"), side(right, "b", "y")
    common = a.join(b, ["song", "gram"]).groupBy("a", "b").agg(F.sum((x - y) * (x - y) / (x + y + 1e-6) - of(x) - of(y)).alias("both"))
    return ta.join(tb, "song").join(common, ["a", "b"], "left").select("song", "a", "b", (F.lit(0.5) * (F.col("ta") + F.col("tb") + F.coalesce("both", F.lit(0.0)))).alias("d"))


def tempo_votes(plain: DataFrame, fewer: DataFrame, more: DataFrame, threshold: float = 0.33) -> DataFrame:
    """Which sequences of a song stand at half or double the tempo of the others, by histograms (seq_id, gram, n) of each as it is, at half as many symbols and at twice as many. To every other sequence as it is, a sequence votes 0, 1 or -1 for the nearest of its three, the first of equals; its score is half of its mean vote less the mean of the votes on it; choice is 1 or -1 beyond the threshold: (seq_id, score, choice)."""
    u = None
    for k, (vote, h) in enumerate(((0, plain), (1, fewer), (-1, more))):
        d = chi2_between(h, plain).select("song", "a", "b", F.struct(F.round("d", 9).alias("d"), F.lit(k).alias("k"), F.lit(vote).alias("vote")).alias("s"))
        u = d if u is None else u.unionByName(d)
    votes = u.groupBy("song", "a", "b").agg(F.min("s")["vote"].alias("vote"))
    given = votes.groupBy(F.col("a").alias("seq_id")).agg(F.avg("vote").alias("given"))
    got = votes.groupBy(F.col("b").alias("seq_id")).agg(F.avg("vote").alias("got"))
    x = given.join(got, "seq_id").select("seq_id", F.round((F.col("given") - F.col("got")) / 2, 9).alias("score"))
    return x.withColumn("choice", F.when(F.col("score") > threshold, 1).when(F.col("score") < -threshold, -1).otherwise(0))


def interval_hists(segs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shares of the distances at which a sequence repeats itself (seq_id, gram, n), from its segments: as they are, halved and doubled."""
    d = segs.select("seq_id", (F.col("j0") - F.col("i0")).alias("d"))

    def hist(value: Column) -> DataFrame:
        return share(d.groupBy("seq_id", value.cast("string").alias("gram")).agg(F.count("*").alias("n")), ["seq_id"])

    return hist(F.col("d")), hist(F.floor(F.col("d") / 2)), hist(F.col("d") * 2)


def density_peaks(points: DataFrame, value: str = "rel", resolution: int = 1000) -> DataFrame:
    """Where the density of a sequence's values has local maxima: a Gaussian kernel density, its width n ** -0.2 sample deviations, at `resolution` places from the least to the greatest value: (seq_id, place). Sequences of one value have none. Points stay where they are: a task sums up what its points of a sequence add to each place."""
    s = points.groupBy("seq_id").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd")).where("n > 1 and sd > 0")
    x = points.select("seq_id", F.col(value).cast("double").alias("v")).join(redealt(s, "seq_id"), "seq_id").select("seq_id", "v", "lo", "hi", (F.col("sd") * F.pow("n", F.lit(-0.2))).alias("width"))

    def sums(frames):
        """Of each sequence in a batch the sums over its points there, place by place: one row a sequence."""
        for f in frames:
            rows = []
            for seq, g in f.groupby("seq_id"):
                at = g["lo"].iloc[0] + (g["hi"].iloc[0] - g["lo"].iloc[0]) * np.arange(resolution) / (resolution - 1)
                y = np.zeros(resolution)
                for k in range(0, len(g), 4096):
                    y += np.exp(-0.5 * ((at[:, None] - g["v"].to_numpy()[None, k : k + 4096]) / g["width"].iloc[0]) ** 2).sum(1)
                rows.append((seq, y.tolist()))
            yield pd.DataFrame(rows, columns=["seq_id", "ys"])

    part = x.mapInPandas(sums, f"seq_id {dict(points.dtypes)['seq_id']}, ys array<double>")
    density = part.select("seq_id", F.posexplode("ys").alias("place", "y")).groupBy("seq_id", "place").agg(F.round(F.sum("y"), 9).alias("y"))
    w = Window.partitionBy("seq_id").orderBy("place")
    d = density.withColumn("before", F.lag("y").over(w)).withColumn("after", F.lead("y").over(w))
    return d.where("before < y and after < y").select("seq_id", "place")


def vector_measures(feat: DataFrame, key: str, resolution: int = 100) -> DataFrame:
    """Of a series of vectors (key, pos, vec): the population coefficient of variation of the vectors' means, and the entropy (bits) of the means' shares, each rounded to `resolution` steps of the greatest: (key, variation, entropy)."""
    mean = feat.select(key, (F.aggregate("vec", F.lit(0.0), lambda s, x: s + x) / F.size("vec")).alias("m"))
    top = mean.groupBy(key).agg(F.max("m").alias("top"), F.try_divide(F.stddev_pop("m"), F.avg("m")).alias("variation"))
    q = mean.join(top, key).select(key, "variation", F.bround(F.round(F.col("m") / F.col("top") * resolution, 9)).cast("long").alias("q"))
    n = q.groupBy(key, "variation", "q").agg(F.count("*").alias("n"))
    return n.groupBy(key, "variation").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def nonzero_distances(seq: DataFrame, value: str = "value") -> DataFrame:
    """For each position with a value other than zero, but the last one, how far the next one is: (seq_id, pos, dist)."""
    w = by_pos()
    return seq.where(F.col(value) != 0).select("seq_id", "pos", (F.lead("pos").over(w) - F.col("pos")).alias("dist")).where("dist is not null")


def peaks(y, prominence: float = 0.0, distance: int = 1) -> list[int]:
    """Local maxima of a curve (the middle, the earlier of two, of a plateau): first those nearer than `distance` to a higher one go, the highest first and the later of equals; then those that rise less than `prominence` over the higher of the lowest points on either side up to where the curve is higher."""
    import numpy as np

    y = np.asarray(y, float)
    found, k = [], 1
    while k < len(y) - 1:
        end = k
        while end < len(y) - 1 and y[end + 1] == y[k]:
            end += 1
        if y[k - 1] < y[k] and end < len(y) - 1 and y[end + 1] < y[k]:
            found.append((k + end) // 2)
        k = end + 1
    kept = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (y[p], p), reverse=True):
        if kept[p]:
            kept.update({q: False for q in found if q != p and abs(q - p) < distance})

    def rise(p: int) -> float:
        left = right = y[p]
        for k in range(p - 1, -1, -1):
            if y[k] > y[p]:
                break
            left = min(left, y[k])
        for k in range(p + 1, len(y)):
            if y[k] > y[p]:
                break
            right = min(right, y[k])
        return float(y[p] - max(left, right))

    return [p for p in found if kept[p] and rise(p) >= prominence]
