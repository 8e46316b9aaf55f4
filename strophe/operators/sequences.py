"""Encoding, windows and runs of sequences. Tables have a key (seq_id), a position (pos) from 0, and a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def by_pos(key: str = "seq_id") -> Window:
    return Window.partitionBy(key).orderBy("pos")


def intervals_from_points(points: DataFrame) -> DataFrame:
    """Intervals [t, next t) of time points; the last one never ends."""
    return points.select("seq_id", "pos", F.col("t").alias("start"), F.lead("t", 1, INF).over(by_pos()).alias("end"))


def as_of(left: DataFrame, right: DataFrame, value: str, keys: list[str], inclusive: bool = True, default=None) -> DataFrame:
    """left (keys, t, ...) with the value of the last row of right (keys, t, value) at or before t (before, if not inclusive). One pass over the union of both in order of time, so no inequality join."""
    columns = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col("t").alias("_t"), F.lit(1 if inclusive else -1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(*keys, F.col("t").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_row is not null")
    last = F.col("_last") if default is None else F.coalesce("_last", F.lit(default))
    return u.select(*keys, "_row.*", last.alias(value))


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of intervals (start, end) of a and b with one key that overlap; columns of b get the suffix _b. Both are cut into buckets of `width`, joined by key and bucket, and kept in the bucket where the later one begins, so there is no inequality join and a key with very many intervals is many buckets. An open end counts to the largest finite time of either table's key."""
    b = b.select([F.col(c).alias(c if c == key else f"{c}_b") for c in b.columns])
    cut = lambda s, e: F.sequence(F.floor(s / width), F.floor(e / width))
    last = a.select(key, F.col("start").alias("x")).unionByName(b.select(key, F.col("start_b").alias("x"))).groupBy(key).agg(F.max("x").alias("_last"))
    a = a.join(last, key).withColumn("_k", F.explode(cut(F.col("start"), F.greatest("start", F.least("end", "_last")))))
    b = b.join(last, key).withColumn("_k", F.explode(cut(F.col("start_b"), F.greatest("start_b", F.least("end_b", "_last"))))).drop("_last")
    hit = (F.col("start") < F.col("end_b")) & (F.col("start_b") < F.col("end")) & (F.col("_k") == F.floor(F.greatest("start", "start_b") / width))
    return a.drop("_last").join(b, [key, "_k"]).where(hit).drop("_k")


def grid_summarize(feature: DataFrame, grid: DataFrame, width: float = 86400.0) -> DataFrame:
    """For each interval of a grid (seq_id, pos, t) the value of the feature (seq_id, pos, t, value) that lasts longest in it, the earlier one on ties: a feature lasts until the next, the last one for ever."""
    f = intervals_from_points(feature).join(feature.select("seq_id", "pos", "value"), ["seq_id", "pos"])
    g = intervals_from_points(grid)
    x = overlap_join(g, f, "seq_id", width)
    share = F.least("end", "end_b") - F.greatest("start", "start_b")
    return x.groupBy("seq_id", "pos").agg(F.min_by("value_b", F.struct((-share).alias("a"), F.col("start_b").alias("b"))).alias("value"))


def mode(df: DataFrame, keys: list[str], value: str, strict: bool = False) -> DataFrame:
    """The most frequent value by keys, the smallest on ties; strict: -1 on ties. Summed up before the shuffle."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if not strict:
        return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), value))[value].alias(value))
    top = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("lo"))).alias("a"), F.min(F.struct((-F.col("n")).alias("n"), (-F.col(value)).alias("hi"))).alias("b"))
    return top.select(*keys, F.when(F.col("a.lo") == -F.col("b.hi"), F.col("a.lo")).otherwise(-1).alias(value))


def downsample_mode(seq: DataFrame, window: int, offset: int = 0) -> DataFrame:
    """The mode of every `window` positions from `offset` on; a last window that is not full is dropped."""
    s = seq.where(F.col("pos") >= offset).select("seq_id", F.floor((F.col("pos") - offset) / window).cast("int").alias("pos"), "sym")
    full = s.groupBy("seq_id", "pos").agg(F.count("*").alias("n")).where(F.col("n") == window).select("seq_id", "pos")
    return mode(s.join(full, ["seq_id", "pos"]), ["seq_id", "pos"], "sym")


def interpolate_grid(grid: DataFrame) -> DataFrame:
    """A grid with the middle between neighbours added, and half the last step after the last; twice the points."""
    w = by_pos()
    step = F.coalesce(F.lead("t").over(w) - F.col("t"), F.col("t") - F.lag("t").over(w))
    x = grid.withColumn("half", F.col("t") + step / 2)
    return x.select("seq_id", F.posexplode(F.array("t", "half")).alias("k", "t"), F.col("pos").alias("p")).select("seq_id", (2 * F.col("p") + F.col("k")).cast("int").alias("pos"), "t").where("t is not null")


def framed(df: DataFrame, value: Column, radius: int, how: str, keys: list[str], order: str = "pos") -> Column:
    """Median or mean of the value in the 2 * radius + 1 rows around, with the first and last `radius` values as they are."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-radius, radius)
    inside = F.percentile(value, 0.5) if how == "median" else F.avg(value)
    full = F.count("*").over(frame) == 2 * radius + 1
    return F.when(full, inside.over(frame)).otherwise(value)


def median_filter(seq: DataFrame, radius: int, value: str = "value") -> DataFrame:
    return seq.select("seq_id", "pos", framed(seq, F.col(value), radius, "median", ["seq_id"]).alias(value))


def mean_filter(seq: DataFrame, radius: int, value: str = "value") -> DataFrame:
    return seq.select("seq_id", "pos", framed(seq, F.col(value), radius, "mean", ["seq_id"]).alias(value))


def running_mean(seq: DataFrame, n: int, value: str = "value") -> DataFrame:
    """The mean of n values, placed at round(n / 2) (half to even) before the first full window's end; null where no full window is."""
    before = int(round(n / 2))
    frame = by_pos().rowsBetween(-before, n - 1 - before)
    return seq.select("seq_id", "pos", F.when(F.count("*").over(frame) == n, F.avg(value).over(frame)).alias(value))


def islands(df: DataFrame, keys: list[str], order: str, new: Column, name: str = "grp") -> DataFrame:
    """df with the number, from 0, of the run that a row is in by keys; a run begins where `new` is true."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn(name, F.sum("_new").over(w).cast("int")).drop("_new")


def group_adjacent(df: DataFrame, keys: list[str], value: str, most: float = 1) -> DataFrame:
    """Runs of values whose steps are at most `most`: (keys, grp, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(value)
    g = islands(df, keys, value, F.col(value) - F.lag(value).over(w) > most)
    return g.groupBy(*keys, "grp").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n"))


def relabel_adjacent(seq: DataFrame) -> DataFrame:
    """The number of the run of equal symbols that a position is in."""
    return islands(seq, ["seq_id"], "pos", F.col("sym") != F.lag("sym").over(by_pos()), "run").select("seq_id", "pos", "run")


def subarray_search(seq: DataFrame, wanted: list[int]) -> DataFrame:
    """Positions where the wanted symbols follow one another."""
    w = by_pos()
    hit = F.lit(True)
    for k, x in enumerate(wanted):
        hit = hit & (F.lead("sym", k).over(w) == x)
    return seq.withColumn("hit", hit).where("hit").select("seq_id", "pos")


def ordered_unique(seq: DataFrame) -> DataFrame:
    """The symbols of a sequence in the order in which they first come: (seq_id, ord, sym)."""
    f = seq.groupBy("seq_id", "sym").agg(F.min("pos").alias("pos"))
    return f.select("seq_id", (F.row_number().over(by_pos()) - 1).cast("int").alias("ord"), "sym")


def block_summarize(cells: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """A matrix (keys, i, j, v) by blocks: each axis is cut into floor(n / window) nearly equal parts, the first ones longer by one; (keys, bi, bj, v) with the mean of a block."""

    def block(x: str, n: str) -> Column:
        parts = F.greatest(F.floor(F.col(n) / window), F.lit(1))
        short, longer = F.floor(F.col(n) / parts), F.pmod(F.col(n), parts)
        cut = longer * (short + 1)
        return F.when(F.col(x) < cut, F.floor(F.col(x) / (short + 1))).otherwise(longer + F.floor((F.col(x) - cut) / short)).cast("int")

    size = cells.groupBy(*keys).agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"))
    c = cells.join(size, keys)
    return c.select(*keys, block("i", "ni").alias("bi"), block("j", "nj").alias("bj"), "v").groupBy(*keys, "bi", "bj").agg(F.avg("v").alias("v"))


def chunks(seq: DataFrame, n: int) -> DataFrame:
    """seq with the number of the chunk of n positions that a row is in."""
    return seq.withColumn("chunk", F.floor(F.col("pos") / n).cast("int"))
