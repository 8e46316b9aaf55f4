"""Values over time relative to groups, and analytics of result tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import redealt


def relative(df: DataFrame, group: str = "grp", value: str = "value") -> DataFrame:
    """The value over its group's mean. Means come from an aggregate that is summed up before the shuffle, and are dealt anew for the join, so that Spark may split a very large group."""
    mean = df.groupBy(group).agg(F.avg(value).alias("_mean"))
    return df.join(redealt(mean, group), group).withColumn(value, F.try_divide(value, F.col("_mean"))).drop("_mean")


def average_same_dates(df: DataFrame, value: str = "value") -> DataFrame:
    """The mean of each date."""
    return df.groupBy("date").agg(F.avg(value).alias(value))


def year_counts(df: DataFrame, group: str = "grp") -> DataFrame:
    """Rows by year and group for all years from the first to the last, with zeros, and the running sum over groups within a year (cum)."""
    n = df.groupBy(F.year("date").alias("year"), group).agg(F.count("*").alias("n"))
    span = n.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    spine = span.crossJoin(n.select(group).distinct())  # years by groups: the result's own size
    full = spine.join(n, ["year", group], "left").na.fill(0, ["n"])
    return full.withColumn("cum", F.sum("n").over(Window.partitionBy("year").orderBy(group)))


def year_share(df: DataFrame, group: str = "grp") -> DataFrame:
    """The share of each group in a year's rows; years without rows are left out."""
    n = df.groupBy(F.year("date").alias("year"), group).agg(F.count("*").alias("n"))
    return n.select("year", group, (F.col("n") / F.sum("n").over(Window.partitionBy("year"))).alias("share"))


def _lowess(x: np.ndarray, y: np.ndarray, at: np.ndarray, frac: float) -> np.ndarray:
    """Locally weighted linear regression: at each place the nearest share `frac` of points counts, by tricube weights."""
    n = len(x)
    k = max(2, min(n, int(frac * n + 1e-10)))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    out = np.full(len(at), np.nan)
    for m, p in enumerate(at):
        j = int(np.searchsorted(x, p))
        a, b = max(0, j - k), min(n, j + k)
        d = np.abs(x[a:b] - p)
        near = np.argsort(d, kind="stable")[:k]
        h = d[near].max()
        xs, ys = x[a:b][near], y[a:b][near]
        if h == 0:
            out[m] = ys.mean()
            continue
        w = np.clip(1 - (d[near] / h) ** 3, 0, None) ** 3
        s = w.sum()
        if s <= 0:
            out[m] = ys.mean()
            continue
        mx, my = (w * xs).sum() / s, (w * ys).sum() / s
        var = (w * (xs - mx) ** 2).sum()
        out[m] = my if var <= 1e-12 * max(h * h, 1e-300) else my + (w * (xs - mx) * (ys - my)).sum() / var * (p - mx)
    return out


def lowess(df: DataFrame, key: str, frac: float = 0.2) -> DataFrame:
    """A smooth curve for each key through (x, y) at the distinct x: (key, x, y). The values of one x count by their number and mean, which an aggregate finds first, so that a key is as long as its distinct x and not as its rows."""
    m = df.groupBy(key, "x").agg(F.avg("y").alias("y"), F.count("*").alias("n"))

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        return pd.DataFrame({key: pdf[key], "x": x, "y": _lowess(x, y, x, frac)})

    return m.groupBy(key).applyInPandas(f, f"{key} {m.schema[key].dataType.simpleString()}, x double, y double")


def lowess_loo_band(df: DataFrame, group: str, frac: float = 0.2) -> DataFrame:
    """The full curve through (group, x, y), and the least and greatest of the curves that leave out a group each: (x, y, lo, hi). Each curve is a task of its own; groups are a stated few, with a row each."""
    d = df.groupBy(group, "x").agg(F.avg("y").alias("y"))
    total = d.groupBy("x").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    groups = d.select(F.col(group).cast("string").alias("left_out")).distinct().where("left_out is not null")
    # a row for each curve and place, as the curves have: the sum of all less the group's own
    own = d.select(F.col(group).cast("string").alias("left_out"), "x", F.col("y").alias("own"))
    each = total.crossJoin(F.broadcast(groups)).join(own, ["left_out", "x"], "left")
    less = each.select("left_out", "x", (F.col("s") - F.coalesce("own", F.lit(0.0))).alias("s"), (F.col("n") - F.col("own").isNotNull().cast("int")).alias("n")).where("n > 0")
    curves = less.unionByName(total.withColumn("left_out", F.lit("")).select(less.columns)).select("left_out", "x", (F.col("s") / F.col("n")).alias("y"))
    c = lowess(curves, "left_out", frac)
    full = c.where("left_out = ''").select("x", "y")
    band = c.where("left_out != ''").groupBy("x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return full.join(band, "x", "left")


def nested(df: DataFrame, column: str, path: str) -> Column:
    """The value at a path of keys of a JSON text, null where there is none."""
    return F.get_json_object(df[column], "$." + path)


def avg_over_refs(results: DataFrame, measures: tuple[str, ...] = ("p", "r", "l"), over: tuple[str, ...] = ("ref",)) -> DataFrame:
    """Means of the measures over the reference annotations, by all other columns."""
    keys = [c for c in results.columns if c not in measures + over]
    return results.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def best_per_group(results: DataFrame, keys: list[str], measure: str, ties: list[str]) -> DataFrame:
    """The row with the greatest measure by keys; ties go to the smallest of `ties`. An aggregate of a struct, summed up before the shuffle."""
    rest = [c for c in results.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(measure)).alias("m"), *ties))
    return results.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def missing_runs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted that are not done yet."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def add_missing(done: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """done with those rows of new whose keys it does not have."""
    return done.unionByName(missing_runs(new, done, keys).select(*done.columns))


def rows_exist(results: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `there`, whether the results have their keys."""
    return rows.join(results.select(*keys).distinct().withColumn("there", F.lit(True)), keys, "left").na.fill(False, ["there"])


def method_diff(results: DataFrame, a: str, b: str, measure: str = "l") -> DataFrame:
    """For each item that both methods have: the mean of a less that of b."""
    m = results.where(F.col("method").isin(a, b)).groupBy("item").agg(F.avg(F.when(F.col("method") == a, F.col(measure))).alias("x"), F.avg(F.when(F.col("method") == b, F.col(measure))).alias("y"))
    return m.where("x is not null and y is not null").select("item", (F.col("x") - F.col("y")).alias("diff"))


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """The five numbers of a box plot by key."""
    q = df.groupBy(key).agg(F.percentile(value, F.array(*[F.lit(x / 4) for x in range(5)])).alias("q"))
    return q.select(key, *[F.col("q")[k].alias(f"q{k}") for k in range(5)])


def running_mean_by_date(df: DataFrame, n: int) -> DataFrame:
    """The mean of the last n values of a group in order of date."""
    w = Window.partitionBy("grp").orderBy("date", "version").rowsBetween(-(n - 1), 0)
    return df.select("grp", "version", "date", F.when(F.count("*").over(w) == n, F.avg("value").over(w)).alias("mean"))



def versions_by_date(ids: DataFrame, today: str) -> DataFrame:
    """Recordings (grp, version) in order of the date in their names: after two letters, two digits each for year, month and day with signs between, up to a full stop. Years are those of this century unless that is after `today`: (grp, version, date, ord). Names without a date come last, by name."""
    d = F.to_date(F.concat(F.lit("20"), F.regexp_extract("version", r"^..(\d\d-\d\d-\d\d)(\.|$)", 1)), "yyyy-MM-dd")
    d = F.when(F.regexp_like("version", F.lit(r"^..\d\d-\d\d-\d\d(\.|$)")), d)
    x = ids.withColumn("date", d).withColumn("date", F.when(F.col("date") > F.lit(today).cast("date"), F.add_months("date", -1200)).otherwise(F.col("date")))
    w = Window.partitionBy("grp").orderBy(F.col("date").asc_nulls_last(), "version")
    return x.select("grp", "version", "date", (F.row_number().over(w) - 1).cast("int").alias("ord"))


def relative_coefficients(df: DataFrame, keys: list[str], group: str = "grp", value: str = "value") -> DataFrame:
    """The coefficient of variation (sample deviation over mean) of a value by group and keys, over the group's mean coefficient: (group, keys, coefficient, relative)."""
    c = df.groupBy(group, *keys).agg(F.try_divide(F.stddev_samp(value), F.avg(value)).alias("coefficient"))
    return c.withColumn("relative", F.try_divide("coefficient", F.avg("coefficient").over(Window.partitionBy(group))))


def overall_evolution(df: DataFrame, n: int) -> DataFrame:
    """The mean of a date's values over all groups, as they are and relative to their groups' means, and the running mean of the last n dates: (date, value, relative, mean, relative_mean), null until there are n. A row for each date, so ordering them in one task is bounded by the calendar."""
    both = relative(df.withColumn("own", F.col("value"))).groupBy("date").agg(F.avg("own").alias("value"), F.avg("value").alias("relative"))
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    full = lambda c: F.when(F.count("*").over(w) == n, F.avg(c).over(w))
    return both.select("date", "value", "relative", full("value").alias("mean"), full("relative").alias("relative_mean"))


def best_level(results: DataFrame, param: str, measure: str = "l") -> DataFrame:
    """For each item the parameter value with the greatest mean measure, the smallest of equals: (item, param, measure)."""
    m = results.groupBy("item", param).agg(F.round(F.avg(measure), 9).alias(measure))
    return best_per_group(m, ["item"], measure, [param])


def several_references(results: DataFrame, method: str) -> DataFrame:
    """Items that a method was held against more than one reference of: (item, refs)."""
    return results.where(F.col("method") == method).groupBy("item").agg(F.count_distinct("ref").alias("refs")).where("refs > 1")


def rating_study(results: DataFrame, ratings: DataFrame, param: str, measure: str = "l") -> DataFrame:
    """How well a rating (item, param, rating) chooses a parameter: over all items, the mean measure at the value that is rated best (the smaller of equals), the mean of the best measure, and the share of items where both are one: (items, chosen, best, hits)."""
    m = results.groupBy("item", param).agg(F.round(F.avg(measure), 9).alias(measure))
    pick = best_per_group(ratings, ["item"], "rating", [param]).select("item", param)
    x = m.join(pick, ["item", param]).select("item", F.col(measure).alias("chosen")).join(m.groupBy("item").agg(F.max(measure).alias("best")), "item")
    return x.agg(F.count("*").alias("items"), F.avg("chosen").alias("chosen"), F.avg("best").alias("best"), F.avg((F.col("chosen") == F.col("best")).cast("double")).alias("hits"))


def nested_array(df: DataFrame, column: str, path: str) -> Column:
    """The numbers of an array at a path of keys of a JSON text, null where there is none."""
    return F.from_json(nested(df, column, path), "array<double>")
