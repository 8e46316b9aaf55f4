"""Sets (key, id, x): a row for each element; and groups of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components


def distinct_sets(sets: DataFrame, key: str) -> DataFrame:
    """Each set once, with how many have its elements: (key, id, size, n, x), id the least of those that are alike."""
    g = sets.dropDuplicates([key, "id", "x"]).groupBy(key, "id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    u = g.groupBy(key, "xs").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return u.select(key, "id", F.size("xs").alias("size"), "n", F.explode("xs").alias("x"))


def containments(sets: DataFrame, key: str) -> DataFrame:
    """Which distinct sets lie within which larger ones: (key, inner, n, outer). Sets meet on elements, and the inner one lies within if it meets the outer on all of its own."""
    d = distinct_sets(sets, key)
    a = d.select(key, F.col("id").alias("inner"), F.col("size").alias("a"), "n", "x")
    b = d.select(key, F.col("id").alias("outer"), F.col("size").alias("b"), "x")
    m = a.join(b, [key, "x"]).where("a < b").groupBy(key, "inner", "a", "n", "outer").agg(F.count("*").alias("common"))
    return m.where("common = a").select(key, "inner", "n", "outer")


def maximal_sets(sets: DataFrame, key: str) -> DataFrame:
    """Sets that no larger one holds, each once, with their rating: how many sets are alike to it or within it: (key, id, size, rating)."""
    c = containments(sets, key)
    own = distinct_sets(sets, key).select(key, "id", "size", "n").distinct()
    top = own.join(c.select(key, F.col("inner").alias("id")).distinct(), [key, "id"], "left_anti")
    more = c.groupBy(key, F.col("outer").alias("id")).agg(F.sum("n").alias("more"))
    return top.join(more, [key, "id"], "left").select(key, "id", "size", (F.col("n") + F.coalesce("more", F.lit(0))).alias("rating"))


def groups_by_similarity(pairs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Items (id) in groups that steps between pairs (a, b, similarity) of at least `least` lead to: (id, grp), grp the smallest id."""
    c = components(pairs.where(F.col("similarity") >= least).select(F.col("a").alias("u"), F.col("b").alias("v")))
    return items.join(c, items.id == c.node, "left").select("id", F.coalesce("root", "id").alias("grp"))


def largest_groups(groups: DataFrame, count: int, size: str) -> DataFrame:
    """The `count` groups (grp, ...) with the greatest sum of a column, ties to the smaller group: (grp, total). A report."""
    t = groups.groupBy("grp").agg(F.sum(size).alias("total"))
    return t.orderBy(F.desc("total"), "grp").limit(count)


def longest_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """For two patterns' positions (key, id, len, pos): the longest run of positions that both have, over the longer one's length: (key, a, b, similarity), for pairs with a < b that have any."""
    x = a.select(key, F.col("id").alias("a"), F.col("len").alias("la"), "pos").join(b.select(key, F.col("id").alias("b"), F.col("len").alias("lb"), "pos"), [key, "pos"]).where("a < b")
    w = Window.partitionBy(key, "a", "b").orderBy("pos")
    r = x.withColumn("grp", F.col("pos") - F.row_number().over(w)).groupBy(key, "a", "b", "la", "lb", "grp").agg(F.count("*").alias("n"))
    return r.groupBy(key, "a", "b", "la", "lb").agg(F.max("n").alias("n")).select(key, "a", "b", (F.col("n") / F.greatest("la", "lb")).alias("similarity"))


def nearest_distances(points: DataFrame, key: str) -> DataFrame:
    """For components' points (key, comp, seq_id, pos): how far apart two components are in most sequences: the mode over sequences, the smaller of equals, of the least distance there: (key, c, d, dist), c < d. Distances are to neighbours in order of position, so no sequence is squared."""
    comps = points.select(key, "seq_id", F.col("comp").alias("d")).distinct()
    w = Window.partitionBy(key, "seq_id", "d").orderBy("pos")
    # every point once for each component of its sequence; then the last and next point of that component
    x = points.join(comps, [key, "seq_id"]).withColumn("own", F.when(F.col("comp") == F.col("d"), F.col("pos")))
    before = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("own", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = x.withColumn("near", F.least(F.col("pos") - before, after - F.col("pos"))).where("comp < d and near is not null")
    least = x.groupBy(key, F.col("comp").alias("c"), "d", "seq_id").agg(F.min("near").alias("dist"))
    n = least.groupBy(key, "c", "d", "dist").agg(F.count("*").alias("n"))
    return n.groupBy(key, "c", "d").agg(F.min(F.struct((-F.col("n")).alias("n"), "dist"))["dist"].alias("dist"))


def sequence_probability(seq: DataFrame, form: DataFrame, start: int = -2, end: int = -1) -> DataFrame:
    """The probability of each sequence under a form's transitions (src, dst, p), as a logarithm, and over the greatest of all: (seq_id, logp, share). The form has a row for each pair of symbols."""
    s = seq.where("sym >= 0")
    w = Window.partitionBy("seq_id").orderBy("pos")
    steps = s.select("seq_id", F.lag("sym", 1, start).over(w).alias("src"), F.col("sym").alias("dst"))
    last = s.groupBy("seq_id").agg(F.max_by("sym", "pos").alias("src")).select("seq_id", "src", F.lit(end).alias("dst"))
    p = steps.unionByName(last).join(form, ["src", "dst"]).groupBy("seq_id").agg(F.sum(F.log("p")).alias("logp"))
    top = p.agg(F.max("logp").alias("top"))
    return p.crossJoin(F.broadcast(top)).select("seq_id", "logp", F.exp(F.col("logp") - F.col("top")).alias("share"))
