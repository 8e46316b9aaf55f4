"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Buckets that the order of a source's documents is cut into. Only the one bucket in which the target falls is put in order.
BUCKETS = 4096


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Targets for (source, source_size): weights repeat over the sources by code point, null last. `share` of all sizes is dealt by weight; a source stops at `max_epochs` times its size, and what is over goes to the others by weight until none is above.

    The fixpoint is found in closed form. With the sources in order of cap over weight, the first k are at their caps for the smallest k at which the level, (budget - their caps) / weight of the others, is at most the next one's cap over weight; the others get level times weight. If all caps together are below the budget, all are at their caps. The table has a row for each source, so ordering it in one task is bounded by the number of sources.

    An empty table gives none; a source of size zero gets zero.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    up_to = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = F.lit(float(weights[-1]))
    for k in range(len(weights) - 1):
        w = F.when(F.col("place") % len(weights) == k, float(weights[k])).otherwise(w)
    t = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / F.sum("weight").over(from_here))
        # the level is at most the ratio from the first source on that is not at its cap
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything))
    )
    capped = F.col("free").isNull() | (F.struct("ratio", "place") < F.struct("free.ratio", "free.place"))
    return t.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def draw_key(seed: int) -> Column:
    """Where a document stands in the seeded order: 32 hex digits of MD5, so that SQL elsewhere can give the same order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 17) -> DataFrame:
    """The words that the mix takes of each document: doc_id, source, size, source_size, target, taken.

    Each document is repeated floor(target / source_size) times whole. What is left of the target goes once more to documents in a seeded order (MD5 of seed and doc_id): those before the point where it is used up are taken again whole, the document at that point in part, those after it not. So a source's taken words are its target, rounded down, and no document exceeds max_epochs times its size.

    A source is never sorted as a whole: its words are summed in 4,096 buckets of the order, and only documents of the bucket that holds the point are ordered.

    A null or empty text has size 0 and is taken 0 words; null sources form a source of their own, null doc_ids stand at one place of the order. Documents of one place share it by size: repeated rows with the same size are alike, so any order of them gives the same rows. An empty table gives none. Other columns do not matter.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("draw", draw_key(seed))
    d = stored(d.withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")), "sizes")  # the texts are read once
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    targets = water_fill(d.groupBy("source").agg(F.sum("size").alias("source_size")), share, max_epochs, weights)
    targets = targets.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0))).withColumn(
        "rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # one row for each source and bucket: bounded by 4,096 times the sources, however many documents there are
    plan = sums.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("plan_source"), F.col("b.bucket").alias("plan_bucket"), "source_size", "target", "whole", "rest", "ahead",
        ((F.col("ahead") <= F.col("rest")) & (F.col("rest") < F.col("ahead") + F.col("bucket_size"))).alias("cut"),
    )
    all_rows = d.join(plan, d.source.eqNullSafe(F.col("plan_source")) & (F.col("bucket") == F.col("plan_bucket")))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = all_rows.where("cut").withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = all_rows.where("not cut").unionByName(cut)
    again = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + again).cast("long").alias("taken"))
