"""Patterns that are alike: an edge table that ever dearer measures refine, and what can be told of the pairs before they are made."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import redealt, stored
from .kernels import local_paths
from .sequences import islands


def copies(syms: Column) -> Column:
    """The symbols of an array with their number among equal ones, so that multisets become sets."""
    ordered = F.array_sort(syms)
    return F.transform(ordered, lambda x, i: F.struct(x.alias("sym"), (i - F.array_position(ordered, x)).cast("int").alias("copy")))


def length_pairs(patterns: DataFrame, key: str, least: float) -> DataFrame:
    """How many pairs of patterns (key, pattern, syms) are of such lengths that they may be alike: (key, pairs), from the histogram of lengths alone."""
    n = patterns.groupBy(key, F.size("syms").alias("n")).agg(F.count("*").alias("c"))
    a, b = n.toDF(key, "na", "ca"), n.toDF(key, "nb", "cb")
    x = a.join(b, key).where((F.col("na") <= F.col("nb")) & (F.col("na") >= least * F.col("nb") - 1e-9))
    return x.groupBy(key).agg(F.sum(F.when(F.col("na") == F.col("nb"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb"))).cast("long").alias("pairs"))


def candidates(patterns: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (key, a, b), a < b, of patterns (key, pattern, syms) among which are all that have `least` of the longer one's symbols in common as multisets.

    Symbols are ordered by how rare they are. Patterns that have so much in common share one of their first symbols, so many as could be missing and one more; so they meet on these alone. Lengths that are too far apart don't meet, and what is left after the shared place must be enough.
    """
    t = patterns.select(key, "pattern", F.size("syms").alias("n"), F.explode(copies(F.col("syms"))).alias("x")).select(key, "pattern", "n", "x.sym", "x.copy")
    rare = t.groupBy(key, "sym", "copy").agg(F.count("*").alias("f"))
    t = t.join(redealt(rare, key, "sym", "copy"), [key, "sym", "copy"])
    t = t.withColumn("at", F.row_number().over(Window.partitionBy(key, "pattern").orderBy("f", "sym", "copy")))
    need = lambda n: F.ceil(least * n - 1e-9)
    t = t.where(F.col("at") <= F.col("n") - need(F.col("n")) + 1)
    step = math.log(1 / least) if least < 1 else 1.0  # lengths in one class or in neighbouring ones may do
    t = stored(t.withColumn("size", F.floor(F.log("n") / F.lit(step) + 1e-9).cast("int")).select(key, "sym", "copy", "size", "pattern", "n", "at"), "prefixes")
    side = lambda d, s: d.select(key, "sym", "copy", "size", *(F.col(c).alias(c + s) for c in ("pattern", "n", "at")))
    wide = t.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))  # a meets the classes of its own length and the next
    a, b = side(wide, "_a"), side(t, "_b")
    x = a.join(b, [key, "sym", "copy", "size"]).where("n_a < n_b or (n_a = n_b and pattern_a < pattern_b)")
    x = x.where((F.col("n_a") >= need(F.col("n_b"))) & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1 >= need(F.col("n_b"))))
    return x.select(key, F.least("pattern_a", "pattern_b").alias("a"), F.greatest("pattern_a", "pattern_b").alias("b")).distinct()


def _with_both(pairs: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    for s in "ab":
        pairs = pairs.join(patterns.select(key, F.col("pattern").alias(s), F.col("syms").alias(f"syms_{s}")), [key, s])
    return pairs


def _share(common: Column) -> Column:
    return common / F.greatest(F.size("syms_a"), F.size("syms_b"))


def overlaps(patterns: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (key, a, b) of patterns (key, pattern, syms) with `overlap`, the size of what they have in common as multisets over the longer one's length, of at least `least` (above 0)."""
    x = _with_both(candidates(patterns, key, least), patterns, key)
    common = F.size(F.array_intersect(copies(F.col("syms_a")), copies(F.col("syms_b"))))
    return x.select(key, "a", "b", _share(common).alias("overlap")).where(F.col("overlap") >= least - 1e-9)


def aligned(pairs: DataFrame, patterns: DataFrame, key: str, least: float) -> DataFrame:
    """pairs with `alignment`, the length of their local alignment over the longer one's length, of at least `least`. An alignment has no more places than both have symbols in common, so pairs that overlaps() has left out would not be here either."""
    kept = [c for c in pairs.columns]
    x = _with_both(pairs, patterns, key)

    def run(frames):
        for f in frames:
            paths = local_paths([(list(a), list(b)) for a, b in zip(f["syms_a"], f["syms_b"])])
            f["alignment"] = [len(p) / max(len(a), len(b)) for p, a, b in zip(paths, f["syms_a"], f["syms_b"])]
            yield f.loc[f["alignment"] >= least - 1e-9, [*kept, "alignment"]]

    types = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
    return x.mapInPandas(run, f"{types}, alignment double")


def together(pairs: DataFrame, patterns: DataFrame, occurrences: DataFrame, key: str, least: float) -> DataFrame:
    """pairs with `together`, the longest run of positions that occurrences (pattern, seq_id, pos, the first position) of both cover over the longer one's length, of at least `least`."""
    n = patterns.select("pattern", F.size("syms").alias("n")).distinct()
    covered = occurrences.join(n, "pattern").select("pattern", "seq_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    asked = pairs.select("a", "b").distinct()
    both = asked.join(covered.withColumnRenamed("pattern", "a"), "a").join(covered.withColumnRenamed("pattern", "b"), ["b", "seq_id", "pos"])
    w = Window.partitionBy("a", "b", "seq_id").orderBy("pos")
    runs = islands(both, ["a", "b", "seq_id"], "pos", F.col("pos") - F.lag("pos").over(w) != 1).groupBy("a", "b", "seq_id", "grp").agg(F.count("*").alias("run"))
    longest = runs.groupBy("a", "b").agg(F.max("run").alias("run"))
    x = _with_both(pairs, patterns, key).join(longest, ["a", "b"])
    return x.select(*pairs.columns, _share(F.col("run")).alias("together")).where(F.col("together") >= least - 1e-9)


def cascade(patterns: DataFrame, key: str, least: float, occurrences: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of patterns (key, pattern, syms) that are alike by every measure, as edges (key, a, b, overlap, alignment and, with occurrences, together); and (step, ord, pairs), how many pairs each step has left: by their lengths, by rare symbols, by overlap, by alignment, by occurrences. Each step is a stored table that the next, dearer one refines; no step makes all pairs.

    A pattern counts once for a key. Rows with nulls and empty patterns are left out; other columns do not matter.
    """
    p = patterns.select(key, "pattern", "syms").where(F.col(key).isNotNull() & F.col("pattern").isNotNull() & (F.size("syms") > 0)).dropDuplicates([key, "pattern"])
    p = stored(p, "patterns")
    steps = [("lengths", length_pairs(p, key, least).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")))]
    x = stored(candidates(p, key, least), "candidates")
    steps.append(("rare symbols", x.agg(F.count("*").alias("pairs"))))
    both = _with_both(x, p, key)
    common = F.size(F.array_intersect(copies(F.col("syms_a")), copies(F.col("syms_b"))))
    x = stored(both.select(key, "a", "b", _share(common).alias("overlap")).where(F.col("overlap") >= least - 1e-9), "overlaps")
    steps.append(("overlap", x.agg(F.count("*").alias("pairs"))))
    x = stored(aligned(x, p, key, least), "alignments")
    steps.append(("alignment", x.agg(F.count("*").alias("pairs"))))
    if occurrences is not None:
        x = stored(together(x, p, occurrences, key, least), "together")
        steps.append(("occurrences", x.agg(F.count("*").alias("pairs"))))
    counts = None
    for k, (name, n) in enumerate(steps):
        one = n.select(F.lit(name).alias("step"), F.lit(k).alias("ord"), F.col("pairs").cast("long").alias("pairs"))
        counts = one if counts is None else counts.unionByName(one)
    return x, counts
