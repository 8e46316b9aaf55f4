"""Dictionaries of sections as relations: sections within sections, and repetitions written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dropped, redealt, stored


def _windows(syms: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(syms) - n + 1), lambda k: F.slice(syms, k, n))


def contained(sections: DataFrame, key: str) -> DataFrame:
    """Sections (key, section, syms) that are a stretch of a longer one of their key: (key, section), each once.

    An index has the hash and the length of every stretch of a length that sections have, so what is contained is found by an equi-join on key, length and hash; what joins is compared as a whole. Nulls and empty sections are left out.
    """
    s = sections.where(F.col(key).isNotNull() & (F.size("syms") > 0)).select(key, "section", "syms")
    lengths = s.groupBy(key).agg(F.collect_set(F.size("syms")).alias("lengths"))
    n = F.filter("lengths", lambda x: x < F.size("syms"))
    w = s.join(redealt(lengths, key), key).select(key, "syms", F.explode(n).alias("n"))
    w = w.select(key, "n", F.explode(F.array_distinct(_windows(F.col("syms"), F.col("n")))).alias("part")).distinct()
    w = w.select(F.col(key).alias("_key"), F.col("n").alias("_n"), F.xxhash64("part").alias("_h"), "part")
    s = s.withColumn("n", F.size("syms")).withColumn("h", F.xxhash64("syms"))
    here = (F.col(key) == F.col("_key")) & (F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h")) & (F.col("syms") == F.col("part"))
    return s.join(w, here, "left_semi").select(key, "section").distinct()


def uncontained(sections: DataFrame, key: str) -> DataFrame:
    """Sections without those that are a stretch of a longer one; of equal ones all stay."""
    return sections.join(contained(sections, key), [key, "section"], "left_anti")


def inlined(rules: DataFrame, key: str, rounds: int = 64) -> DataFrame:
    """Rules (key, parent, ord, child) with repetitions written out: a section whose parts are all the same, and which is a part of another, is replaced by its parts there, and goes; until there is none, at most `rounds` times, each a stored table. A section that is only made of such ones is one itself in a later round. ord is numbered anew from 0. A section that holds itself stays as it is."""
    now = stored(rules.select(key, "parent", "ord", "child"), "rules")
    for _ in range(rounds):
        same = now.groupBy(key, "parent").agg(F.count_distinct("child").alias("kinds"), F.min("child").alias("least")).where("kinds = 1 and least <> parent").select(key, "parent")
        used = now.where("child <> parent").select(key, F.col("child").alias("parent")).distinct()
        flat = stored(same.join(used, [key, "parent"], "left_semi"), "repetitions")
        # what stands in a repetition that goes itself is written out first
        outer = now.join(flat, [key, "parent"], "left_semi").select(key, F.col("child").alias("parent")).distinct()
        ready = flat.join(outer, [key, "parent"], "left_semi")
        ready = stored(ready if not ready.isEmpty() else flat, "ready")
        if ready.isEmpty():
            break
        parts = now.join(ready, [key, "parent"], "left_semi").groupBy(key, F.col("parent").alias("child")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]).alias("parts"))
        rest = now.join(ready, [key, "parent"], "left_anti")
        wide = rest.join(redealt(parts, key, "child"), [key, "child"], "left").select(key, "parent", "ord", F.posexplode(F.coalesce("parts", F.array("child"))).alias("k", "child"))
        order = (F.row_number().over(Window.partitionBy(key, "parent").orderBy("ord", "k")) - 1).cast("int")
        new = stored(wide.select(key, "parent", order.alias("ord"), "child"), "rules")
        dropped(now)
        now = new
    return now
