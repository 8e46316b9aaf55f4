"""Multi-level labelled segmentations (item, level, seg, start, end, label), coarse levels first, and measures of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .sequences import as_of, islands

SEGMENT = ["item", "level"]


def by_start(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("start")


def renumbered(h: DataFrame) -> DataFrame:
    return h.withColumn("seg", (F.row_number().over(by_start(*SEGMENT)) - 1).cast("int")).select("item", "level", "seg", "start", "end", "label")


def beatwise_labels(hier: DataFrame, grid: DataFrame, blank: str | int = -1) -> DataFrame:
    """For each level and time of a grid (item, pos, t) the label of the last segment that begins at or before it, `blank` before the first; ends do not matter: (item, level, pos, label)."""
    at = grid.join(hier.select("item", "level").distinct(), "item")
    starts = hier.select("item", "level", F.col("start").alias("t"), "label")
    return as_of(at, starts, "label", SEGMENT, default=blank).select("item", "level", "pos", "label")


def int_labels(h: DataFrame) -> DataFrame:
    """Labels by their rank among an item's, over all levels."""
    names = h.select("item", "label").distinct().withColumn("code", (F.row_number().over(Window.partitionBy("item").orderBy("label")) - 1).cast("int"))
    return h.join(names, ["item", "label"]).drop("label").withColumnRenamed("code", "label")


def make_monotonic(hier: DataFrame) -> DataFrame:
    """The hierarchy in which every boundary of a level is one of the next levels too: segments are cut at the boundaries of all coarser levels that lie inside. As a level's cuts are handed on, that is a cut at the boundaries of every level above. The boundaries meet the segments by item; an as-of walk over both finds, for each piece, the segment that it is of."""
    levels = hier.select("item", "level").distinct()
    cuts = hier.select("item", F.col("level").alias("of"), F.col("start").alias("t"))
    span = hier.groupBy("item", "level").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    # a level's own starts, and those of coarser levels within its span
    down = cuts.join(levels, "item").where("of <= level").select("item", "level", "t").distinct().join(span, SEGMENT).where("t >= a and t < b")
    own = hier.select("item", "level", F.col("start").alias("t"), F.struct("start", "end", "label").alias("s"))
    x = as_of(down.select("item", "level", "t", "b"), own, "s", SEGMENT)
    w = Window.partitionBy(*SEGMENT).orderBy("t")
    x = x.where("s.end > t").withColumn("next", F.lead("t").over(w))
    pieces = x.select("item", "level", F.col("t").alias("start"), F.least(F.col("s.end"), F.coalesce("next", F.col("s.end"))).alias("end"), F.col("s.label").alias("label"))
    return renumbered(pieces)


def monotonicity(hier: DataFrame) -> DataFrame:
    """Whether every boundary of a level is one of the next: (item, monotonic). Boundaries are starts and the last end."""
    b = hier.select("item", "level", F.col("start").alias("t")).unionByName(hier.select("item", "level", F.col("end").alias("t"))).distinct()
    last = hier.groupBy("item").agg(F.max("level").alias("deepest"))
    lost = b.join(last, "item").where("level < deepest").join(b.select("item", (F.col("level") - 1).alias("level"), "t"), ["item", "level", "t"], "left_anti")
    bad = lost.select("item").distinct().withColumn("bad", F.lit(True))
    return last.join(bad, "item", "left").select("item", F.col("bad").isNull().alias("monotonic"))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_recall(lab: DataFrame) -> DataFrame:
    """The mean over neighbouring levels of the share of pairs of positions with one label that have one label in the level above too: (item, recall). Pairs are counted from group sizes. Null if a level has no such pair."""
    up = lab.select("item", (F.col("level") + 1).alias("level"), "pos", F.col("label").alias("above"))
    x = lab.join(up, ["item", "level", "pos"])
    both = x.groupBy("item", "level", "label", "above").agg(F.count("*").alias("n"))
    g = both.groupBy("item", "level", "label").agg(F.sum(pairs_of(F.col("n"))).alias("same"), F.sum("n").alias("n"))
    r = g.groupBy("item", "level").agg(F.sum("same").alias("same"), F.sum(pairs_of(F.col("n"))).alias("all"))
    r = r.withColumn("r", F.try_divide("same", F.col("all")))
    return r.groupBy("item").agg(F.when(F.count("r") == F.count("*"), F.avg("r")).alias("recall"))


def interval_monotonicity(hier: DataFrame, grid: DataFrame) -> DataFrame:
    """pairwise_recall with every segment a label of its own."""
    own = hier.withColumn("label", F.col("seg").cast("int"))
    return pairwise_recall(beatwise_labels(own, grid, -1))


def children(hier: DataFrame) -> DataFrame:
    """For each segment (item, level, seg, label) of a monotonic hierarchy, its parts on the next level as text: the labels in order, by "|"."""
    up = hier.select("item", (F.col("level") + 1).alias("level"), F.col("start").alias("t"), F.struct("seg", "label").alias("parent"))
    x = as_of(hier.select("item", "level", F.col("start").alias("t"), "label"), up, "parent", SEGMENT).where("parent is not null")
    g = x.groupBy("item", "level", F.col("parent.seg").alias("seg"), F.col("parent.label").alias("label")).agg(F.array_sort(F.collect_list(F.struct("t", F.col("label").alias("l")))).alias("c"))
    return g.select("item", (F.col("level") - 1).alias("level"), "seg", "label", F.concat_ws("|", F.transform("c", lambda s: s["l"].cast("string"))).alias("parts"))


def transitivity_strict(hier: DataFrame) -> DataFrame:
    """How far one label has the same parts: the mean over an item's labels (by level) of the share of pairs of segments whose parts are identical; a label with one segment counts 1, segments whose only part is of their own label are left out: (item, transitivity)."""
    c = children(hier).where(F.col("parts") != F.col("label").cast("string"))
    k = c.groupBy("item", "level", "label", "parts").agg(F.count("*").alias("n"))
    g = k.groupBy("item", "level", "label").agg(F.sum(pairs_of(F.col("n"))).alias("same"), F.sum("n").alias("n"))
    share = F.when(F.col("n") == 1, 1.0).otherwise(F.try_divide(F.col("same"), pairs_of(F.col("n"))))
    return g.groupBy("item").agg(F.avg(share).alias("transitivity"))


def repetitiveness(hier: DataFrame) -> DataFrame:
    """The mean over levels of the share of segments whose label was there already, of those but the first; 1 for one segment."""
    g = hier.groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.count_distinct("label").alias("u"))
    return g.groupBy("item").agg(F.avg(F.coalesce(F.try_divide(F.col("n") - F.col("u"), F.col("n") - 1), F.lit(1.0))).alias("repetitiveness"))


def complexity(hier: DataFrame) -> DataFrame:
    """The mean number of segments of a level."""
    return hier.groupBy("item").agg((F.count("*") / F.count_distinct("level")).alias("complexity"))


def simplicity(hier: DataFrame) -> DataFrame:
    """The mean duration of segments over the item's whole length."""
    return hier.groupBy("item").agg(F.try_divide(F.avg(F.col("end") - F.col("start")), F.max("end") - F.min("start")).alias("simplicity"))


def treeness(hier: DataFrame) -> DataFrame:
    """The number of segments over that of the monotonic hierarchy."""
    a = hier.groupBy("item").agg(F.count("*").alias("n"))
    b = make_monotonic(hier).groupBy("item").agg(F.count("*").alias("m"))
    return a.join(b, "item").select("item", (F.col("n") / F.col("m")).alias("treeness"))


def salience(hier: DataFrame, size: int = 2) -> DataFrame:
    """The mean step, from level to level, of the entropy (bits) of the labels' n-grams: (item, salience). A level shorter than the n-gram has the one of all its labels."""
    w = by_start(*SEGMENT)
    n = F.count("*").over(Window.partitionBy(*SEGMENT))
    gram = F.concat_ws("|", *[F.lead("label", k).over(w) for k in range(size)])
    x = hier.select("item", "level", gram.alias("gram"), F.lead("label", size - 1).over(w).alias("full"), n.alias("n"), F.row_number().over(w).alias("k"))
    x = x.where((F.col("full").isNotNull()) | ((F.col("n") < size) & (F.col("k") == 1)))
    c = x.groupBy(*SEGMENT, "gram").agg(F.count("*").alias("c"))
    e = c.groupBy(*SEGMENT).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("e"))
    step = F.col("e") - F.lag("e").over(Window.partitionBy("item").orderBy("level"))
    return e.select("item", step.alias("step")).groupBy("item").agg(F.avg("step").alias("salience"))


def adjust_start_end(hier: DataFrame, target: DataFrame, blank: str = "-1") -> DataFrame:
    """Levels that last from 0 to the target (item, target): what is missing at either side is a segment labelled blank, what is beyond is cut."""
    w = by_start(*SEGMENT)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # what a level lacks goes out with its first segment, so a level is gone through once
    h = hier.join(target, "item").select("item", "level", "start", "end", "label", "target", F.min("start").over(whole).alias("a"), F.max("end").over(whole).alias("b"), F.row_number().over(w).alias("k"))
    piece = lambda when, start, end, label: F.when(when, F.struct(start.alias("start"), end.alias("end"), label.alias("label")))
    own = piece(F.col("start") < F.col("target"), F.col("start"), F.least("end", "target"), F.col("label"))
    head = piece((F.col("k") == 1) & (F.col("a") > 0), F.lit(0.0), F.least("a", "target"), F.lit(blank))
    tail = piece((F.col("k") == 1) & (F.col("b") < F.col("target")), F.col("b"), F.col("target"), F.lit(blank))
    return renumbered(h.select("item", "level", F.explode(F.array_compact(F.array(own, head, tail))).alias("s")).select("item", "level", "s.*"))


def simplify(hier: DataFrame) -> DataFrame:
    """Adjacent segments with one label are one."""
    g = islands(hier, SEGMENT, "start", F.col("label") != F.lag("label").over(by_start(*SEGMENT)))
    return renumbered(g.groupBy(*SEGMENT, "grp").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")))


def remove_label(hier: DataFrame, label: str = "Silence") -> DataFrame:
    return hier.where(F.col("label") != label)


def add_top_level(hier: DataFrame, label: str = "S") -> DataFrame:
    """Items whose first level has several segments get one above that spans all; levels count from 0 again."""
    top = hier.groupBy("item").agg(F.min("level").alias("first")).join(hier, "item").where("level = first").groupBy("item").agg(F.count("*").alias("n")).where("n > 1").select("item")
    whole = hier.join(top, "item", "left_semi").groupBy("item").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    added = whole.select("item", F.lit(0).alias("level"), F.lit(0).alias("seg"), "start", "end", F.lit(label).alias("label"))
    more = hier.join(top.withColumn("more", F.lit(1)), "item", "left").withColumn("level", F.col("level") + F.coalesce("more", F.lit(0))).drop("more")
    return added.unionByName(more.select(*added.columns))


def meets(lab: DataFrame) -> DataFrame:
    """For positions i < j of an item the deepest level on which they have one label: (item, i, j, meet); pairs without one are left out, and so are those whose deepest is 0, which counts like none."""
    x = lab.where("level > 0")
    a = x.select("item", "level", "label", F.col("pos").alias("i"))
    b = x.select("item", "level", "label", F.col("pos").alias("j"))
    return a.join(b, ["item", "level", "label"]).where("i < j").groupBy("item", "i", "j").agg(F.max("level").alias("meet"))


def meet_triples(lab: DataFrame) -> DataFrame:
    """Triples (item, i, j, k): i meets j more deeply than k, for k other than i; only pairs i < j meet, all others count 0."""
    m = meets(lab)
    pos = lab.select("item", F.col("pos").alias("k")).distinct()
    x = m.join(pos, "item").where("k != i")
    other = m.select("item", "i", F.col("j").alias("k"), F.col("meet").alias("other"))
    return x.join(other, ["item", "i", "k"], "left").where(F.col("meet") > F.coalesce("other", F.lit(0))).select("item", "i", "j", "k")


def meet_counts(lab: DataFrame) -> DataFrame:
    """How many meet triples begin with each pair: (item, i, j, n). For a position, those it meets are counted by depth; a pair has the others of its position that are less deep."""
    m = meets(lab)
    g = m.groupBy("item", "i", "meet").agg(F.count("*").alias("c"))
    size = lab.select("item", "pos").distinct().groupBy("item").agg(F.count("*").alias("all"))
    deeper = F.sum("c").over(Window.partitionBy("item", "i").orderBy(F.desc("meet")))
    less = g.withColumn("deeper", deeper).join(size, "item").select("item", "i", "meet", (F.col("all") - 1 - F.col("deeper")).alias("n"))
    return m.join(less, ["item", "i", "meet"]).where("n > 0").select("item", "i", "j", "n")


def lmeasure(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """Precision, recall and their harmonic mean of an estimate's triples (meet_triples): (item, p, r, l); zeros where they have none in common.

    Triples are counted, not made: for a position i, the others are summed up by how deeply they meet it in either table; a triple of both is one of a group and one of those that are less deep in both. So the work is that of the pairs, not of the triples."""
    keys = ["item", "i", "j"]
    x = meets(reference).withColumnRenamed("meet", "a").join(meets(estimate).withColumnRenamed("meet", "b"), keys, "full").na.fill(0, ["a", "b"])
    g = x.groupBy("item", "i", "a", "b").agg(F.count("*").alias("n"))
    size = reference.select("item", "pos").unionByName(estimate.select("item", "pos")).distinct().groupBy("item").agg(F.count("*").alias("all"))
    # the others of a position that it meets in neither table
    rest = g.groupBy("item", "i").agg(F.sum("n").alias("met")).join(size, "item").select("item", "i", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("all") - 1 - F.col("met")).alias("n"))
    g = g.unionByName(rest)
    o = g.select("item", "i", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    pairs = g.join(o, ["item", "i"])
    product = F.col("n") * F.col("n2")
    count = lambda hit: F.sum(F.when(hit, product).otherwise(0))
    deeper, too = F.col("a") > F.col("a2"), F.col("b") > F.col("b2")
    n = pairs.groupBy("item").agg(count(deeper).alias("na"), count(too).alias("nb"), count(deeper & too).alias("both"))
    x = reference.select("item").distinct().join(n, "item", "left").na.fill(0, ["na", "nb", "both"])
    p, r = F.coalesce(F.try_divide(F.col("both"), F.col("nb")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("both"), F.col("na")), F.lit(0.0))
    return x.select("item", p.alias("p"), r.alias("r"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("l"))


def label_overlap(lab: DataFrame) -> DataFrame:
    """How many positions a label has in common with one of the level above: (item, level, label, above, n)."""
    up = lab.select("item", (F.col("level") + 1).alias("level"), "pos", F.col("label").alias("above"))
    return lab.join(up, ["item", "level", "pos"]).groupBy("item", "level", "label", "above").agg(F.count("*").alias("n"))


def content_labels(lab: DataFrame) -> DataFrame:
    """Labels by content: on levels above the last one, the rank from 0 of the mean label of the last level at the label's positions; (item, level, pos, label)."""
    last = lab.groupBy("item").agg(F.max("level").alias("last"))
    x = lab.join(last, "item")
    bottom = x.where("level = last").select("item", "pos", F.col("label").alias("bottom"))
    mean = x.where("level < last").join(bottom, ["item", "pos"]).groupBy("item", "level", "label").agg(F.round(F.avg("bottom"), 9).alias("m"))
    rank = mean.withColumn("new", (F.dense_rank().over(Window.partitionBy("item", "level").orderBy("m")) - 1).cast("int"))
    return x.where("level < last").join(rank, ["item", "level", "label"]).select("item", "level", "pos", F.col("new").alias("label")).unionByName(x.where("level = last").select("item", "level", "pos", F.col("label").cast("int").alias("label")))


def auto_labeled(hier: DataFrame) -> DataFrame:
    """Whether of an item's first two levels just one has no label twice, adjacent equal ones counted once: (item, auto)."""
    w = by_start(*SEGMENT)
    h = hier.where("level < 2").withColumn("new", F.coalesce((F.col("label") != F.lag("label").over(w)).cast("int"), F.lit(1)))
    g = h.groupBy(*SEGMENT).agg((F.count_distinct("label") == F.sum("new")).alias("alone"))
    at = lambda k: F.coalesce(F.max(F.when(F.col("level") == k, F.col("alone").cast("int"))), F.lit(0))
    return g.groupBy("item").agg((at(0) != at(1)).alias("auto"))


def description_length(hier: DataFrame) -> DataFrame:
    """The summed lengths of the distinct rules (a segment's label on its level, and its parts) of a monotonic hierarchy over the number of its segments: (item, dlength)."""
    rules = children(hier).select("item", "level", "label", "parts").distinct()
    size = rules.groupBy("item").agg(F.sum(F.size(F.split("parts", "\\|"))).alias("size"))
    return hier.groupBy("item").agg(F.count("*").alias("n")).join(size, "item").select("item", (F.col("size") / F.col("n")).alias("dlength"))


def homogenized(hier: DataFrame, signs: str = "'") -> DataFrame:
    """Labels without the signs that tell variants of a section apart."""
    return hier.withColumn("label", F.translate("label", signs, ""))


def _by_parent(lab: DataFrame) -> DataFrame:
    """How many positions of a level have a label and, on the level above, another: (item, level, label, above, n)."""
    return label_overlap(lab)


def label_monotonicity_alone(lab: DataFrame) -> DataFrame:
    """The mean over levels of the share of pairs of positions with one label whose labels above are one label, or one of which is the label itself: (item, recall). Counted from group sizes; null if a level has no such pair."""
    x = _by_parent(lab)
    own = F.sum(F.when(F.col("above") == F.col("label"), F.col("n")).otherwise(0))
    g = x.groupBy("item", "level", "label").agg(F.sum(pairs_of(F.col("n"))).alias("same"), own.alias("own"), F.sum("n").alias("n"))
    r = g.groupBy("item", "level").agg(F.sum(F.col("same") + F.col("own") * (F.col("n") - F.col("own"))).alias("fine"), F.sum(pairs_of(F.col("n"))).alias("all"))
    r = r.withColumn("r", F.try_divide("fine", F.col("all")))
    return r.groupBy("item").agg(F.when(F.count("r") == F.count("*"), F.avg("r")).alias("recall"))


def label_monotonicity_of_all(lab: DataFrame) -> DataFrame:
    """The mean over levels of the share of all pairs of positions that have different labels, or one label above: (item, recall). Null for fewer than two positions."""
    x = _by_parent(lab)
    g = x.groupBy("item", "level", "label").agg(F.sum(pairs_of(F.col("n"))).alias("same"), F.sum("n").alias("n"))
    r = g.groupBy("item", "level").agg(F.sum("same").alias("same"), F.sum(pairs_of(F.col("n"))).alias("alike"), F.sum("n").alias("n"))
    every = pairs_of(F.col("n"))
    return r.groupBy("item").agg(F.avg(F.try_divide(every - F.col("alike") + F.col("same"), every)).alias("recall"))


def transitivity_of_all(hier: DataFrame) -> DataFrame:
    """Of all pairs of segments with parts, on all levels of an item, the share that has different labels (or levels) or identical parts; 1 if no label is there twice: (item, transitivity)."""
    k = children(hier).groupBy("item", "level", "label", "parts").agg(F.count("*").alias("n"))
    g = k.groupBy("item", "level", "label").agg(F.sum(pairs_of(F.col("n"))).alias("same"), F.sum("n").alias("n"))
    x = g.groupBy("item").agg(F.sum("same").alias("same"), F.sum(pairs_of(F.col("n"))).alias("alike"), F.sum("n").alias("n"))
    every = pairs_of(F.col("n"))
    return x.select("item", F.when(F.col("alike") == 0, 1.0).otherwise((every - F.col("alike") + F.col("same")) / every).alias("transitivity"))


def transitivity_of_order(hier: DataFrame, delta: int = 1) -> DataFrame:
    """transitivity_strict with parts that count as alike if their local alignment is at most delta shorter than the longer one. Parts of a label that are the same are one row with their number, so that each pair of different ones is aligned once."""
    import pandas as pd

    from .kernels import smith_waterman

    c = children(hier).where(F.col("parts") != F.col("label").cast("string"))
    k = c.groupBy("item", "level", "label", "parts").agg(F.count("*").alias("n")).groupBy("item", "level", "label").agg(F.array_sort(F.collect_list(F.struct("parts", "n"))).alias("all"))

    def share(rows) -> float:
        parts, n = [r["parts"].split("|") for r in rows], [int(r["n"]) for r in rows]
        total = sum(n)
        if total == 1:
            return 1.0
        alike = sum(x * (x - 1) / 2 for x in n)
        for a in range(len(parts)):
            for b in range(a):
                if len(smith_waterman(parts[a], parts[b])) >= max(len(parts[a]), len(parts[b])) - delta:
                    alike += n[a] * n[b]
        return alike / (total * (total - 1) / 2)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"item": f["item"], "share": [share(rows) for rows in f["all"]]})

    return k.mapInPandas(run, f"item {hier.schema['item'].dataType.simpleString()}, share double").groupBy("item").agg(F.avg("share").alias("transitivity"))


def label_trees(hier: DataFrame, top: str = "S") -> DataFrame:
    """Each item's monotonic hierarchy as a text, "(label part part ...)", with the number of its nodes: (item, tree, size). A segment with one part is that part; an item with several segments on its first level has a node above them. Levels are joined from the finest up."""
    levels = sorted(r.level for r in hier.select("level").distinct().collect())  # a handful
    parts = None
    for level in reversed(levels):
        own = hier.where(F.col("level") == level).select("item", "start", "label")
        if parts is None:
            parts = own.select("item", "start", F.col("label").cast("string").alias("tree"), F.lit(1).cast("long").alias("size"))
            continue
        at = as_of(parts.select("item", F.col("start").alias("t"), "tree", "size"), own.select("item", F.col("start").alias("t"), F.struct("start", "label").alias("parent")), "parent", ["item"])
        parts = _above(at.where("parent is not null"), [F.col("parent.start").alias("start"), F.col("parent.label").alias("label")])
    if parts is None:
        return hier.select("item", F.lit("").alias("tree"), F.lit(0).cast("long").alias("size")).limit(0)
    return _above(parts.withColumnRenamed("start", "t"), [F.lit(0).alias("start"), F.lit(top).alias("label")]).select("item", "tree", "size")


def _above(parts: DataFrame, parent: list[Column]) -> DataFrame:
    g = parts.groupBy("item", *parent).agg(F.array_sort(F.collect_list(F.struct("t", "tree"))).alias("c"), F.sum("size").alias("size"))
    text = F.concat_ws(" ", F.transform("c", lambda s: s["tree"]))
    one = F.size("c") == 1
    return g.select("item", "start", F.when(one, text).otherwise(F.concat(F.lit("("), F.col("label").cast("string"), F.lit(" "), text, F.lit(")"))).alias("tree"), F.when(one, F.col("size")).otherwise(F.col("size") + 1).alias("size"))


def relative_triples(lab: DataFrame) -> DataFrame:
    """How many of an item's meet triples have the same distances from their first position: (item, dj, dk, n)."""
    return meet_triples(lab).groupBy("item", (F.col("j") - F.col("i")).alias("dj"), (F.col("k") - F.col("i")).alias("dk")).agg(F.count("*").alias("n"))


def summary(measures: dict[str, DataFrame]) -> DataFrame:
    """For each named measure (item, value): how many values there are, how many are 1, and their median, mean and least: (measure, n, ones, median, mean, least)."""
    u = None
    for name, m in measures.items():
        one = m.select(F.lit(name).alias("measure"), F.col(m.columns[1]).alias("value"))
        u = one if u is None else u.unionByName(one)
    return u.groupBy("measure").agg(F.count("value").alias("n"), F.sum((F.col("value") == 1).cast("long")).alias("ones"), F.percentile("value", 0.5).alias("median"), F.avg("value").alias("mean"), F.min("value").alias("least"))


def aligned_lmeasure(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """lmeasure of label tables (item, level, pos, label) of any lengths: positions are matched by the local alignment of both finest levels, and only matched ones count, numbered in order: (item, p, r, l)."""
    import pandas as pd

    from .kernels import local_paths

    def finest(lab: DataFrame, name: str) -> DataFrame:
        last = lab.groupBy("item").agg(F.max("level").alias("level"))
        return lab.join(last, ["item", "level"]).groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias(name))

    both = finest(reference, "x").join(finest(estimate, "y"), "item")

    def run(frames):
        for f in frames:
            paths = local_paths([(list(x), list(y)) for x, y in zip(f["x"], f["y"])])
            rows = [(item, k, i, j) for item, path in zip(f["item"], paths) for k, (i, j) in enumerate(path)]
            yield pd.DataFrame(rows, columns=["item", "new", "i", "j"])

    m = stored(both.mapInPandas(run, f"item {reference.schema['item'].dataType.simpleString()}, new int, i int, j int"), "matches")
    take = lambda lab, c: lab.join(m.select("item", "new", F.col(c).alias("pos")), ["item", "pos"]).select("item", "level", F.col("new").alias("pos"), "label")
    return lmeasure(take(reference, "i"), take(estimate, "j"))
