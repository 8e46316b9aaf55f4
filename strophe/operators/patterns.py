"""Patterns with translations, sections, and measures that look beyond single cells of a matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrices import diag_segments, segment_cells
from .sequences import islands, overlap_join


def sliding_means(seq: DataFrame, low: int, high: int, value: str = "value") -> DataFrame:
    """Means of all windows of low to high values: (seq_id, pos, len, mean), pos where a window begins."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    parts = [F.struct(F.lit(n).alias("len"), F.avg(value).over(w.rowsBetween(0, n - 1)).alias("mean"), F.count("*").over(w.rowsBetween(0, n - 1)).alias("n")) for n in range(low, high + 1)]
    x = seq.select("seq_id", "pos", F.array(*parts).alias("all")).select("seq_id", "pos", F.explode("all").alias("x"))
    return x.where("x.n = x.len").select("seq_id", "pos", "x.len", "x.mean")


def fill_gaps(seq: DataFrame, size: int, ratio: float, value: str = "value") -> DataFrame:
    """A 0-1 sequence with those inner runs of zeros set to one that are at most `size` long and at most `ratio` of themselves and both runs beside them."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    g = islands(seq, ["seq_id"], "pos", F.col(value) != F.lag(value).over(w))
    n = g.groupBy("seq_id", "grp").agg(F.count("*").alias("n"))
    v = Window.partitionBy("seq_id").orderBy("grp")
    n = n.withColumn("a", F.lag("n").over(v)).withColumn("b", F.lead("n").over(v))
    full = (F.col("n") <= size) & (F.col("n") / (F.col("a") + F.col("n") + F.col("b")) <= ratio)
    return g.join(n.withColumn("full", F.coalesce(full, F.lit(False))), ["seq_id", "grp"]).select("seq_id", "pos", F.when((F.col(value) == 0) & F.col("full"), 1).otherwise(F.col(value)).alias(value))


def diagonal_ratings(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    """For each block of size by size cells (keys, i, j, at its upper left) of a full matrix: the mean of its diagonal over the mean of its other cells, 0 where that is 0. Sums of blocks come from frames along rows and then columns."""
    frame = lambda by, order: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(0, size - 1)
    c = cells.withColumn("d", F.col("j") - F.col("i"))
    c = c.withColumn("row", F.sum("v").over(frame(["i"], "j"))).withColumn("nr", F.count("*").over(frame(["i"], "j")))
    c = c.withColumn("block", F.sum("row").over(frame(["j"], "i"))).withColumn("nc", F.count("*").over(frame(["j"], "i")))
    c = c.withColumn("dia", F.sum("v").over(frame(["d"], "i"))).where((F.col("nr") == size) & (F.col("nc") == size))
    rest = F.round((F.col("block") - F.col("dia")) / (size * size - size), 9)
    return c.select(*keys, "i", "j", F.when(rest == 0, 0.0).otherwise(F.try_divide(F.col("dia") / size, rest)).alias("rating"))


def entropy_fusion(cells: DataFrame, keys: list[str], size: int = 10, resolution: int = 10) -> DataFrame:
    """A full matrix times the mean entropy (bits) of the windows of size by size cells around: values are quantised to `resolution` steps of the greatest (half to even, negative ones to 0), and windows beyond the edges count as the nearest ones."""
    top = cells.groupBy(*keys).agg(F.max("v").alias("top"), (F.max("i") + 1).alias("n"))
    q = cells.join(top, keys).select(*keys, "n", "i", "j", F.bround(F.greatest(F.lit(0.0), F.col("v")) / F.col("top") * resolution).cast("int").alias("q"))
    span = lambda x: F.sequence(F.greatest(F.lit(0), F.col(x) - size + 1), F.least(F.col(x), F.col("n") - size))
    win = q.where(F.col("n") >= size).select(*keys, "n", "q", "j", F.explode(span("i")).alias("a")).select(*keys, "n", "q", "a", F.explode(span("j")).alias("b"))
    c = win.groupBy(*keys, "n", "a", "b", "q").agg(F.count("*").alias("c"))
    e = c.groupBy(*keys, "n", "a", "b").agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("e"))
    k = F.sequence(F.lit(0), F.lit(size - 1))
    clamp = lambda x, y: F.least(F.greatest(F.col(x) + F.col(y) - (size - 1), F.lit(0)), F.col("n") - size)
    at = q.where(F.col("n") >= size).select(*keys, "n", "i", "j", F.explode(k).alias("x")).select(*keys, "n", "i", "j", "x", F.explode(k).alias("y"))
    at = at.select(*keys, "i", "j", clamp("i", "x").alias("a"), clamp("j", "y").alias("b"))
    mean = at.join(e.drop("n"), [*keys, "a", "b"]).groupBy(*keys, "i", "j").agg(F.avg("e").alias("e"))
    return cells.join(mean, [*keys, "i", "j"]).select(*keys, "i", "j", (F.col("v") * F.col("e")).alias("v"))


def min_distance(segs: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """For each segment (key, i0, j0, len) the least distance of its diagonal from those of reference segments whose rows overlap its own, 1 if there are none: (key, i0, j0, len, dist). Overlaps are found by buckets of rows."""
    span = lambda d: d.select(key, F.col("i0").alias("start"), (F.col("i0") + F.col("len")).alias("end"), "j0", "len")
    x = overlap_join(span(segs), span(refs), key, 16)
    x = x.where((F.col("end") - 1 > F.col("start_b")) & (F.col("end_b") - 1 > F.col("start")))  # by first and last rows
    d = x.groupBy(key, F.col("start").alias("i0"), "j0", "len").agg(F.min(F.abs((F.col("j0") - F.col("start")) - (F.col("j0_b") - F.col("start_b")))).alias("dist"))
    return segs.join(d, [key, "i0", "j0", "len"], "left").select(key, "i0", "j0", "len", F.coalesce("dist", F.lit(1)).alias("dist"))


def without_blocks(segs: DataFrame, sizes: DataFrame, key: str, width: int = 5, share: float = 0.9) -> DataFrame:
    """Segments with `block`, whether at least `share` of their cells are full on one side: all of the `width` cells from there on in the row, or up to there (fewer at the edges), belong to segments."""
    cells = segment_cells(segs, [key]).join(sizes, key)
    w = Window.partitionBy(key, "i").orderBy("j")
    after = F.count("*").over(w.rangeBetween(0, width - 1)) == F.least(F.lit(width), F.col("n") - F.col("j"))
    before = F.count("*").over(w.rangeBetween(-(width - 1), 0)) == F.least(F.lit(width), F.col("j") + 1)
    flat = cells.withColumn("full", (after | before).cast("double")).select(key, "i", "j", "full")
    k = segs.select(key, "i0", "j0", "len", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k")).select(key, "i0", "j0", "len", (F.col("i0") + F.col("k")).alias("i"), (F.col("j0") + F.col("k")).alias("j"))
    return k.join(flat, [key, "i", "j"]).groupBy(key, "i0", "j0", "len").agg((F.avg("full") >= share).alias("block"))


def translations(segs: DataFrame, key: str) -> DataFrame:
    """Patterns (key, p, len, t): segments that begin at one place and are of one length, with their sorted distances, zero first."""
    return segs.groupBy(key, F.col("i0").alias("p"), "len").agg(F.array_sort(F.array_union(F.array(F.lit(0)), F.collect_set(F.col("j0") - F.col("i0")))).alias("t"))


def merged_patterns(patterns: DataFrame, key: str) -> DataFrame:
    """Patterns with the same translations whose first occurrences overlap, as one: (key, p, len, t)."""
    t = patterns.withColumn("ts", F.concat_ws(",", F.transform("t", lambda x: x.cast("string"))))
    w = Window.partitionBy(key, "ts").orderBy("p", "len")
    reach = F.max(F.col("p") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("p") >= reach).cast("int"), F.lit(0))
    g = t.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w))
    return g.groupBy(key, "ts", "grp").agg(F.min("p").alias("p"), (F.max(F.col("p") + F.col("len")) - F.min("p")).cast("int").alias("len"), F.first("t").alias("t")).select(key, "p", "len", "t")


def sections(segs: DataFrame, key: str) -> DataFrame:
    """Sections (key, p, len, sub): a segment from its first row to its last column, divided by its distance; those within a longer one (or an equal one of smaller division) whose division divides theirs are left out."""
    s = segs.select(key, F.col("i0").alias("p"), (F.col("len") + F.col("j0") - F.col("i0")).alias("len"), (F.col("j0") - F.col("i0")).alias("sub")).distinct()
    o = s.select(F.col(key).alias("_k"), F.col("p").alias("op"), F.col("len").alias("ol"), F.col("sub").alias("os"))
    longer = (F.col("ol") > F.col("len")) | ((F.col("ol") == F.col("len")) & (F.col("os") < F.col("sub")))
    inside = (F.col(key) == F.col("_k")) & (F.col("op") <= F.col("p")) & (F.col("p") + F.col("len") <= F.col("op") + F.col("ol")) & (F.col("sub") % F.col("os") == 0) & longer
    return s.join(o, inside, "left_anti")


def combinations(cells: DataFrame, keys: list[str], param: str, n: int) -> DataFrame:
    """The cells (keys, i, j) of every non-empty combination of n matrices, numbered by param from 0, as one: (keys, combo, i, j), combo the sum of 2 ** param."""
    # the matrices that have a cell meet before they are made combinations of, so that only cells are shuffled
    of = cells.groupBy(*keys, "i", "j").agg(F.bit_or(F.pow(F.lit(2), F.col(param)).cast("int")).alias("params"))
    combos = F.filter(F.sequence(F.lit(1), F.lit((1 << n) - 1)), lambda c: c.bitwiseAND(F.col("params")) > 0)
    return of.select(*keys, "i", "j", F.explode(combos).alias("combo"))


def label_values(seq: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each symbol stands at each label: (label, sym, n)."""
    return seq.join(labels, ["seq_id", "pos"]).groupBy("label", "sym").agg(F.count("*").alias("n"))


def successor_chains(seq: DataFrame) -> DataFrame:
    """Pairs (a, b) of symbols of a sequence of which b is a's only successor and a is b's only predecessor: (seq_id, a, b)."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    p = seq.select("seq_id", F.col("sym").alias("a"), F.lead("sym").over(w).alias("b")).where("b is not null").distinct()
    one = lambda x: F.count("*").over(Window.partitionBy("seq_id", x)) == 1
    return p.withColumn("x", one("a")).withColumn("y", one("b")).where("x and y").select("seq_id", "a", "b")


def isolated_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How many cells there are and how many have no neighbour on their diagonal: (keys, n, isolated)."""
    s = diag_segments(cells, keys)
    return s.groupBy(*keys).agg(F.sum("len").cast("long").alias("n"), F.sum((F.col("len") == 1).cast("long")).alias("isolated"))


def wildcard_equal(a: Column, b: Column, blank: int = -1) -> Column:
    """Whether two arrays are of one length and alike wherever neither is blank."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == blank) | (y == blank)), lambda x: F.coalesce(x, F.lit(False)))
