"""Alignment graphs, components, and patterns with their occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import dropped, redealt, stored
from .sequences import by_pos, islands, mode

#: Positions of a sequence that a node's number has room for.
ROOM = 1 << 24


def node(seq: Column, pos: Column) -> Column:
    """A vertex of an alignment graph, that is a position of a sequence, as one number."""
    return seq.cast("long") * ROOM + pos


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of longs: (node, root), a row for every node that has an edge, root the smallest node that can be reached.

    First every task joins what hangs together within its own part of the edges (contracted), so that only its nodes are shuffled, each with the smallest that it has found there. Then each round hangs larger neighbours on the smallest neighbour (large star), then the rest likewise (small star); the number of rounds grows with the logarithm of the longest path. A round's smallest neighbours are summed up before the shuffle; they are dealt anew for the joins that follow, above which no aggregate needs their order, so that Spark may split a node with very many edges. Each round is written to the shared folder; nothing but two counts reaches the driver. Loops and repeated edges do not matter, nulls are left out; no edges give no rows.
    """
    e = stored(contracted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")).distinct(), "edges")
    seen = _state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(redealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        small = large.join(redealt(large.groupBy("u").agg(F.min("v").alias("m")), "u"), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = stored(small.select("x.u", "x.v").where("u != v").distinct(), "edges")
        now = _state(new)
        dropped(e)
        e = new
        if now == seen:
            break
        seen = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Edges that a task joins at a time.
EDGES = 1 << 20


def contracted(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """Fewer edges (u, v), u > v, with the same components: of some `most` edges and what was found of a task's edges before, one from every node to the smallest that it hangs together with in them."""
    from .kernels import component_labels

    def stars(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in some]) for k in range(2))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = component_labels(len(nodes), at[: len(u)], at[len(u) :])
        k = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[k], pa.int64()), pa.array(nodes[root[k]], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= most:
                held = [stars(held)]
                size = held[0].num_rows
                if size > most // 2:  # mostly nodes of their own
                    yield held[0]
                    held, size = [], 0
        if held:
            yield stars(held)

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def _state(e: DataFrame) -> tuple:
    """How many edges there are, and a sum over them that tells one set from another."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def alignment_edges(segs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The edges (a, i, b, j) of segments' cells, with the number of segments that have them (n)."""
    k = segs.select(F.col(a).alias("a"), F.col(b).alias("b"), "i0", "j0", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    return k.groupBy("a", (F.col("i0") + F.col("k")).alias("i"), "b", (F.col("j0") + F.col("k")).alias("j")).agg(F.count("*").alias("n"))


def position_components(segs: DataFrame) -> DataFrame:
    """Components of the positions of each sequence that its segments (seq_id, i0, j0, len) connect: (seq_id, pos, root), root the first position."""
    e = alignment_edges(segs, "seq_id", "seq_id")
    c = components(e.select(node(F.col("a"), F.col("i")).alias("u"), node(F.col("b"), F.col("j")).alias("v")))
    return c.select(F.floor(F.col("node") / ROOM).alias("seq_id"), F.pmod("node", F.lit(ROOM)).cast("int").alias("pos"), F.pmod("root", F.lit(ROOM)).cast("int").alias("root"))


def comp_labels(seq: DataFrame, comp: DataFrame) -> DataFrame:
    """The number of the component, by first position, at each position; -1 where there is none: (seq_id, pos, label)."""
    ids = comp.select("seq_id", "root").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("seq_id").orderBy("root")) - 1).cast("int"))
    at = comp.join(ids, ["seq_id", "root"]).select("seq_id", "pos", "label")
    return seq.select("seq_id", "pos").join(at, ["seq_id", "pos"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def comp_modes(seq: DataFrame, comp: DataFrame) -> DataFrame:
    """The most frequent symbol of each component, the smallest on ties: (seq_id, root, sym)."""
    return mode(comp.join(seq, ["seq_id", "pos"]), ["seq_id", "root"], "sym")


def msa_entropy(seq: DataFrame, comp: DataFrame) -> DataFrame:
    """The sum of the entropies (bits) of the components' symbols, with the numbers of components and points: (seq_id, entropy, comps, points)."""
    n = comp.join(seq, ["seq_id", "pos"]).groupBy("seq_id", "root", "sym").agg(F.count("*").alias("n"))
    e = n.groupBy("seq_id", "root").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("e"), F.sum("n").alias("n"))
    return e.groupBy("seq_id").agg(F.sum("e").alias("entropy"), F.count("*").alias("comps"), F.sum("n").alias("points"))


def structure_graph(columns: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """From connections between alignment columns (keys, x, y), a row each: counts for x < y; those of at least `least` times the greatest of their keys stay; their diagonal segments (keys, i0, j0, len) with the mean count. Counts are summed up before the shuffle."""
    n = columns.where("x != y and x >= 0 and y >= 0").groupBy(*keys, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(F.count("*").alias("n"))
    kept = n.join(redealt(n.groupBy(*keys).agg(F.max("n").alias("most")), *keys), keys).where(F.col("n") >= least * F.col("most"))
    w = Window.partitionBy(*keys, "d").orderBy("i")
    r = kept.withColumn("d", F.col("j") - F.col("i")).withColumn("grp", F.col("i") - F.row_number().over(w))
    return r.groupBy(*keys, "d", "grp").agg(F.min("i").alias("i0"), F.count("*").cast("int").alias("len"), F.avg("n").alias("mean")).select(*keys, "i0", (F.col("i0") + F.col("d")).alias("j0"), "len", "mean")


def siatec(points: DataFrame, stripe: int = 1 << 18) -> DataFrame:
    """For the points (seq_id, pos, sym) of each sequence: every difference (dx, dy) of a point to a later one, in order of position and symbol, has a pattern, the points that it moves to points (n_points); n_translators counts the moves, zero and backwards ones too, that take the whole pattern to points. Rows with a null are left out.

    A sequence is a row. Its differences are dealt out by stripes of dx, so many that a stripe has about `stripe` of them; neither they nor the patterns are shuffled, as all of one difference are in one stripe. A task works on the stripes of many sequences at once (_translators).
    """
    p = points.select("seq_id", "pos", "sym").dropna()
    row = p.groupBy("seq_id").agg(F.array_sort(F.collect_set(F.struct("pos", "sym"))).alias("p")).select("seq_id", F.col("p.pos").alias("xs"), F.col("p.sym").alias("ys"))
    n = F.size("xs").cast("double")
    row = row.withColumn("stripes", F.ceil(n * n / (2 * stripe)).cast("int"))
    dealt = row.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    dealt = dealt.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id", "stripe")

    def run(frames):
        for f in frames:
            sizes = np.cumsum(f["xs"].map(len).to_numpy(np.int64) ** 2 // f["stripes"].to_numpy(np.int64))
            for _, part in f.groupby(sizes // stripe, sort=False):
                yield from _translators(part)

    return dealt.mapInPandas(run, "seq_id long, dx int, dy int, n_points int, n_translators int")


def _translators(part: pd.DataFrame, at_once: int = 1 << 20):
    """The rows of siatec for the stripes (seq_id, xs, ys, stripes, stripe) of some sequences. A row's stripes are ranges of dx of one width.

    Points of all rows are numbers on one line, a move is a difference of numbers: rows are so far apart, and symbols so near to one another, that no move leads from one row to another, nor from a symbol to another position's by chance. Patterns' moves are those of the first point, less those that take the second, the third and so on to no point.
    """
    size = part["xs"].map(len).to_numpy(np.int64)
    x, y = (np.concatenate([np.asarray(v, np.int64) for v in part[c]]) for c in ("xs", "ys"))
    start = np.concatenate(([0], np.cumsum(size)))
    of = np.repeat(np.arange(len(size)), size)
    low = lambda v, f: getattr(np, f).reduceat(v, start[:-1])
    wide = 4 * int((low(y, "maximum") - low(y, "minimum")).max()) + 4
    span = low(x, "maximum") - low(x, "minimum")
    if len(part) > 1 and 4.0 * (span + 1).sum() * wide > 2**62:  # too long a line
        for half in (part[: len(part) // 2], part[len(part) // 2 :]):
            yield from _translators(half)
        return
    line = np.concatenate(([0], np.cumsum(2 * span[:-1] + 2 * span[1:] + 4))) * wide  # a move from one row ends before the next
    x_line = x - low(x, "minimum")[of] + line[of] // wide
    code = x_line * wide + y - low(y, "minimum")[of]
    width = span // part["stripes"].to_numpy(np.int64) + 1
    least = (part["stripe"].to_numpy(np.int64) * width)[of]
    begin = np.maximum(np.searchsorted(x_line, x_line + least), np.arange(1, len(x) + 1))
    end = np.minimum(np.searchsorted(x_line, x_line + least + width[of]), start[1:][of])
    later = np.maximum(end - begin, 0)
    a = np.repeat(np.arange(len(x)), later)
    b = begin[a] + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    if not len(a):
        return
    order = np.lexsort((a, code[b] - code[a], of[a]))
    a, b = a[order], b[order]
    move = code[b] - code[a]
    new = np.flatnonzero(np.concatenate(([True], (move[1:] != move[:-1]) | (of[a[1:]] != of[a[:-1]]))))
    points = np.diff(np.append(new, len(a)))
    ids = part["seq_id"].to_numpy()
    for lo, hi in _spans(size[of[a[new]]], at_once):
        head, count = new[lo:hi], points[lo:hi]
        row = of[a[head]]
        left = np.repeat(np.arange(hi - lo), size[row])  # the patterns, and the moves that are left of them
        to = start[row][left] + np.arange(len(left)) - np.repeat(np.cumsum(size[row]) - size[row], size[row])
        moves = code[to] - code[a[head]][left]
        done = np.zeros(hi - lo, np.int64)
        k = 1
        while len(left):
            ended = count[left] == k
            done += np.bincount(left[ended], minlength=hi - lo)
            left, moves = left[~ended], moves[~ended]
            want = code[a[head[left] + k]] + moves
            hit = code[np.minimum(np.searchsorted(code, want), len(code) - 1)] == want
            left, moves = left[hit], moves[hit]
            k += 1
        out = {"seq_id": ids[row], "dx": x[b[head]] - x[a[head]], "dy": y[b[head]] - y[a[head]], "n_points": count, "n_translators": done}
        yield pd.DataFrame(out)


def _spans(sizes: np.ndarray, at_once: int):
    """Stretches (from, to) of sizes that sum up to about so many at most, or have one."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo]


def pattern_occurrences(seq: DataFrame, segs: DataFrame) -> DataFrame:
    """Segments' symbols as patterns, with where they are: (pattern, len, seq_id, pos), each once."""
    ends = segs.select("seq_id", "len", F.explode(F.array("i0", "j0")).alias("pos")).distinct()
    k = ends.select("seq_id", "len", "pos", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    s = k.join(seq.select("seq_id", F.col("pos").alias("p"), "sym"), (k.seq_id == seq.seq_id) & (F.col("pos") + F.col("k") == F.col("p"))).select(k.seq_id, "len", "pos", "k", "sym")
    g = s.groupBy("seq_id", "len", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "sym"))).alias("s"))
    return g.select(F.concat_ws("-", F.transform("s", lambda x: x["sym"].cast("string"))).alias("pattern"), "len", "seq_id", "pos")


def filter_patterns(occ: DataFrame, min_seqs: int, drop_uniform: bool = True) -> DataFrame:
    """Patterns in at least min_seqs sequences, without those of one symbol: (pattern, len, n_seqs, n_occs)."""
    g = occ.groupBy("pattern", "len").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count("*").alias("n_occs")).where(F.col("n_seqs") >= min_seqs)
    return g.where((F.size(F.array_distinct(F.split("pattern", "-"))) > 1) | F.lit(not drop_uniform))


def group_by_cooc(occ: DataFrame) -> DataFrame:
    """Patterns that begin at one place, directly or by others, are a group: (pattern, grp), grp the least pattern."""
    p = occ.select("pattern", F.xxhash64("pattern").alias("u"), "seq_id", "pos")
    least = p.groupBy("seq_id", "pos").agg(F.min("u").alias("v"))  # each place hangs its patterns on one
    c = components(p.join(least, ["seq_id", "pos"]).select("u", "v"))
    ids = p.select("pattern", "u").distinct().join(c, F.col("u") == F.col("node"), "left").select("pattern", F.coalesce("root", "u").alias("root"))
    return ids.join(ids.groupBy("root").agg(F.min("pattern").alias("grp")), "root").select("pattern", "grp")


def connection_counts(occ: DataFrame, least: int, many: int = 12) -> DataFrame:
    """How many patterns connect two places: for two occurrences of a pattern, place by place; (s1, p1, s2, p2, n) with n of at least `least`.

    A place has the marks (pattern, which of its symbols) of the occurrences over it; n is how many two places share. So places with fewer marks than `least` are left out, and the others meet by twos of marks; places with over `many` marks meet the rest by single marks, for they have too many twos. Of all that two places share, they are joined by the first only. The rows come from these joins as they are: what is shuffled are places and not their pairs.
    """
    k = occ.select("seq_id", "pos", F.xxhash64("pattern").alias("u"), F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k"))
    at = k.groupBy("seq_id", (F.col("pos") + F.col("k")).alias("p")).agg(F.array_sort(F.collect_set(F.struct("u", "k"))).alias("t")).where(F.size("t") >= least)
    at = stored(at.select(F.struct("seq_id", "p").alias("at"), "t"), "places")
    light = (F.size("t") <= many) if least > 1 else F.lit(False)
    twos = F.flatten(F.transform("t", lambda x, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    two = at.where(light).select("at", "t", F.explode(twos).alias("key"))
    one = at.select("at", "t", light.alias("light"), F.explode("t").alias("key"))

    def meet(a: DataFrame, b: DataFrame, first, which) -> DataFrame:
        b = b.select(F.col("at").alias("to"), F.col("t").alias("q"), "key", *[F.col("light").alias("to_light") for c in b.columns if c == "light"])
        x = a.join(b, "key").where(which).withColumn("both", F.array_intersect("t", "q")).where((F.size("both") >= least) & (F.col("key") == first(F.col("both"))))
        return x.select(F.least("at", "to").alias("v"), F.greatest("at", "to").alias("w"), F.size("both").cast("long").alias("n"))

    x = meet(two, two, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")), F.col("at") < F.col("to"))
    x = x.unionByName(meet(one.where("not light").drop("light"), one, lambda c: c[0], (F.col("at") < F.col("to")) | (F.col("to_light") & (F.col("at") != F.col("to")))))
    return x.select(F.col("v.seq_id").alias("s1"), F.col("v.p").alias("p1"), F.col("w.seq_id").alias("s2"), F.col("w.p").alias("p2"), "n")


def markov_form(seq: DataFrame, start: int = -2, end: int = -1) -> DataFrame:
    """Shares of transitions between symbols, from the start and to the end: (src, dst, p). Gaps (negative symbols) are left out before."""
    s = seq.where("sym >= 0")
    w = by_pos()
    t = s.select(F.col("sym").alias("src"), F.coalesce(F.lead("sym").over(w), F.lit(end)).alias("dst"))
    first = s.withColumn("k", F.row_number().over(w)).where("k = 1").select(F.lit(start).alias("src"), F.col("sym").alias("dst"))
    n = t.unionByName(first).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("p"))


def form_essence(form: DataFrame, start: int = -2, end: int = -1) -> DataFrame:
    """The most probable way from start to end: (ord, sym, cost), cost the sum of -log p up to there. The graph has a vertex for each symbol, so one task has it all; of equal ways the one over smaller symbols counts."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = sorted((int(a), int(b), float(-np.log(p))) for a, b, p in zip(pdf["src"], pdf["dst"], pdf["p"]))
        best: dict[int, tuple[float, tuple[int, ...]]] = {start: (0.0, (start,))}
        for _ in range(len({e[0] for e in edges}) + 1):
            for a, b, c in edges:
                if a in best and (b not in best or (round(best[a][0] + c, 12), best[a][1]) < (round(best[b][0], 12), best[b][1][:-1])):
                    best[b] = best[a][0] + c, (*best[a][1], b)
        way = best.get(end, (0.0, ()))[1]
        return pd.DataFrame([(k, s, best[s][0]) for k, s in enumerate(way[1:-1])], columns=["ord", "sym", "cost"])

    return form.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(f, "ord int, sym int, cost double")


def gaps(labels: DataFrame) -> DataFrame:
    """Runs of positions without a label: (seq_id, start, len)."""
    g = labels.where("label = -1")
    g = islands(g, ["seq_id"], "pos", F.col("pos") - F.lag("pos").over(by_pos()) > 1)
    return g.groupBy("seq_id", "grp").agg(F.min("pos").alias("start"), F.count("*").alias("len")).select("seq_id", "start", "len")


def comp_adjacency(comp: DataFrame) -> DataFrame:
    """The share of points of a component that have a point of another right after: common over the larger one's size, (seq_id, c, d, share), where there is any."""
    size = comp.groupBy("seq_id", "root").agg(F.count("*").alias("n"))
    a = comp.select("seq_id", F.col("root").alias("c"), (F.col("pos") + 1).alias("pos"))
    n = a.join(comp.select("seq_id", F.col("root").alias("d"), "pos"), ["seq_id", "pos"]).groupBy("seq_id", "c", "d").agg(F.count("*").alias("n"))
    n = n.join(size.select("seq_id", F.col("root").alias("c"), F.col("n").alias("nc")), ["seq_id", "c"]).join(size.select("seq_id", F.col("root").alias("d"), F.col("n").alias("nd")), ["seq_id", "d"])
    return n.select("seq_id", "c", "d", (F.col("n") / F.greatest("nc", "nd")).alias("share"))


def grouped_components(comp: DataFrame, least: float) -> DataFrame:
    """Components (seq_id, pos, root) that follow one another on at least a share `least` of the larger one's points, directly or by others, as groups: (seq_id, pos, grp), grp the first root."""
    a = comp_adjacency(comp).where(F.round("share", 9) >= least)
    g = components(a.select(node(F.col("seq_id"), F.col("c")).alias("u"), node(F.col("seq_id"), F.col("d")).alias("v")))
    at = comp.withColumn("_node", node(F.col("seq_id"), F.col("root"))).join(g.select(F.col("node").alias("_node"), F.col("root").alias("_grp")), "_node", "left")
    return at.select("seq_id", "pos", F.coalesce(F.pmod("_grp", F.lit(ROOM)), F.col("root")).cast("int").alias("grp"))
