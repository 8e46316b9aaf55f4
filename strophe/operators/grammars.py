"""Section dictionaries of sequences: pair induction, expansion, rules."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequences import by_pos


def thinned_pairs(seq: list[int]) -> list[tuple[int, int]]:
    """Neighbouring pairs; of a run of one pair every second is left out, and the last pair of all never counts."""
    pairs = list(zip(seq, seq[1:]))
    out, run = [], 0
    for a, b in zip(pairs, pairs[1:]):
        # `run` counts how long a pair has been repeating when this one begins
        same = a == b
        value = run + 1 if same else 0
        if value % 2 == 0:
            out.append(a)
        run = value
    return out


def induce(seqs: list[list[int]], ignore: tuple[int, ...] = ()) -> tuple[list[list[int]], dict[int, list[int]], dict[int, list[tuple[int, int]]]]:
    """Pair induction: as long as a pair occurs twice, the most frequent one (first seen on ties) becomes a section with the next number and replaces its occurrences, which do not overlap. A section with one parent and no other occurrence is put into it; then runs of two or more symbols that are no sections, but not whole sequences, become sections. The sequences that remain, the sections, and where their occurrences began."""
    seqs = [list(s) for s in seqs]
    index = [list(range(len(s))) for s in seqs]
    number = max((x for s in seqs for x in s), default=0) + 1
    sections: dict[int, list[int]] = {}
    occurrences: dict[int, list[tuple[int, int]]] = {}
    while True:
        count = Counter(p for s in seqs for p in thinned_pairs(s) if p[0] not in ignore and p[1] not in ignore)
        if not count:
            break
        pair, n = max(count.items(), key=lambda c: c[1])  # the first of equals
        if n < 2:
            break
        sections[number], occurrences[number] = list(pair), []
        for k, s in enumerate(seqs):
            new, at, i = [], [], 0
            while i < len(s):
                if i + 1 < len(s) and (s[i], s[i + 1]) == pair:
                    occurrences[number].append((k, index[k][i]))
                    new.append(number)
                    at.append(index[k][i])
                    i += 2
                else:
                    new.append(s[i])
                    at.append(index[k][i])
                    i += 1
            seqs[k], index[k] = new, at
        number += 1
    for t in list(sections):
        parents = [k for k, v in sections.items() if t in v]
        if len(parents) == 1 and sum(x == t for s in seqs for x in s) + sections[parents[0]].count(t) <= 1:
            sections[parents[0]] = [y for x in sections[parents[0]] for y in (sections[t] if x == t else [x])]
            del sections[t], occurrences[t]
    if sections:
        seqs = [grouped(s, sections, ignore) for s in seqs]
        for k in list(sections):
            sections[k] = grouped(sections[k], sections, ignore)
    return seqs, sections, occurrences


def grouped(seq: list[int], sections: dict[int, list[int]], ignore: tuple[int, ...]) -> list[int]:
    """Runs of two or more symbols that are no sections become sections, the last run first; a run that is the whole sequence stays."""
    number = max([*sections, *(x for s in sections.values() for x in s)]) + 1
    free = [x not in sections and x not in ignore for x in seq]
    runs, start = [], None
    for k, f in enumerate([*free, False]):
        if f and start is None:
            start = k
        elif not f and start is not None:
            runs.append((start, k))
            start = None
    for a, b in reversed([r for r in runs if 1 < r[1] - r[0] < len(seq)]):
        sections[number] = seq[a:b]
        seq = [*seq[:a], number, *seq[b:]]
        number += 1
    return seq


def expanded(x: int, sections: dict[int, list[int]]) -> list[int]:
    """A section's symbols."""
    out, todo = [], [x]
    while todo:
        t = todo.pop()
        if t in sections:
            todo += reversed(sections[t])
        else:
            out.append(t)
    return out


def depth(x: int, sections: dict[int, list[int]]) -> int:
    return 1 + max((depth(p, sections) for p in sections[x]), default=0) if x in sections else 0


def salient(seqs: list[list[int]], min_len: int = 2) -> list[tuple[int, int, int]]:
    """Sections by coverage, taken one after another where nothing is taken yet: (section, length, occurrences)."""
    _, sections, occ = induce(seqs)
    size = {k: len(expanded(k, sections)) for k in sections}
    left = [(k, o) for k, o in occ.items() if size[k] >= min_len]
    taken = [[False] * len(s) for s in seqs]
    out = []
    while left:
        k, o = max(left, key=lambda r: size[r[0]] * len(r[1]))
        left = [r for r in left if r[0] != k]
        for s, p in o:
            for q in range(p, min(p + size[k], len(taken[s]))):
                taken[s][q] = True
        out.append((k, size[k], len(o)))
        left = [(a, [(s, p) for s, p in b if not any(taken[s][p : p + size[a]])]) for a, b in left]
        left = [r for r in left if r[1]]
    return out


def bigram_top(seq: DataFrame) -> DataFrame:
    """The most frequent pair of each sequence after thinning, the first seen on ties, if it occurs twice: (seq_id, a, b, n)."""
    w = by_pos()
    p = seq.select("seq_id", "pos", F.col("sym").alias("a"), F.lead("sym").over(w).alias("b"), F.lead("sym", 2).over(w).alias("c")).where("b is not null")
    # a pair equals the next one if a = b = c; runs of such pairs are thinned by parity; the last pair has no next
    p = p.withColumn("same", (F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))).withColumn("last", F.col("c").isNull())
    reset = F.sum(F.when(F.coalesce("same", F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.where(~F.col("last")).withColumn("run", F.coalesce(reset, F.lit(0)))
    k = F.sum(F.col("same").cast("int")).over(Window.partitionBy("seq_id", "run").orderBy("pos"))
    kept = p.withColumn("k", F.when(F.col("same"), k).otherwise(0)).where("k % 2 = 0")
    n = kept.groupBy("seq_id", "a", "b").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    best = n.groupBy("seq_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "first", "a", "b", "n")).alias("x"))
    return best.select("seq_id", "x.a", "x.b", "x.n")


def expand_sections(rules: DataFrame, start: str) -> DataFrame:
    """The terminals of an acyclic dictionary (parent, ord, child) from a start symbol, in order: (ord, child, depth). A recursive query; the order is that of the paths of ords, padded."""
    spark = rules.sparkSession
    rules.createOrReplaceTempView("strophe_rules")
    x = spark.sql(f"""
        WITH RECURSIVE walk (path, child, depth) AS (
          SELECT lpad(cast(ord AS string), 9, '0'), child, 1 FROM strophe_rules WHERE parent = '{start}'
          UNION ALL SELECT concat(path, '.', lpad(cast(r.ord AS string), 9, '0')), r.child, depth + 1 FROM walk JOIN strophe_rules r ON r.parent = walk.child
        ) SELECT path, child, depth FROM walk""")
    leaves = x.join(rules.select(F.col("parent").alias("child")).distinct(), "child", "left_anti")
    return leaves.select((F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("ord"), "child", "depth")


def section_depth(rules: DataFrame) -> DataFrame:
    """For each section of an acyclic dictionary one more than the depth of its deepest part: (parent, depth)."""
    rules.createOrReplaceTempView("strophe_rules")
    return rules.sparkSession.sql("""
        WITH RECURSIVE walk (top, child, depth) AS (
          SELECT parent, child, 1 FROM strophe_rules UNION ALL SELECT top, r.child, depth + 1 FROM walk JOIN strophe_rules r ON r.parent = walk.child
        ) SELECT top AS parent, max(depth) AS depth FROM walk GROUP BY top""")


def pcfg_rules(children: DataFrame) -> DataFrame:
    """Rules (lhs, rhs) with their share among those of one left side, from trees' nodes and parts (label, parts): (lhs, rhs, n, p)."""
    n = children.groupBy(F.col("label").alias("lhs"), F.col("parts").alias("rhs")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lhs")))


def recurring_subseqs(seq: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Tuples of the given sizes that occur twice or more in all: (gram, size, n, coverage)."""
    from .statistics import tuple_hist

    parts = [tuple_hist(seq, k).groupBy("gram").agg(F.sum("n").alias("n")).withColumn("size", F.lit(k)) for k in sizes]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where("n > 1").select("gram", "size", "n", (F.col("n") * F.col("size")).alias("coverage"))


def contract_sections(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Label sequences (seq_id, pos, label) in which every occurrence of a section (label, size) is one position: within a run of the label, every size-th position stays."""
    from .sequences import islands

    w = by_pos()
    g = islands(labels, ["seq_id"], "pos", F.col("label") != F.lag("label").over(w)).join(sizes, "label", "left")
    k = F.row_number().over(Window.partitionBy("seq_id", "grp").orderBy("pos")) - 1
    kept = g.withColumn("k", k).where(F.col("size").isNull() | (F.pmod("k", F.coalesce("size", F.lit(1))) == 0))
    return kept.select("seq_id", (F.row_number().over(w) - 1).cast("int").alias("pos"), "label")


def section_layers(seq: list[int], sections: dict[int, list[int]]) -> list[tuple[list[int], list[int]]]:
    """Layers of (labels, durations) from coarse to fine: one section over all; then, for falling depths, the sequence with only the sections of at least that depth unpacked. The finest layer, plain symbols, is left out. Labels are by content: symbols are numbered by first appearance, a section counts as the mean of its symbols, and all are ranked."""
    deep = {k: depth(k, sections) for k in sections}
    size = {k: len(expanded(k, sections)) for k in sections}

    def unpacked(xs: list[int], least: int) -> list[int]:
        return [y for x in xs for y in (unpacked(sections[x], least) if x in sections and deep[x] >= least else [x])]

    rows = [unpacked(seq, d) for d in range(max(deep.values(), default=0) + 1, 0, -1)]
    top = max([*sections, *seq], default=0) + 1
    size[top] = sum(size.get(x, 1) for x in rows[0])
    rows = [[top], *rows]
    order = {x: float(k) for k, x in enumerate(dict.fromkeys(rows[-1]))}
    value = dict(order)
    for k in {x for r in rows for x in r} - set(order):
        parts = [order[x] for x in (expanded(k, sections) if k != top else rows[-1])]
        value[k] = round(sum(parts) / len(parts), 9)
    rank = {v: n for n, v in enumerate(sorted(set(value.values())))}
    return [([rank[value[x]] for x in r], [size.get(x, 1) for x in r]) for r in rows[:-1]]


# Sections -------------------------------------------------------------------------------------


def replaced(seq: list[int], x: int, by: list[int]) -> list[int]:
    """A sequence with every x replaced by what stands for it."""
    return [z for y in seq for z in (by if y == x else [y])]


def without_section(seqs: list[list[int]], sections: dict[int, list[int]], x: int) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Sequences and sections with a section unpacked everywhere."""
    return [replaced(s, x, sections[x]) for s in seqs], {k: replaced(v, x, sections[x]) for k, v in sections.items() if k != x}


def homogeneous(sections: dict[int, list[int]]) -> int | None:
    """The first section that is one symbol again and again; None for none."""
    return next((k for k, v in sections.items() if len(set(v)) == 1), None)


def without_homogeneous(seqs: list[list[int]], sections: dict[int, list[int]]) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Unpacks sections of one symbol until there are none."""
    while (x := homogeneous(sections)) is not None:
        seqs, sections = without_section(seqs, sections, x)
    return seqs, sections


def without_long_sections(seqs: list[list[int]], sections: dict[int, list[int]], share: float = 0.2) -> tuple[list[list[int]], dict[int, list[int]]]:
    """Unpacks sections longer than a share of the first sequence's symbols."""
    total = sum(len(expanded(x, sections)) for x in seqs[0]) if seqs else 0
    for x in [k for k in sections if len(expanded(k, sections)) > share * total]:
        seqs, sections = without_section(seqs, sections, x)
    return seqs, sections


def parts(seq: list[int], sections: dict[int, list[int]]) -> list[int]:
    """All that sections of a sequence are made of, level by level."""
    out, level = [], [y for x in seq if x in sections for y in sections[x]]
    while level:
        out += level
        level = [y for x in level if x in sections for y in sections[x]]
    return out


def split_at_recurring(seqs: list[list[int]]) -> list[list[int]]:
    """Sequences cut before and after every symbol that is there more than once in all; pieces that are alike once."""
    count = Counter(x for s in seqs for x in s)
    out: dict[tuple[int, ...], None] = {}
    for s in seqs:
        piece: list[int] = []
        for x in s:
            if count[x] > 1:
                if piece:
                    out[tuple(piece)] = None
                out[x,] = None
                piece = []
            else:
                piece.append(x)
        if piece:
            out[tuple(piece)] = None
    return [list(p) for p in out]


def occurs_in(small: list[int], large: list[int]) -> bool:
    """Whether a sequence stands in another without a gap."""
    return any(large[k : k + len(small)] == small for k in range(len(large) - len(small) + 1))


def similar_parts(seqs: list[list[int]], sections: dict[int, list[int]], least: float = 0.5) -> list[tuple[float, tuple[int, ...], tuple[int, ...]]]:
    """Pairs of sequences whose symbols are alike by local alignment over the longer one, of `least` or more; then the same between what they are made of: sections that stand at no lower level are unpacked and cut at what recurs, until all is. A pair of which one is a single section within the other is left out. Each pair once, the shorter first, in the order found."""
    from .kernels import smith_waterman

    out: dict[tuple, None] = {}
    while True:
        flat = [[y for x in s for y in expanded(x, sections)] for s in seqs]
        inner = [set(parts(s, sections)) for s in seqs]
        for a in range(len(seqs)):
            for b in range(a + 1, len(seqs)):
                if (len(seqs[a]) == 1 and seqs[a][0] in inner[b]) or (len(seqs[b]) == 1 and seqs[b][0] in inner[a]):
                    continue
                share = len(smith_waterman(flat[a], flat[b])) / max(len(flat[a]), len(flat[b]), 1)
                if share >= least:
                    x, y = tuple(seqs[a]), tuple(seqs[b])
                    out[(round(share, 9), *((x, y) if len(x) < len(y) else (y, x)))] = None
        low = set().union(*inner) if inner else set()
        top = {x for s in seqs for x in s if x in sections and x not in low}
        if not top:
            return list(out)
        seqs = split_at_recurring([[y for x in s for y in (sections[x] if x in top else [x])] for s in seqs])


def dependent(pairs: list[tuple[float, tuple[int, ...], tuple[int, ...]]], sections: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Numbers (i, j) of similar pairs where i's both symbols stand in j's: one in each."""
    flat = [([y for x in a for y in expanded(x, sections)], [y for x in b for y in expanded(x, sections)]) for _, a, b in pairs]

    def within(p, q) -> bool:
        x = [[occurs_in(s, t) for t in q] for s in p]
        return (x[0][0] and x[1][1] and not (x[0][1] and x[1][0])) or (x[0][1] and x[1][0] and not (x[0][0] and x[1][1]))

    return [(i, j) for i, p in enumerate(flat) for j, q in enumerate(flat) if i != j and within(p, q)]


def salient_labels(seqs: list[list[int]], count: int = 0, min_len: int = 2) -> list[list[int]]:
    """For each position the section that salient() takes there, -1 for none; of at most `count` sections if that is not 0."""
    _, sections, occ = induce(seqs)
    labels = [[-1] * len(s) for s in seqs]
    size = {k: len(expanded(k, sections)) for k in sections}
    left = {k: o for k, o in occ.items() if size[k] >= min_len}
    taken = 0
    while left and (not count or taken < count):
        best = max(left, key=lambda k: size[k] * len(left[k]))
        for s, p in left.pop(best):
            for q in range(p, min(p + size[best], len(labels[s]))):
                labels[s][q] = best
        taken += 1
        free = {k: [(s, p) for s, p in o if all(x == -1 for x in labels[s][p : p + size[k]])] for k, o in left.items()}
        left = {k: o for k, o in free.items() if o}
    return labels


def sections_by_coverage(seqs: list[list[int]]) -> list[tuple[list[int], int]]:
    """Sections as symbols, with how often they are found, by length times number, greatest first; those found first before equals."""
    _, sections, occ = induce(seqs)
    flat = [(expanded(k, sections), len(occ.get(k, []))) for k in sections]
    return sorted(flat, key=lambda x: -len(x[0]) * x[1])


def layer_labels(layers: list[tuple[list[int], list[int]]]) -> list[list[int]]:
    """Layers of (labels, durations) as a label for every position."""
    return [[x for x, n in zip(labels, durations) for _ in range(n)] for labels, durations in layers]


def divided_layers(layers: list[list[int]], places: list[int]) -> list[list[int]]:
    """Layers of a label for each position, divided at places: where, on every layer but the first, no section with the label of the place begins before it, the beginnings of all sections with that label, as long as the place lies within its own, get a new label."""
    out = [list(x) for x in layers]
    for place in places:
        starts = []
        for layer in out:
            at = [k for k, x in enumerate(layer) if x == layer[place] and (k == 0 or layer[k - 1] != x)]
            starts.append(at)
        if not all(min(s) >= place for s in starts[1:]):
            continue
        new = max(x for layer in out for x in layer) + 1
        for layer, at in zip(out, starts):
            before = [k for k in at if k <= place]
            offset = place - max(before) if before else 0
            for k in at:
                for q in range(k, min(k + offset, len(layer))):
                    layer[q] = new
    return out


def tree_text(x: int | str, parts_of: dict, top: bool = True) -> str:
    """A section and its parts as "(section part part ...)"; a plain symbol as itself."""
    if x not in parts_of:
        return str(x)
    return f"({x} {' '.join(tree_text(y, parts_of, False) for y in parts_of[x])})"


def inside_probability(seq: list, rules: dict, start) -> float:
    """The probability that a grammar's start gives a sequence: rules by left side, (parts, probability) each; a part that has no rules is a symbol. The sum over all derivations; rules that lead from a symbol to itself alone do not count. Spans of the sequence are solved from short to long, so the work is cubic in its length."""
    n = len(seq)
    table: dict[tuple, float] = {}

    def of(x, a: int, b: int, open_: frozenset) -> float:
        if x not in rules:
            return 1.0 if b - a == 1 and seq[a] == x else 0.0
        if (x, a, b) in open_:
            return 0.0
        key = (x, a, b)
        if key not in table or open_:
            total = sum(p * split(tuple(ps), a, b, open_ | {key}) for ps, p in rules[x])
            if open_:
                return total
            table[key] = total
        return table[key]

    def split(ps: tuple, a: int, b: int, open_: frozenset) -> float:
        if len(ps) == 1:
            return of(ps[0], a, b, open_)
        return sum(left * split(ps[1:], m, b, frozenset()) for m in range(a + 1, b - len(ps) + 2) if (left := of(ps[0], a, m, frozenset() if m < b else open_)))

    return of(start, 0, n, frozenset()) if n else 0.0


def grammar_of(trees: list[tuple]) -> dict:
    """Rules with their shares from trees (label, part, part, ...), parts being trees or symbols."""
    count: dict = {}

    def walk(t) -> None:
        if isinstance(t, tuple):
            right = tuple(x[0] if isinstance(x, tuple) else x for x in t[1:])
            count.setdefault(t[0], Counter())[right] += 1
            for x in t[1:]:
                walk(x)

    for t in trees:
        walk(t)
    return {k: [(r, n / sum(c.values())) for r, n in sorted(c.items(), key=str)] for k, c in count.items()}


# Forms ----------------------------------------------------------------------------------------


def ways_until_join(a: int, b: int, after: dict[int, list[int]]) -> list[list[int]] | None:
    """The ways from two places as long as each has one successor, up to the first place that both come to; None if they never meet."""
    ways = [[a], [b]]
    while True:
        both = set(ways[0]) & set(ways[1])
        if both:
            join = min(both, key=lambda x: (ways[0].index(x) + ways[1].index(x), x))
            return [w[: w.index(join) + 1] for w in ways]
        moved = False
        for w in ways:
            nxt = after.get(w[-1], [])
            if len(nxt) == 1 and nxt[0] not in w:
                w.append(nxt[0])
                moved = True
        if not moved:
            return None


def alternatives(edges: list[tuple[int, int]]) -> list[list[list[int]]]:
    """For each place with several successors and each two of these: the ways up to where they meet again."""
    after: dict[int, list[int]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    out = []
    for fork, nxt in sorted(after.items()):
        for k, a in enumerate(nxt):
            for b in nxt[k + 1 :]:
                if ways := ways_until_join(a, b, after):
                    out.append([[fork, *w] for w in ways])
    return out


def without_detours(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A form without the places between a fork and a join that a single step leads past."""
    gone = {x for ways in alternatives(edges) if any(len(w) == 2 for w in ways) for w in ways if len(w) > 2 for x in w[1:-1]}
    return [(a, b) for a, b in sorted(set(edges)) if a not in gone and b not in gone]
