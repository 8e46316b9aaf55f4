"""SimHash near-duplicates by a trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import components
from .common import per_batch, redealt, stored

BITS = 64
#: Shingles of one text that are counted at once, so that the longest text needs no more memory than this many hashes.
SLAB = 1 << 16
#: Fingerprints in one group beyond which the group is dealt out again by longer keys.
HOT = 2000
#: The same for groups of wide fingerprints, which are compared in twos of parts of half this size.
WIDE_HOT = 1 << 15
#: Rows of a node of wide fingerprints' tries that are compared one by one.
WIDE_LEAF = 128
_SPREAD = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number: a bit is 1 if it is set in over half of the XXH64 of the word shingles. Fewer words than `width`: of the whole sequence; none, or null: 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    of, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, SLAB):
        to = min(n, at + SLAB)
        h = np.array([of(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())], np.uint64)
        by_byte = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _SPREAD
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def f(b: pa.RecordBatch) -> dict:
        fp = np.fromiter((fingerprint(x, width, seed) for x in b.column("text").to_pylist()), np.uint64, b.num_rows)
        return {"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))}

    return per_batch(docs.select("doc_id", F.col("text").cast("binary").alias("text")), "doc_id long, fp long", f)


def _keys(budget: int, blocks: int) -> Column:
    """The keys of a fingerprint: with the bits cut into `blocks`, two fingerprints that differ in at most `budget` bits agree on at least blocks - budget of them, so on one of the masks. Array of (mask number, masked fingerprint)."""
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    out = []
    for n, kept in enumerate(combinations(range(blocks), blocks - budget)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(100 * blocks + n).alias("m"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


def links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """For distinct fingerprints (fp): edges (u, v) that span exactly the components of "differ in at most `budget` bits".

    The trie of the fingerprints is dealt out by the nodes that agree on one of the masks of _keys (five blocks, one of them equal). Below each such node, pairs of nodes are walked together in one task (trie_links). A node with over HOT fingerprints goes another way: its fingerprints are dealt once more by longer keys (eight blocks, four equal), which pairs within reach must share as well.
    """
    k = fps.select("fp", F.explode(_keys(budget, budget + 1)).alias("k")).select("fp", "k.m", "k.key")
    hot = k.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("m", "key", F.lit(True).alias("hot"))
    k = k.join(redealt(hot, "m", "key"), ["m", "key"], "left")
    again = k.where("hot").select("fp").distinct().select("fp", F.explode(_keys(budget, 2 * budget)).alias("k")).select("fp", "k.m", "k.key")
    dealt = k.where("hot is null").select("fp", "m", "key").unionByName(again)
    dealt = dealt.repartition(F.col("m"), F.col("key")).sortWithinPartitions("m", "key", "fp")
    return dealt.mapInArrow(lambda it: _by_slab(it, budget), "u long, v long").distinct()


def _by_slab(batches: Iterator[pa.RecordBatch], budget: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs trie_links over whole groups of sorted rows, at least `most` rows at a time."""
    kept: list = []
    n = 0
    for b in batches:
        kept.append([b.column(x).to_numpy(zero_copy_only=False) for x in ("m", "key", "fp")])
        n += b.num_rows
        if n >= most:
            m, key, fp = map(np.concatenate, zip(*kept))
            same = (m == m[-1]) & (key == key[-1])
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
            yield from _edges(m[:cut], key[:cut], fp[:cut], budget)
            kept, n = [[m[cut:], key[cut:], fp[cut:]]], n - cut
    if n:
        yield from _edges(*map(np.concatenate, zip(*kept)), budget)


def _edges(m, key, fp, budget: int) -> Iterator[pa.RecordBatch]:
    if len(fp):
        group = np.concatenate(([0], np.cumsum((m[1:] != m[:-1]) | (key[1:] != key[:-1]))))
        a, b = trie_links(fp.view(np.uint64), group, budget)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])


class _Sets:
    """Components of row numbers; label holds the smallest row number of each, brought up to date by join()."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label[:] = up

    def moved(self, rows: np.ndarray) -> _Sets:
        """The same components of rows that are put into another order."""
        label, out = self.label[rows], _Sets(len(rows))
        least = np.full(len(rows), len(rows))
        np.minimum.at(least, label, np.arange(len(rows)))
        out.label = least[label]
        return out


def trie_links(fp: np.ndarray, group: np.ndarray, budget: int, leaf: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows (by group; fp a column, or one for each word of wide fingerprints, the topmost first) to hang on others (a on b), so that rows of a group are joined exactly if steps of at most `budget` bits lead from one to the other.

    Every group is a binary trie, a node is a range of rows. All pairs of nodes walk down a bit at a time, with the number of bits in which their prefixes differ; a pair over the budget is dropped. A pair of small nodes, or at the bottom, is compared row by row. A pair whose rows already are in one component is dropped too, for it can join nothing new; and a group's largest component, once it is known, is a trie of its own that does not meet itself. So a dense ball of near copies does not cost all its pairs.
    """
    fp = fp.reshape(len(fp), -1)
    order = np.lexsort((*fp.T[::-1], group))  # Spark sorts signed
    fp, group, (n, words) = fp[order], group[order], fp.shape
    sets = _Sets(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    last = np.append(first[1:], n)
    sets.join(*_near(fp, *(np.flatnonzero(group[1:] == group[:-1])[None] + [[0], [1]]), budget))
    big = last - first > 4 * leaf
    for _ in range(12):  # stars around rows of groups that are still apart; this only spares later work
        if not big.any():
            break
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first[big], last[big])])
        size = (last - first)[big]
        centre = np.repeat(first[big] + (np.arange(len(size)) * 7919 + _ * 104729) % size, size)
        sets.join(*_near(fp, rows, centre, budget))
    core = _cores(sets.label, group, leaf)
    moved = np.lexsort((~core, group))
    fp, order, core = fp[moved], order[moved], np.concatenate(([0], np.cumsum(core[moved])))
    sets = sets.moved(moved)
    mid = first + core[last] - core[first]
    alo, ahi, blo, bhi = (np.concatenate(x) for x in ((mid, first), (last, mid), (mid, mid), (last, last)))
    some = (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo == 1))
    alo, ahi, blo, bhi = (x[some] for x in (alo, ahi, blo, bhi))
    dist = np.zeros(len(alo), np.int64)
    for bit in range(words * BITS + 1):
        if not len(alo):
            break
        done = ((ahi - alo) * (bhi - blo) <= leaf * leaf) | (bit == words * BITS)
        (_compare if words == 1 else _tables)(fp, sets, alo[done], ahi[done], blo[done], bhi[done], budget)
        alo, ahi, blo, bhi, dist = (x[~done] for x in (alo, ahi, blo, bhi, dist))
        if not len(alo):
            break
        change = np.concatenate(([0], np.cumsum(sets.label[1:] != sets.label[:-1])))
        one = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (sets.label[alo] == sets.label[blo])
        alo, ahi, blo, bhi, dist = (x[~one] for x in (alo, ahi, blo, bhi, dist))
        ones = np.concatenate(([0], np.cumsum(((fp[:, bit // BITS] >> np.uint64(BITS - 1 - bit % BITS)) & np.uint64(1)).astype(np.int64))))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        self_pair = alo == blo
        parts = [(alo, amid, blo, bmid, dist), (amid, ahi, bmid, bhi, dist), (alo, amid, bmid, bhi, dist + 1)]
        parts.append(tuple(x[~self_pair] for x in (amid, ahi, blo, bmid, dist + 1)))
        alo, ahi, blo, bhi, dist = (np.concatenate(x) for x in zip(*parts))
        keep = (ahi > alo) & (bhi > blo) & (dist <= budget) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, dist = (x[keep] for x in (alo, ahi, blo, bhi, dist))
    a = np.flatnonzero(sets.label != np.arange(n))
    return order[a], order[sets.label[a]]


def _cores(label: np.ndarray, group: np.ndarray, least: int) -> np.ndarray:
    """Which rows are in the largest component of their group, if that has over `least` rows."""
    size = np.bincount(label, minlength=len(label))[label]
    best = np.lexsort((label, -size, group))
    start = np.concatenate(([True], group[best][1:] != group[best][:-1]))[: len(best)]
    core = label[best][start][np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))[: len(group)]] if len(group) else label
    return (label == core) & (size > least)


def _near(fp: np.ndarray, a: np.ndarray, b: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows that differ in at most `budget` bits, word by word."""
    dist: np.ndarray | int = 0
    for w in range(fp.shape[1]):
        dist = dist + np.bitwise_count(fp[:, w][a] ^ fp[:, w][b]).astype(np.uint16)
        stay = dist <= budget
        a, b, dist = a[stay], b[stay], dist[stay]
    return a, b


def _compare(fp, sets: _Sets, alo, ahi, blo, bhi, budget: int, at_once: int = 1 << 21) -> None:
    """Compares all rows of the node pairs, some two million pairs of rows at a time."""
    sizes = (ahi - alo) * (bhi - blo)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // at_once)) + 1
    for part in np.split(np.arange(len(sizes)), cuts):
        if len(part):
            size = sizes[part]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat((bhi - blo)[part], size)
            a, b = np.repeat(alo[part], size) + k // wide, np.repeat(blo[part], size) + k % wide
            new = (a < b) & (sets.label[a] != sets.label[b])
            sets.join(*_near(fp, a[new], b[new], budget))


def _tables(fp, sets: _Sets, alo, ahi, blo, bhi, budget: int, at_once: int = 1 << 20) -> None:
    """Compares all rows of the node pairs, a table of the words but the last for each pair, and what these leave within the budget as a whole."""
    columns = np.ascontiguousarray(fp.T)[:-1]  # 192 bits fit a byte
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kept = 0

    def join() -> None:
        if found:
            a, b = map(np.concatenate, zip(*found))
            new = sets.label[a] != sets.label[b]
            sets.join(*_near(fp, a[new], b[new], budget))
            found.clear()

    for a0, a1, b0, b1 in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist()):
        step = max(1, at_once // (b1 - b0))
        for at in range(a0, a1, step):
            to = min(a1, at + step)
            dist = np.bitwise_count(columns[0, at:to, None] ^ columns[0, None, b0:b1])
            for c in columns[1:]:
                dist += np.bitwise_count(c[at:to, None] ^ c[None, b0:b1])
            hit = np.flatnonzero(dist.ravel() <= budget)
            if len(hit):
                a, b = at + hit // (b1 - b0), b0 + hit % (b1 - b0)
                found.append((a, b))
                kept += len(a)
                if kept > at_once:
                    join()
                    kept = 0
    join()


def groups(fps: DataFrame, budget: int = 4) -> DataFrame:
    """For distinct fingerprints (fp): fp and root, the same for all that steps of at most `budget` bits lead to."""
    roots = components(links(fps, budget))
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """For each row: doc_id, fp (signed long), fingerprint (16 hex digits) and component_id, the smallest doc_id that steps between fingerprints of at most `budget` differing bits lead to.

    Rows with one fingerprint are a step of 0 bits apart and are worked on once. Null and empty texts have fingerprint 0, linked like any other. Repeated rows stay; a component whose doc_ids are all null has component_id null. An empty table gives none. Columns other than doc_id and text do not matter.
    """
    d = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = d.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    by_root = distinct.join(groups(distinct.select("fp"), budget), "fp")
    least = by_root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = by_root.join(redealt(least, "root"), "root").select("fp", "component_id")
    return d.join(ids, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity ---------------------------------------------------------------------

#: Words of 64 bits of a wide fingerprint, and the bits and number of the blocks of each word that deal fingerprints out.
WIDE, BLOCK_BITS, BLOCKS = 4, 10, 6
#: Texts of candidates that are compared in one task; larger components are compared in parts.
VERIFIED = 200
#: Texts of a component that every part has, so that near copies in different parts are joined through them.
ANCHORS = 8
#: Odd multipliers that make further words out of a shingle's hash.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
WIDE_COLUMNS = [f"f{k}" for k in range(WIDE)]


def _shingles(text: bytes | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, SLAB at a time; fewer words than `width`: of the whole sequence; none, or null: nothing."""
    words = (text or b"").lower().split()
    if not words:
        return
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, of = len(words) - width + 1, xxhash.xxh64_intdigest
    for at in range(0, n, SLAB):
        to = min(n, at + SLAB)
        yield np.array([of(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())], np.uint64)


def shingle_set(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, width, seed)]))


def _wide(slabs) -> np.ndarray:
    counts, n = np.zeros((WIDE, BITS), np.int64), 0
    for h in slabs:
        n += len(h)
        for w in range(WIDE):
            x = h if not w else (h ^ (h >> np.uint64(31))) * _MIX[w - 1]
            x = x ^ (x >> np.uint64(29)) if w else x
            by_byte = x.view(np.uint8).reshape(-1, 8)
            for k in range(8):
                counts[w, 8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _SPREAD
    return np.packbits((2 * counts > n).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def wide_fingerprint(text: bytes | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """A SimHash of 256 bits over the word shingles; fewer words than `width`: of the whole sequence; none, or null: 0."""
    return _wide(_shingles(text, width, seed))


def set_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The same over a set of shingles, each of which counts once, as in a Jaccard similarity."""
    return _wide(shingles[k : k + SLAB] for k in range(0, len(shingles), SLAB))


def bits_apart(similarity: float) -> int:
    """How many of the bits of wide fingerprints texts of a Jaccard similarity differ in, with three deviations more. Sets of the similarity j share 2 j / (1 + j) of their shingles, which is the cosine; a bit differs with a chance of the angle over pi."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = WIDE * BITS
    return int(round(n * p + 3 * (n * p * (1 - p)) ** 0.5))


def _blocks() -> list[Column]:
    """The blocks of a wide fingerprint, as columns."""
    return [F.shiftrightunsigned(F.col(f"f{w}"), BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")) for w in range(WIDE) for k in range(BLOCKS)]


def wide_links(fps: DataFrame, budget: int) -> DataFrame:
    """For distinct wide fingerprints (f0 to f3, node): edges (u, v) between nodes that join what differs in at most `budget` bits and agrees in one of 24 blocks of 10 bits at least; of texts with a Jaccard similarity of 0.8 that is 99 %, of 0.9 nearly all.

    As in `links`, a trie is dealt out by what near fingerprints must share, here a block, and below it pairs of nodes are walked together in one task with the budget (ball_links). Groups of over WIDE_HOT fingerprints are cut into parts by a hash, and every two parts meet in a task; so the same pairs are compared, however full a block is. The list of such groups, which is broadcast, is no longer than the blocks have values.
    """
    cols = ["node", *WIDE_COLUMNS]
    one = F.array(*[F.struct(F.lit(k).alias("m"), x.alias("key")) for k, x in enumerate(_blocks())])
    d = fps.select(*cols, F.explode(one).alias("k")).select(*cols, "k.m", "k.key")
    hot = d.groupBy("m", "key").agg(F.count("*").alias("n")).where(F.col("n") > WIDE_HOT).select("m", "key", F.ceil(2 * F.col("n") / WIDE_HOT).cast("int").alias("parts"))
    d = d.join(F.broadcast(hot), ["m", "key"], "left").withColumn("p", F.pmod(F.xxhash64("node", "m"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("p"))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    d = d.withColumn("k", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(F.transform(others, lambda q: F.struct(F.least(q, "p").alias("i"), F.greatest(q, "p").alias("j"))))))
    dealt = d.select(*cols, F.xxhash64("m", "key", "k.i", "k.j").alias("key"))
    dealt = dealt.repartition(F.col("key")).sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        size = 0

        def edges(key, node, *fp):
            group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            a, b = ball_links(np.stack(fp, 1).view(np.uint64), group, budget)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

        for batch in batches:
            kept.append([batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", *cols)])
            size += batch.num_rows
            if size >= 1 << 18:
                whole = list(map(np.concatenate, zip(*kept)))
                same = whole[0] == whole[0][-1]
                cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield edges(*[x[:cut] for x in whole])
                kept, size = [[x[cut:] for x in whole]], size - cut
        if size:
            yield edges(*map(np.concatenate, zip(*kept)))

    return dealt.mapInArrow(run, "u long, v long").distinct()


def ball_links(fp: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """trie_links of wide fingerprints (fp by words): the trie has 256 levels, and nodes of some hundred rows are compared as tables, for a budget of 56 bits drops few pairs of nodes above them."""
    return trie_links(fp, group, budget, WIDE_LEAF)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted) have at least this Jaccard similarity; empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if small < similarity * large:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (small + large - common) - 1e-9


def set_links(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray, budget: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of at least this similarity that join what such pairs join: of rows at most `budget` bits apart, one of which asks, and whose labels are not one yet. Nearest rows are tried first."""
    label, out = label.copy(), []
    for x in np.flatnonzero(asks).tolist():
        dist = np.bitwise_count(fp ^ fp[x]).sum(1)
        near = np.flatnonzero((dist <= budget) & (label != label[x]) & (~asks | (np.arange(len(fp)) > x)))
        for y in near[np.argsort(dist[near], kind="stable")].tolist():
            if label[y] != label[x] and similar(sets[x], sets[y], similarity):
                label[label == label[y]] = label[x]
                out.append((x, y))
    return out


def _set_edges(rows: DataFrame, width: int, seed: int, budget: int, similarity: float) -> DataFrame:
    """Edges (u, v) of set_links in every group of rows (g, node, label, asks, f0 to f3, text)."""
    cols = ["g", "node", "label", "asks", *WIDE_COLUMNS]

    def edges(node, label, asks, fp, sets) -> list:
        return [(node[a], node[b]) for a, b in set_links(np.array(fp, np.int64).view(np.uint64), sets, np.array(label, np.int64), np.array(asks, bool), budget, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found, kept = None, [], ([], [], [], [], [])
        for b in batches:
            for g, node, label, asks, *fp, text in zip(*(b.column(c).to_pylist() for c in (*cols, "text"))):
                if g != group:
                    found += edges(*kept) if len(kept[0]) > 1 else []
                    group, kept = g, ([], [], [], [], [])
                if not kept[0] or kept[0][-1] != node:  # repeated rows
                    for x, value in zip(kept, (node, label, asks, fp, shingle_set(text, width, seed))):
                        x.append(value)
            if len(found) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])
                found = []
        found += edges(*kept) if len(kept[0]) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return rows.repartition(F.col("g")).sortWithinPartitions("g", "node", F.desc("asks")).select(*cols, "text").mapInArrow(run, "u long, v long")


def _parts(n: Column) -> Column:
    return F.ceil(n / VERIFIED).cast("int")


def verified_links(members: DataFrame, with_text, width: int, seed: int, budget: int, similarity: float) -> DataFrame:
    """For members (node, root, f0 to f3) of components of candidates: edges (u, v) between texts of at least this Jaccard similarity, that join what all such pairs of a component at most `budget` bits apart join. with_text adds the texts to rows of members.

    A component of up to VERIFIED texts is compared in one task. A larger one is cut into parts by a hash, to each of which ANCHORS texts are added. Then all that are still not in the component's largest set are compared with all of the component, part by part; near copies are mostly in that set by then, so a large family does not cost its square.
    """
    n = members.groupBy("root").agg(F.count("*").alias("n"))
    m = members.join(redealt(n, "root"), "root")
    anchors = m.where(F.col("n") > VERIFIED).groupBy("root").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node"), F.col("n")) < 4 * ANCHORS, F.col("node")))), 1, ANCHORS).alias("anchors"))
    m = stored(m.join(redealt(anchors, "root"), "root", "left"), "members")
    p = F.pmod(F.xxhash64("node"), _parts(F.col("n"))).cast("int")
    to = F.when(F.array_contains("anchors", F.col("node")), F.sequence(F.lit(0), _parts(F.col("n")) - 1)).otherwise(F.array(p))
    rows = with_text(m).withColumn("p", F.explode(to))
    fps = [*WIDE_COLUMNS, "text"]
    first = stored(_set_edges(rows.select(F.xxhash64("root", "p").alias("g"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), *fps), width, seed, budget, similarity), "links")
    large = m.where(F.col("n") > VERIFIED)
    if large.isEmpty():
        return first
    found = components(first).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    large = stored(large.join(found, F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("_root", "node")).drop("_node", "_root"), "members")
    most = large.groupBy("root", "label").agg(F.count("*").alias("k")).groupBy("root").agg(F.max(F.struct("k", "label")).alias("core"))
    large = large.join(redealt(most.select("root", F.col("core.label").alias("core"), F.col("core.k").alias("k")), "root"), "root").where("k < n").withColumn("p", p)
    q = F.sequence(F.lit(0), _parts(F.col("n")) - 1)
    here = F.sequence(F.lit(0), _parts(F.col("n") - F.col("k")) - 1)
    asking = F.pmod(F.xxhash64("node", F.lit(1)), _parts(F.col("n") - F.col("k"))).cast("int")
    to = F.transform(here, lambda i: F.struct(i.alias("i"), F.col("p").alias("j"), F.lit(False).alias("asks")))
    to = F.when(F.col("label") == F.col("core"), to).otherwise(F.concat(to, F.transform(q, lambda j: F.struct(asking.alias("i"), j.alias("j"), F.lit(True).alias("asks")))))
    rows = with_text(large).withColumn("to", F.explode(to))
    rest = _set_edges(rows.select(F.xxhash64("root", "to.i", "to.j").alias("g"), "node", "label", "to.asks", *fps), width, seed, budget, similarity)
    return first.unionByName(rest)


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id (null last, then the smaller hash of the text); of exactly repeated rows one. All columns stay.

    Near copies have a Jaccard similarity of at least `similarity` over their sets of five-word shingles; a group is what steps between near copies lead to. Candidates are found by a trie self-join with an error budget, as near_duplicates has it, over SimHashes of the sets, of 256 bits, that differ in no more bits than texts of that similarity do, with three deviations more (bits_apart), and agree in a block (wide_links). All pairs of a component of candidates within these bits are verified by their sets, if steps do not join them anyway (verified_links). Fingerprints of 64 bits are too coarse for that: at 0.8 they differ in ten bits on average. Null and empty texts are copies of one another.
    """
    h = F.xxhash64("text")

    def f(b: pa.RecordBatch) -> dict:
        sets = [shingle_set(x, width, seed) for x in b.column("text").to_pylist()]
        fp = np.array([set_fingerprint(x) for x in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
        node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
        return {"doc_id": b.column("doc_id"), "_h": b.column("_h"), "node": pa.array(node)} | {c: pa.array(np.ascontiguousarray(fp[:, k])) for k, c in enumerate(WIDE_COLUMNS)}

    schema = "doc_id long, _h long, node long, " + ", ".join(f"{c} long" for c in WIDE_COLUMNS)
    d = stored(per_batch(docs.select("doc_id", F.col("text").cast("binary").alias("text"), h.alias("_h")), schema, f), "fingerprints")
    by_set = d.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_h")).alias("first"), *[F.first(c).alias(c) for c in WIDE_COLUMNS])
    by_set = stored(by_set, "sets")
    budget = bits_apart(similarity)
    candidates = components(wide_links(by_set.select("node", *WIDE_COLUMNS), budget)).withColumnRenamed("node", "_node")
    members = by_set.join(candidates, F.col("node") == F.col("_node")).select("node", "root", "first.*", *WIDE_COLUMNS)
    key = ["strophe no id", "strophe id", "strophe hash"]  # names with a space, so that no column of docs is lost
    docs = docs.withColumns({key[0]: F.col("doc_id").isNull(), key[1]: F.coalesce("doc_id", F.lit(0)), key[2]: h})

    def with_text(rows: DataFrame) -> DataFrame:
        texts = docs.select(F.col(key[0]).alias("no_id"), F.col(key[1]).alias("id"), F.col(key[2]).alias("_h"), F.col("text").cast("binary").alias("text"))
        return texts.join(rows.hint("merge"), ["no_id", "id", "_h"])  # the same way at every size

    roots = components(verified_links(members, with_text, width, seed, budget, similarity)).withColumnRenamed("node", "_node")
    by_root = by_set.join(roots, F.col("node") == F.col("_node"), "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = by_root.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{a}").alias(b) for a, b in zip(("no_id", "id", "_h"), key)])
    return docs.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).drop(*key)
