"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import given_back, slices

#: Tokens of a block. Windows are runs of so many blocks, one from every block on; an item is looked for with the shortest that holds it wherever it begins.
BLOCK = 8
SCALES = (2, 3, 5, 9)
#: Longest piece of an item that is looked for at once; longer items are cut into such pieces, and checked whole.
PIECE = (SCALES[-1] - 1) * BLOCK
#: Rows of the sketch, and singular vectors kept.
SKETCH, RANK = 192, 96
#: Least cosine of a candidate, as a share of what a piece alone in a window of other words has: the root of its share of the window.
COSINE = 0.6
#: Least share of a piece's tokens that a candidate has in any order: a little less than what the check asks for in order, for windows that hold not all of it.
COMMON = 0.5
#: Least share of an item's tokens, in order, that is a leak by itself; and with the answer.
VERBATIM, PARAPHRASE = 0.8, 0.6
#: Items of fewer tokens leak only as a whole, word by word: a few frequent words in order are no sign of a leak.
SHORT = 9
#: Columns that the items' words are hashed to. So the sketch has one size, whatever the benchmark.
COLUMNS = 1 << 15
#: Items that are searched for in one pass over the documents, and pieces that are compared with windows at once.
AT_ONCE, PIECES = 2000, 2048
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case, cut at ASCII signs and spaces; null: none."""
    return (text or "").lower().encode("utf-8", "replace").translate(_CUT).split()


def lcs(item: dict[bytes, int], n: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence of an item (positions of each token as the bits of a number, n tokens) and other; a row of the table is one number."""
    row = full = (1 << n) - 1
    for t in other:
        if m := item.get(t):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _positions(ts: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for k, t in enumerate(ts):
        out[t] = out.get(t, 0) | 1 << k
    return out


def answer(text: str) -> list[bytes]:
    """What stands for an item's answer, as items have no answer of their own: the last sentence, and of a long one the last eight tokens."""
    sentences = [ts for s in re.split(r"[.?!\n]+", text) if (ts := tokens(s))]
    return sentences[-1][-8:] if sentences else []


@dataclass
class Space:
    """The latent space of a corpus: the column of each word of any item, and the inverse document frequencies and latent vectors of the columns, the latter with a row of zeros for words that no item has."""

    words: dict[bytes, int]
    idf: np.ndarray
    latent: np.ndarray

    @staticmethod
    def of(words: dict[bytes, int], sketch: np.ndarray, df: np.ndarray, passages: int) -> Space:
        """From the sketch of the passages' counts (rows by columns) and the passages that hold each column: the singular vectors of the weighted sketch. They are divided by their singular values, so that what all passages of a language share does not outweigh the rest, but by no less than the median of these, so that a rare word does not either. Only columns that a word has stay, numbered in order."""
        used = np.array(sorted(set(words.values())), int)
        number = {c: k for k, c in enumerate(used.tolist())}
        idf = np.log((1 + passages) / (1 + df[used])) + 1e-3
        _, s, vt = np.linalg.svd(sketch[:, used] * idf, full_matrices=False)
        kept = s[:RANK] > 1e-6 * max(s[:1], default=0)
        basis = np.eye(len(used))[:, :RANK] if not kept.any() else vt[:RANK][kept].T / np.maximum(s[:RANK][kept], np.median(s[:RANK][kept]))
        latent = np.zeros((len(used) + 1, max(1, basis.shape[1])), np.float32)
        latent[:-1, : basis.shape[1]] = idf[:, None] * basis * (float(s[0]) if kept.any() else 1)
        return Space({t: number[c] for t, c in words.items()}, idf, latent)


class Cells:
    """Numbers with bits, looked up many at a time: a table of slots, half full at most, has their places; a slot is found by a product, or is the next free one."""

    def __init__(self, bits: dict[int, int]):
        n = len(bits)
        self.size = 1 << max(4, (2 * n).bit_length())
        self.shift = np.uint64(64 - self.size.bit_length() + 1)
        self.keys, self.values = np.array([*bits, -1], np.int64), np.array([*bits.values(), 0], np.uint64)
        self.slots = np.full(self.size, n, np.int32)  # the last place is that of no number
        for k, slot in enumerate(self._slot(self.keys[:n]).tolist()):
            while self.slots[slot] < n:
                slot = (slot + 1) % self.size
            self.slots[slot] = k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def bits_of(self, keys: np.ndarray) -> np.ndarray:
        """The bits of each key, 0 for keys that aren't there."""
        slot = self._slot(keys)
        at = self.slots[slot]
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], np.uint64(0))
        left = np.flatnonzero((have != keys) & (have >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % self.size
            at = self.slots[slot[left]]
            have = self.keys[at]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (have >= 0)]
        return out


class Items:
    """Items that are looked for together: the latent vectors of their pieces, and where in a piece a word stands."""

    def __init__(self, rows: list[tuple[int, str]], space: Space):
        self.ids, self.texts = [r[0] for r in rows], [tokens(r[1]) for r in rows]
        self.answers = [answer(r[1]) for r in rows]
        self.words, self.latent = space.words, space.latent
        self.pieces = [(n, ts[a : a + PIECE]) for n, ts in enumerate(self.texts) for a in range(0, max(1, len(ts) - PIECE // 2), PIECE // 2) if ts]
        fits = [next((k for k, w in enumerate(SCALES) if len(ts) <= (w - 1) * BLOCK + 1), len(SCALES) - 1) for _, ts in self.pieces]
        self.cosine = np.array([COSINE * min(1.0, len(ts) / (SCALES[f] * BLOCK)) ** 0.5 for (_, ts), f in zip(self.pieces, fits)])
        self.by_scale: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(SCALES)):
            own = [p for p, f in enumerate(fits) if f == k]
            q = np.array([self.latent[self.numbers(self.pieces[p][1])].sum(0) for p in own], np.float32).reshape(len(own), self.latent.shape[1])
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            self.by_scale.append((np.array(own, int), (q / self.cosine[own][:, None]).astype(np.float32)))
        # where in a piece a word stands, as bits: only the cells that are not empty, in order of piece and column; words of one column share their bits, which lets no candidate go
        cells: dict[int, int] = {}
        for k, (_, ts) in enumerate(self.pieces):
            for at, word in enumerate(self.numbers(ts)):
                cells[k * len(self.latent) + word] = cells.get(k * len(self.latent) + word, 0) | 1 << at
        self.cells = Cells(cells)
        self.bits = self.cells.values
        self.least = np.array([COMMON * len(ts) for _, ts in self.pieces])
        self.masks = [_positions(ts) for ts in self.texts]
        self.answer_masks = [_positions(ts) for ts in self.answers]

    def numbers(self, ts: list[bytes]) -> list[int]:
        get, none = self.words.get, len(self.latent) - 1
        return [get(t, none) for t in ts]

    def candidates(self, docs: list[list[bytes]]) -> dict[tuple[int, int], list[tuple[float, int, int]]]:
        """(document, item) to its windows: the cosine, and the tokens from and to which each reaches."""
        gap = SCALES[-1] - 1
        sizes = [-(-len(d) // BLOCK) + gap for d in docs]
        first = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.full((int(first[-1]) + gap, BLOCK), len(self.latent) - 1, np.int32)
        flat = ids.reshape(-1)
        for d, a in zip(docs, first.tolist()):
            flat[a * BLOCK : a * BLOCK + len(d)] = self.numbers(d)
        out: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        step = 4096
        for at in range(0, int(first[-1]), step):
            part = ids[at : at + step + gap]
            rows, more = self.latent[part[:, 0]], np.empty((len(part), self.latent.shape[1]), np.float32)
            for c in range(1, BLOCK):
                np.take(self.latent, part[:, c], axis=0, out=more, mode="clip")
                rows += more
            n = min(step, int(first[-1]) - at)
            window, width = rows[:n].copy(), 1
            for (own, q), scale in zip(self.by_scale, SCALES):
                while width < scale:
                    window += rows[width : width + n]
                    width += 1
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
                for some in range(0, len(own), PIECES):
                    dots = window @ q[some : some + PIECES].T  # q is scaled so that the threshold is 1 times the window's norm
                    w, p = np.nonzero(dots >= norm[:, None])
                    for w, p in self._plausible(part, own[some : some + PIECES], scale, w, p):
                        piece, block = own[some + p], at + w
                        doc = int(np.searchsorted(first, block, "right")) - 1
                        a = (block - int(first[doc])) * BLOCK
                        out.setdefault((doc, self.pieces[piece][0]), []).append((float(dots[w, p] / norm[w]) * self.cosine[piece], a, a + scale * BLOCK))
        return out

    def _plausible(self, part: np.ndarray, own: np.ndarray, scale: int, w: np.ndarray, p: np.ndarray, at_once: int = 1 << 15) -> Iterator[tuple[int, int]]:
        """Those windows (first block, piece) in which at least COMMON of a piece's tokens occur, in any order: fewer cannot pass the later check."""
        for a in range(0, len(w), at_once):
            blocks, pieces = w[a : a + at_once], p[a : a + at_once]
            row, n = own[pieces], len(self.latent)
            seen = np.zeros(len(blocks), np.uint64)
            for k in range(scale):
                words = part[blocks + k]
                bits = np.zeros(words.shape, np.uint64)
                some = words < n - 1  # words of no item stand in no piece
                bits[some] = self.cells.bits_of((words + (row * n)[:, None])[some])
                seen |= np.bitwise_or.reduce(bits, 1)
            fine = np.bitwise_count(seen) >= self.least[row]
            yield from zip(blocks[fine].tolist(), pieces[fine].tolist())

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int, int]]:
        """(text number, item number, cosine, common tokens, tokens of the item, common tokens of the answer) of every leak, in that order."""
        docs = [tokens(t) for t in texts]
        out = []
        for (d, k), windows in sorted(self.candidates(docs).items()):
            n = len(self.texts[k])
            if n > PIECE:  # a long item is met by its pieces; stretches of about its length are tried all along
                reach = n + n // 4 + BLOCK
                start, end = max(0, min(w[1] for w in windows) - n // 2), max(w[2] for w in windows) + n // 2
                tried = {(at, at + reach) for at in range(start, max(start + 1, end - reach + 1 + BLOCK), BLOCK)}
            else:  # a window, and a block more on either side for what a paraphrase puts in
                tried = {(max(0, a - BLOCK), b + BLOCK) for _, a, b in windows}
            if n < SHORT:
                whole = b" " + b" ".join(self.texts[k]) + b" "
                if any(whole in b" " + b" ".join(docs[d][a:b]) + b" " for a, b in tried):
                    out.append((d, k, max(w[0] for w in windows), n, n, len(self.answers[k])))
                continue
            best = (False, 0, 0)  # whether a stretch is a leak by itself, then the most common tokens, then the answer's
            for a, b in sorted(tried):
                common = lcs(self.masks[k], n, docs[d][a:b])
                if common >= PARAPHRASE * n and (common > best[1] or not best[0]):
                    found = lcs(self.answer_masks[k], len(self.answers[k]), docs[d][a:b])
                    best = max(best, (common >= VERBATIM * n or found >= 0.75 * len(self.answers[k]), common, found))
                if best[1] == n:
                    break
            if best[0]:
                out.append((d, k, max(w[0] for w in windows), best[1], n, best[2]))
        return out


def _sketch(words: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of the sketch: every passage (40 tokens) is added, with a sign, to one of the rows; both are drawn from the document's id and the passage's number. The row SKETCH counts passages by column, and SKETCH + 1 passages. Counts are whole numbers, so the order of adding does not matter. Only rows and columns that are not empty leave the task."""
    from pyspark import TaskContext

    d, size = COLUMNS, 40
    total = np.zeros((SKETCH + 2) * (d + 1), np.int32)
    get = words.get
    for b in batches:
        for part in slices(b):
            docs = [[get(t, d) for t in tokens(x)] for x in part.column("text").to_pylist()]
            counts = np.array([-(-len(x) // size) for x in docs], np.int64)
            if not counts.sum():
                continue
            ids = np.full((int(counts.sum()), size), d, np.int64)
            row = 0
            for x, n in zip(docs, counts.tolist()):
                ids[row : row + n].reshape(-1)[: len(x)] = x
                row += n
            doc = np.repeat(np.array([x or 0 for x in part.column("doc_id").to_pylist()], np.int64), counts).astype(np.uint64)
            number = (np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
            h = (doc * np.uint64(0x9E3779B97F4A7C15) + number * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            to = (h % np.uint64(SKETCH)).astype(np.int64) * (d + 1)
            sign = np.where(h >> np.uint64(63), 1, -1).astype(np.int32)
            hit = ids < d
            np.add.at(total, (to[:, None] + ids)[hit], np.repeat(sign, hit.sum(1)))
            ids.sort(axis=1)
            new = np.concatenate((np.ones((len(ids), 1), bool), ids[:, 1:] != ids[:, :-1]), 1) & (ids < d)
            np.add.at(total, SKETCH * (d + 1) + ids[new], 1)
            total[(SKETCH + 1) * (d + 1)] += len(ids)
    rows = total.reshape(SKETCH + 2, d + 1)
    some = [(k, c := np.flatnonzero(r).astype(np.int32), r[c]) for k, r in enumerate(rows) if r.any()]
    if some:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * len(some), pa.int32()), pa.array([c.tobytes() for _, c, _ in some], pa.binary()), pa.array([v.astype(np.int64).tobytes() for _, _, v in some], pa.binary())], names=["row", "part", "at", "counts"])


def _added(group: pa.Table) -> pa.Table:
    total = np.zeros(COLUMNS + 1, np.int64)
    for at, counts in zip(group.column("at").to_pylist(), group.column("counts").to_pylist()):
        total[np.frombuffer(at, np.int32)] += np.frombuffer(counts, np.int64)
    at = np.flatnonzero(total).astype(np.int32)
    return pa.table({"row": group.column("row")[:1], "part": group.column("part")[:1], "at": pa.array([at.tobytes()], pa.binary()), "counts": pa.array([total[at].tobytes()], pa.binary())})


def column(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % COLUMNS


def fitted(docs: DataFrame, benchmark: DataFrame) -> Space:
    """The latent space of docs for a whole benchmark: the right singular vectors of the TF-IDF matrix of all passages.

    The decomposition is randomised: the rows of the matrix are added up, with random signs, to SKETCH rows, whose Gram matrix is that of all passages in expectation; the singular vectors are those of these few rows. Weights of words are factors of columns, so counts are sketched and weighted later, in one pass. Only words of the items have columns, as no other can make a passage more like an item; they are hashed to COLUMNS, so a task's sketch has one size, whatever the documents and the benchmark. The tasks' sketches are added in two steps; the driver gets one, and the items' words.
    """
    words = {t: column(t) for block in item_blocks(benchmark) for _, text in block for t in tokens(text)}
    schema = "row int, part int, at binary, counts binary"
    parts = docs.select("doc_id", "text").mapInArrow(lambda it: _sketch(words, it), schema)
    summed = parts.groupBy("row", "part").applyInArrow(_added, schema).groupBy("row").applyInArrow(_added, schema).collect()
    counts = np.zeros((SKETCH + 2, COLUMNS + 1))
    for r in summed:
        counts[r["row"], np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.int64)
    return Space.of(words, counts[:SKETCH, :COLUMNS], counts[SKETCH, :COLUMNS], int(counts[SKETCH + 1, 0]))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, at most AT_ONCE at a time, in the order of their ids; items without a word (null texts too) cannot leak and are left out."""
    block: list[tuple[int, str]] = []
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if tokens(r.text):
            block.append((r.item_id, r.text))
        if len(block) == AT_ONCE:
            yield block
            block = []
    if block:
        yield block


LEAKS = "doc_id long, item_id long, cosine double, n_common int, n_item int, n_answer int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs and each item that it leaks: doc_id, item_id, cosine (the candidate's best), n_common (tokens of the longest common subsequence), n_item (tokens of the item) and n_answer (common tokens of its answer).

    Windows of every document, whatever its length, are compared with the items in latent space; what comes near is checked by the longest common subsequence: a leak has, in one stretch, 0.8 of an item's tokens in order, or 0.6 of them and 0.75 of its answer's; of items under nine tokens, all of them without a gap. The benchmark is a stated query set: one pass makes the latent space for all of it, then it is searched for in blocks of at most AT_ONCE items, with a pass each. Windows are compared in the one space, so results do not hang on the blocks.

    Null and empty texts leak nothing; items without a word are never leaked; a null doc_id or item_id stays null. Repeated rows and repeated items give repeated results. Empty tables give none. Other columns do not matter.
    """
    out = None
    space = None
    for block in item_blocks(benchmark):
        space = space or fitted(docs, benchmark)
        items = Items(block, space)

        def search(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, 256):
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[d], items.ids[k], cos, common, n, ans) for d, k, cos, common, n, ans in items.leaks(part.column("text").to_pylist())]
                    if found:
                        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[f.split()[0] for f in LEAKS.split(", ")])

        one = docs.select("doc_id", "text").mapInArrow(search, LEAKS)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak an item (leaks); all columns stay. The blocks' filters follow one another in one pass, in the space of all of docs."""
    space, whole = None, docs
    for block in item_blocks(benchmark):
        space = space or fitted(whole, benchmark)
        items = Items(block, space)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in slices(b, 256):
                    bad = {x[0] for x in items.leaks(part.column("text").to_pylist())}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)]))
            given_back()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
