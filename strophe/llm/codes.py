"""Vector codes of parts: codebooks by Lloyd's rounds, where heaps tell which parts must be looked at again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import dropped, redealt, stored
from .topk import finite, whole

#: Parts of a vector, entries of each part's codebook, rounds, and the scale of components.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components count up to this size, larger ones as if they had it, so that squared distances fit in a long.
LARGEST = 2**28
#: Vectors of a block. Its heaps hold no others.
BLOCK = 4096
#: What sums of distances may be off, as floats; a part whose bounds are so near is looked at again.
_OFF = 1e-5



def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and the slack: how much further (lower) the second is than the first (upper)."""
    squares = np.stack([((x - c) ** 2).sum(1) for c in book], 1)
    best = squares.argmin(1)
    if len(book) == 1:
        return best, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(squares, 1, 1)[:, :2].astype(np.float64))
    return best, two[:, 1] - two[:, 0]


def _own(x: np.ndarray, book: np.ndarray, best: np.ndarray) -> np.ndarray:
    return ((x - book[best]) ** 2).sum(1)


class Heaps:
    """A block's parts, in one heap for each entry of each part's codebook, by slack plus the drift that the entry had piled up when the part was put in. As long as that is above the entry's drift now, no other entry can have come nearer."""

    def __init__(self, x: np.ndarray, entries: int, heaps: list[list[tuple[float, int]]] | None = None):
        self.x = x.reshape(len(x), PARTS, -1)
        self.entries = entries
        self.heaps = heaps if heaps is not None else [[] for _ in range(PARTS * entries)]
        self.scanned = 0
        #: What each entry's sum and count have gained: components, then the count.
        self.moved = np.zeros((PARTS, entries, self.x.shape[2] + 1), np.int64)

    def _gain(self, p: int, best: np.ndarray, rows: np.ndarray, sign: int) -> None:
        np.add.at(self.moved[p, :, :-1], best, sign * self.x[rows, p])
        np.add.at(self.moved[p, :, -1], best, sign)

    def fill(self, books: np.ndarray) -> None:
        """The first round: every part is compared with every entry."""
        rows = np.arange(len(self.x))
        for p in range(PARTS):
            best, slack = _nearest(self.x[:, p], books[p])
            self._gain(p, best, rows, 1)
            for e in range(self.entries):
                of = np.flatnonzero(best == e)
                self.heaps[p * self.entries + e] = h = list(zip(slack[of].tolist(), of.tolist()))
                heapify(h)
        self.scanned += PARTS * len(rows)

    def renew(self, books: np.ndarray, drift: np.ndarray) -> None:
        """A later round: parts come off their heaps while the entry's drift has used their slack up, are compared with every entry and put in anew."""
        for p in range(PARTS):
            rows, was = [], []
            for e in range(self.entries):
                h, n = self.heaps[p * self.entries + e], len(rows)
                most = drift[p, e] + _OFF
                while h and h[0][0] <= most:
                    rows.append(heappop(h)[1])
                was += [e] * (len(rows) - n)
            if not rows:
                continue
            at, old = np.array(rows), np.array(was)
            best, slack = _nearest(self.x[at, p], books[p])
            other = best != old
            self._gain(p, old[other], at[other], -1)
            self._gain(p, best[other], at[other], 1)
            for e, key, row in zip(best.tolist(), (slack + drift[p, best]).tolist(), rows):
                heappush(self.heaps[p * self.entries + e], (key, row))
            self.scanned += len(rows)

    def best(self) -> np.ndarray:
        """The entry of each part: rows by parts."""
        out = np.zeros((len(self.x), PARTS), np.int64)
        for i, h in enumerate(self.heaps):
            out[[row for _, row in h], i // self.entries] = i % self.entries
        return out


def _write(block: Heaps, ids: pa.Array, labels: pa.Array, names: list[str], kinds: list) -> pa.RecordBatch:
    n = np.array([len(h) for h in block.heaps], np.int64)
    keys = np.array([k for h in block.heaps for k, _ in h], np.float64)
    rows = np.array([r for h in block.heaps for _, r in h], np.int32)
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    cells = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (block.x.astype(np.int32), n, keys, rows, block.moved)]
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip([one(ids), one(labels), *cells], kinds)], names=names)


def _read(r: dict, entries: int) -> Heaps:
    """A block as it was written; heaps keep their order."""
    n = np.frombuffer(r["lengths"], np.int64)
    ends = np.cumsum(n)
    pairs = list(zip(np.frombuffer(r["keys"]).tolist(), np.frombuffer(r["rows"], np.int32).tolist()))
    size = len(r["vec_ids"])
    x = np.frombuffer(r["x"], np.int32).astype(np.int64).reshape(size, -1)
    return Heaps(x, entries, [pairs[e - c : e] for c, e in zip(n.tolist(), ends.tolist())])


def _kinds(schema: StructType) -> tuple[list[str], list]:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return arrow.names, list(arrow.types)


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, short ones ended by zeros."""
    lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(v), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """What all blocks' entries have gained: summed by tasks, then by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64).reshape(-1)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["cell", "gain"])

    out = np.zeros(shape, np.int64).reshape(-1)
    for cell, gain in state.select("moved").mapInArrow(add, "cell int, gain long").groupBy("cell").agg(F.sum("gain")).collect():
        out[cell] = gain
    return out.reshape(shape)


def compress(vectors: DataFrame) -> DataFrame:
    """Codes of vectors (vec_id, embedding, label): vec_id, code (the entry of each part, two hex digits each), error (squared distances to the entries, summed over parts), label_error (errors summed over equal labels), codebooks_sha256.

    Components times SCALE are cut down to whole numbers, and vectors to parts of equal lengths. A part's codebook begins as that part of the ENTRIES smallest vec_ids, equal ones in order of their components. Each of ROUNDS rounds assigns parts to nearest entries and moves entries to their parts' floored means; then parts are assigned once more. Distances are those of whole numbers, and exact.

    Vectors lie in blocks as tasks read them, none is shuffled by a key. A block keeps a heap for each entry, keyed by slack (how much further the second entry is than the own one). When entries move, an entry's drift grows by its own way and the longest way of another; only parts whose slack the drift since then has used up are compared with all entries again. What entries gain and lose is summed up by tasks and by Spark; the driver holds codebooks and sums (their size is one vector's times ENTRIES), and each round's blocks are a table in the shared folder that replaces the last one's.

    Vectors that are null or hold null or non-finite components are left out. Vectors shorter than the longest, or not of a length of whole parts, count as if zeros followed. Components beyond LARGEST count as LARGEST. If fewer than ENTRIES vectors are left, there are as many entries; if none, no rows. Null vec_ids are kept and come last. Repeated rows are rows of their own; null labels are equal. Other columns do not matter.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label").where(finite(F.col("v")))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("v"), SCALE, LARGEST).alias("v"), "label")
    schema = StructType([StructField("vec_id", LongType()), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())])
    seeds = [r[0] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(ENTRIES).collect()]
    if not seeds:
        return spark.createDataFrame([], schema)
    width = -(-kept.agg(F.max(F.size("v"))).first()[0] // PARTS)
    entries, shape = len(seeds), (PARTS, len(seeds), width + 1)
    books = _matrix(pa.array(seeds, pa.list_(pa.int64())), PARTS * width).reshape(entries, PARTS, width).transpose(1, 0, 2)
    label = vectors.schema["label"].dataType
    state_schema = StructType([StructField("vec_ids", ArrayType(LongType())), StructField("labels", ArrayType(label)), *(StructField(c, BinaryType()) for c in ("x", "lengths", "keys", "rows", "moved"))])
    names, kinds = _kinds(state_schema)

    def begin(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                s = b.slice(at, BLOCK)
                block = Heaps(_matrix(s.column("v"), PARTS * width), entries)
                block.fill(books)
                yield _write(block, s.column("vec_id"), s.column("label"), names, kinds)

    def go_on(books: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    s = b.slice(i, 1)
                    block = _read(s.to_pylist()[0], entries)
                    block.renew(books, drift)
                    yield _write(block, s.column("vec_ids").flatten(), s.column("labels").flatten(), names, kinds)

        return run

    cores = spark.sparkContext.defaultParallelism
    if kept.rdd.getNumPartitions() < cores:  # a table of fewer files than cores
        kept = kept.repartition(cores)
    state = stored(kept.mapInArrow(begin, state_schema), "heaps")
    sums, drift = _sums(state, shape), np.zeros(shape[:2])
    for _ in range(ROUNDS):
        count = sums[..., -1:]
        moved = np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), books)
        way = np.sqrt(((moved - books).astype(np.float64) ** 2).sum(2))
        far = np.sort(way, 1)
        longest = np.where(way == far[:, -1:], far[:, -2:-1] if entries > 1 else 0.0, far[:, -1:])  # of another entry
        books, drift = moved, drift + way + longest
        was, state = state, stored(state.mapInArrow(go_on(books, drift), state_schema), "heaps")
        dropped(was)
        sums = sums + _sums(state, shape)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.slice(i, 1)
                block = _read(s.to_pylist()[0], entries)
                best = block.best()
                error = sum(_own(block.x[:, p], books[p], best[:, p]) for p in range(PARTS))
                codes = [r.tobytes().hex() for r in best.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([s.column("vec_ids").flatten(), s.column("labels").flatten(), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = state.drop("moved").mapInArrow(code, StructType([StructField("vec_id", LongType()), StructField("label", label), StructField("code", StringType()), StructField("error", LongType())]))
    coded = stored(coded, "codes")
    dropped(state)
    labels = redealt(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label").withColumnRenamed("label", "_label")
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
