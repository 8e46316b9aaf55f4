"""Exact top-k search by reading sorted lists, without access to single vectors before the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a shard, and queries that meet it together, at most.
SHARD, QUERIES = 32768, 65536
#: Components count up to this size, larger ones as if they had it, so that sums over 65,536 of them fit in a long.
LARGEST = 2**23
#: Lists are read in steps of a part of their length; when no more than a part of the vectors can qualify, their scores are resolved.
STEPS, FEW = 32, 64
#: Vectors of which a first k-th score is taken.
SOME = 2048


def finite(v: Column) -> Column:
    """Whether a vector is there and holds no null or non-finite component."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def whole(v: Column, factor: int, largest: int) -> Column:
    """The components of a vector of doubles times the factor, as the next smaller whole numbers between -largest and largest."""
    return F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e12)), F.lit(1e12)) * factor), F.lit(-largest)), F.lit(largest)).cast("int"))


class Lists:
    """Vectors of whole numbers, and one list for each component: the vectors in order of that component. A query reads a list from its upper end where its own component is positive, else from its lower end, so that what it reads of a list falls."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.order = np.argsort(x.T, axis=1, kind="stable") if order is None else order.astype(np.intp)
        self.values = np.take_along_axis(x.T, self.order, 1).astype(np.float64)
        self.start = 1  # the step at which queries begin, which is about where the last one could stop
        self.some = Lists(ids[:: len(ids) // SOME], x[:: len(ids) // SOME]) if len(ids) >= 4 * SOME else None

    def _read(self, q: np.ndarray, at: int, low: np.ndarray) -> np.ndarray:
        """What the first `at` entries of each list show of each vector: the sum of what they exceed `low` by."""
        n = len(self.ids)
        out = np.zeros(n)
        for side, part in ((q > 0, slice(n - at, n)), (q < 0, slice(0, at))):
            if side.any():
                shown = self.values[side, part] * q[side, None]
                shown -= low[side, None]
                out += np.bincount(self.order[side, part].ravel(), shown.ravel(), n)
        return out

    def search(self, query: np.ndarray, own: int | None, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k highest inner products with a query among vectors whose id is not `own`, as (rows, scores), highest first, ties to the smaller id; scores below `least`, of which the caller has k already, may be left out.

        Lists are read side by side. Of a vector, what lists have shown of it is known; each other list adds at most the value at which its reading stands, and at least its last value. That gives a lower and an upper bound of the score. Reading goes on until only few vectors, or the k themselves, have an upper bound that reaches the k-th lower bound, or `least`; all others are outsiders then, those that no list has shown included. Only the final scores of the few are added up from whole vectors. Where there are many vectors and no `least`, the k-th score of an even share of them is the first.
        """
        (n, m), q = self.x.shape, query.astype(np.float64)
        if least == -np.inf and self.some is not None:
            got = self.some.search(query, own, k)[1]
            least = float(got[k - 1]) if len(got) == k else least
        rows = np.arange(n)
        if n and q.any():
            ends = self.values[:, [0, -1]] * q[:, None]
            last = ends.min(1)
            # sums of floats are exact up to 2^53; beyond, bounds are wider by what they may be off
            off = 1e-12 * float(np.abs(ends).max(1).sum())
            off = off if off > 1.0 else 0.0
            few, step = max(k + 1, n // FEW), -(-n // STEPS)
            at = min(n, step * self.start)
            while True:
                stand = np.where(q > 0, self.values[:, n - at], self.values[:, at - 1]) * q
                if least > -np.inf:
                    bar = least
                else:
                    lower = self._read(q, at, last) + last.sum()
                    if own is not None:
                        lower = lower[self.ids != own]
                    bar = np.partition(lower, -k)[-k] if len(lower) >= k else -np.inf
                # what the lists have shown, as it exceeds where they stand: then the rest of the upper bound is one number
                rows = np.flatnonzero(self._read(q, at, stand) + stand.sum() >= bar - 2 * off)
                if len(rows) <= few or at == n:
                    break
                at = min(n, at + step)
            self.start = max(1, -(-at // step) - (len(rows) <= few // 4))
        if own is not None:
            rows = rows[self.ids[rows] != own]
        scores = self.x[rows].astype(np.int64) @ query.astype(np.int64)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return rows[best], scores[best]


INDEX = "size int, part int, ids binary, times binary, x binary, list_order binary"
BLOCK = "size int, block int, ids binary, times binary, x binary"
#: A block and what its queries have found in the first shard: how many each, and their ids, times and scores.
BEGUN = BLOCK + ", part int, n_found binary, found_ids binary, found_times binary, found_scores binary"
FOUND = "query_id long, vec_id long, score long, times long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, times and vectors of a group, in order of ids and components."""
    ids, times = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "times"))
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], times[order], x[order]


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _keys(t: pa.Table, *names: str) -> list[pa.Array]:
    return [t.column(c)[:1].cast(pa.int32()).combine_chunks() for c in names]


def _listed(t: pa.Table) -> pa.Table:
    ids, times, x = _rows(t)
    return pa.Table.from_arrays([*_keys(t, "size", "part"), *_binary(ids, times, x, np.argsort(x.T, axis=1, kind="stable").astype(np.int32))], names=_names(INDEX))


def _packed(t: pa.Table) -> pa.Table:
    return pa.Table.from_arrays([*_keys(t, "size", "block"), *_binary(*_rows(t))], names=_names(BLOCK))


def _shard(t: pa.Table) -> tuple[Lists, np.ndarray]:
    s = t.to_pylist()[0]
    ids = np.frombuffer(s["ids"], np.int64)
    x = np.frombuffer(s["x"], np.int32).reshape(len(ids), -1)
    return Lists(ids, x, np.frombuffer(s["list_order"], np.int32).reshape(x.shape[::-1])), np.frombuffer(s["times"], np.int64)


def _block(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    r = t.to_pylist()[0]
    ids = np.frombuffer(r["ids"], np.int64)
    return r, ids, np.frombuffer(r["x"], np.int32).reshape(len(ids), -1)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _begin(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    """A block's answers from its first shard."""
    if not (a.num_rows and b.num_rows):
        return pa.Table.from_arrays([pa.array([], pa.int32() if kind == "int" else pa.binary()) for kind in (c.split()[1] for c in BEGUN.split(", "))], names=_names(BEGUN))
    shard, times = _shard(a)
    _, ids, x = _block(b)
    got = [shard.search(v, i, k) for i, v in zip(ids.tolist(), x)]
    rows = _joined([r for r, _ in got])
    found = _binary(np.array([len(r) for r, _ in got], np.int64), shard.ids[rows], times[rows], _joined([s for _, s in got]))
    return pa.Table.from_arrays([*(b.column(c).combine_chunks() for c in _names(BLOCK)), *_keys(a, "part"), *found], names=_names(BEGUN))


def _begun(r: dict) -> list[np.ndarray]:
    return [np.frombuffer(r[c], np.int64) for c in ("n_found", "found_ids", "found_times", "found_scores")]


def _result(q: np.ndarray, v: np.ndarray, score: np.ndarray, times: np.ndarray) -> pa.Table:
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(_names(FOUND), (q, v, score, times))})


def _go_on(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    """A block's answers from another shard that reach the k-th of its first, where that had k."""
    if not (a.num_rows and b.num_rows):
        return _result(*[np.empty(0, np.int64)] * 4)
    shard, times = _shard(a)
    r, ids, x = _block(b)
    n, _, _, scores = _begun(r)
    ends, got = np.cumsum(n), []
    for i, v, c, e in zip(ids.tolist(), x, n.tolist(), ends.tolist()):
        got.append(shard.search(v, i, k, float(scores[e - 1]) if c == k else -np.inf))
    rows = _joined([r for r, _ in got])
    counts = [len(r) for r, _ in got]
    return _result(np.repeat(ids, counts), shard.ids[rows], _joined([s for _, s in got]), np.minimum(times[rows] * np.repeat(np.frombuffer(r["times"], np.int64), counts), k))


def _first(batches):
    """The answers that blocks have from their first shards, as rows."""
    for batch in batches:
        for r in batch.to_pylist():
            n, v, times, scores = _begun(r)
            q, of = (np.repeat(np.frombuffer(r[c], np.int64), n) for c in ("ids", "times"))
            yield from _result(q, v, scores, times * of).to_batches()


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: int = 256) -> DataFrame:
    """For each row of queries (vec_id, embedding) the k highest inner products with vectors (vec_id, embedding), all components times the factor as the next smaller whole numbers, rows with the query's own vec_id left out: query_id, rank (from 1), vec_id, score; highest first, ties to the smaller vec_id. The answer is exact.

    Vectors are dealt by hash into shards of about SHARD; each shard's sorted lists are made once and stored. Queries are dealt into blocks. A block reads one shard's lists first; its k-th scores there are what the others must reach, so those are read less far. Every block meets every shard, and the best k of all remain.

    Vectors that are null or hold null or non-finite components take no part, and neither do null ids; vectors of zeros and empty vectors do. Components beyond LARGEST count as LARGEST. A vector meets those of its own length only. If there are fewer than k others, all are given. Equal rows are listed once and count as often as they are there, so repeated rows of vectors are answers of their own, and repeated query rows give repeated answers, of which the first k of a query's id stay. Empty tables give none. Other columns do not matter.
    """
    spark = vectors.sparkSession

    def clean(d: DataFrame) -> DataFrame:
        d = d.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(finite(F.col("v")) & F.col("vec_id").isNotNull())
        d = d.select("vec_id", whole(F.col("v"), factor, LARGEST).alias("v"))
        return stored(d.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("size", F.size("v")), "vectors")

    v, q = clean(vectors), clean(queries)
    number = lambda d, most, name: d.groupBy("size").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    shards = number(v, SHARD, "parts")
    # more and smaller blocks only if there are too few shards for all cores; what a query finds does not hang on its block
    least = -(-2 * spark.sparkContext.defaultParallelism // max(1, shards.agg(F.sum("parts")).first()[0] or 1))
    blocks = number(q, QUERIES, "blocks").select("size", F.greatest("blocks", F.lit(least)).alias("blocks"))
    dealt = lambda d, n, of, name: d.join(n, "size").withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.col(of)).cast("int"))
    index = stored(dealt(v, shards, "parts", "part").groupBy("size", "part").applyInArrow(_listed, INDEX), "lists")
    asked = dealt(q, blocks, "blocks", "block").groupBy("size", "block").applyInArrow(_packed, BLOCK)
    key = ["size", "part", "block"]

    def meeting(left: DataFrame, right: DataFrame, f, schema: str) -> DataFrame:
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: f(a, b, k), schema)

    first = asked.join(shards, "size").withColumn("part", F.col("block") % F.col("parts")).drop("parts")
    of_part = index.join(shards, "size").join(blocks, "size").where("part < blocks")
    of_part = of_part.withColumn("block", F.explode(F.sequence(F.col("part"), F.col("blocks") - 1, F.col("parts")))).drop("parts", "blocks")
    begun = stored(meeting(of_part, first, _begin, BEGUN), "begun")
    # a stated query set against all rows, in blocks: a block is repeated for each other shard, and no row of one meets a row of the other before the shard's search
    others = begun.withColumnRenamed("part", "had").join(shards, "size").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("part <> had").drop("had", "parts")
    left = index.join(blocks, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    left = left.join(begun.select("size", "block", "part"), key, "left_anti")
    found = meeting(left, others, _go_on, FOUND).unionByName(begun.select("ids", "times", "n_found", "found_ids", "found_times", "found_scores").mapInArrow(_first, FOUND))
    found = found.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("times"), F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
