"""Nearest neighbours by counting collisions of single projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Projections; the share of them in whose windows a vector must be to be verified; half a window's width at radius 1.
PROJECTIONS = 48
SHARE = 0.58
HALF = 1.0
#: Virtual rehashing: how much a radius is wider than the last.
GROWTH = 1.1
#: The search also ends when this share of the vectors is verified; in any case so many are.
BETA, ENOUGH = 0.4, 1000
#: Vectors of an index shard, and queries that are sent to a shard together, at most.
SHARD, QUERIES = 16384, 65536
_APART = 1e6  # projections of scaled vectors are much smaller, so lines laid end to end stay in order


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, and some component other than zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over the power of two above their largest component: exact, in order of products as before, and with finite squares."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max(initial=0.0))[1]))


class Index:
    """Some vectors, and for each projection their values in order (values) and whose they are (order). The lines of all projections are laid end to end, so that the ends of all windows are found in one search.

    Inner products become distances by one more component, the root of what the square of the largest norm has over a vector's: then a query's distances order vectors as its inner products do.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, values: np.ndarray | None = None, order: np.ndarray | None = None, start: float | None = None, seed: int = 11):
        self.ids, self.x, self.unit = ids, x, scaled(x)
        squares = np.einsum("ij,ij->i", self.unit, self.unit)
        self.longest = float(np.sqrt(squares.max(initial=0.0)))
        self.lines = np.random.default_rng(seed).normal(size=(x.shape[1] + 1, PROJECTIONS))
        self.offset = np.arange(PROJECTIONS) * _APART
        if values is None:
            more = np.sqrt(np.maximum(self.longest**2 - squares, 0))
            p = (self.unit @ self.lines[:-1] + more[:, None] * self.lines[-1]).T
            order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
            values = np.take_along_axis(p, order, 1) + self.offset[:, None]
        self.values, self.order = values.reshape(-1), order.reshape(-1)
        self.start = self._start() if start is None else start

    def _start(self) -> float:
        """The radius at which searches begin: where some of the vectors themselves have, at the median, three quarters of BETA in enough windows."""
        sample = self.unit[:: max(1, len(self.unit) // 7)]
        sample = sample * (self.longest / np.sqrt(np.einsum("ij,ij->i", sample, sample)))[:, None]
        a, b = 0.0, 4 * self.longest + 1e-12
        for _ in range(12):
            r = (a + b) / 2
            shares = []
            for q in sample:
                counts = np.zeros(len(self.ids), np.int32)
                self._widen(q @ self.lines[:-1] + self.offset, r, None, counts)
                shares.append((counts >= SHARE * PROJECTIONS).mean())
            a, b = (r, b) if np.median(shares) < 0.75 * BETA else (a, r)
        return b

    def _widen(self, at: np.ndarray, radius: float, was: tuple[np.ndarray, np.ndarray] | None, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Moves the windows' ends out to the radius, counts the vectors that they newly hold, and gives the ends. A vector enters a projection's window once, so all of a query's work is at most a pass over the lines."""
        n, w = len(self.ids), HALF * radius
        lo = np.maximum(np.searchsorted(self.values, at - w, "left"), np.arange(PROJECTIONS) * n)
        hi = np.minimum(np.searchsorted(self.values, at + w, "right"), np.arange(1, PROJECTIONS + 1) * n)
        hi = np.maximum(lo, hi)
        if was is None:
            parts = [self.order[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        else:
            lo, hi = np.minimum(lo, was[0]), np.maximum(hi, was[1])
            parts = [self.order[a:b] for a, b in zip(lo.tolist() + was[1].tolist(), was[0].tolist() + hi.tolist())]
        counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
        return lo, hi

    def search(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k largest inner products with a query among vectors whose id is not `own`, as (rows, products), ties to the smaller id.

        Windows around the query's projections grow from radius to radius. A vector that is in the windows of SHARE of all projections is verified by its inner product. The search ends at the first radius at which k vectors, and ENOUGH, are verified and either the best k are nearer than the radius, or BETA of all are verified. If the windows come to hold everything, everything is verified, so k are found if there are k.
        """
        q = scaled(query)
        q = q * (self.longest / np.sqrt(q @ q))  # of the longest vector's norm, which changes no order
        at = q @ self.lines[:-1] + self.offset
        n, least = len(self.ids), SHARE * PROJECTIONS
        counts, done = np.zeros(n, np.int32), np.zeros(n, bool)
        rows, dots = np.empty(0, np.int64), np.empty(0)
        base, radius, ends = self.longest**2 + q @ q, self.start, None
        while True:
            ends = self._widen(at, radius, ends, counts)
            everything = int((ends[1] - ends[0]).sum()) == n * PROJECTIONS
            fresh = np.flatnonzero(((counts >= least) | everything) & ~done)
            if len(fresh):
                done[fresh] = True
                if own is not None:
                    fresh = fresh[self.ids[fresh] != own]
                rows = np.concatenate((rows, fresh))
                dots = np.concatenate((dots, self.unit[fresh] @ q))
            if everything:
                break
            if len(rows) >= max(k, ENOUGH):
                kth = -np.partition(-dots, k - 1)[k - 1]
                if base - 2 * kth <= radius**2 or len(rows) >= k + BETA * n:
                    break
            radius *= GROWTH
        if len(rows) > k:  # what could still be among the k when the products are added up in order
            rows = rows[dots >= -np.partition(-dots, k - 1)[k - 1] - 1e-9 * self.longest * np.sqrt(q @ q)]
        products = np.zeros(len(rows))
        with np.errstate(over="ignore", invalid="ignore"):
            for c in range(len(query)):  # one component after another, so that equal vectors have equal products
                products += self.x[rows, c] * query[c]
        best = np.lexsort((self.ids[rows], -products))[:k]
        return rows[best], products[best]


INDEX = "size int, part int, ids binary, times binary, x binary, line_values binary, line_order binary, start double"
BLOCK = "size int, block int, ids binary, times binary, x binary"


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, times and vectors of a group, in order of ids and components."""
    ids, times = (t.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "times"))
    x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], times[order], x[order]


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]


def _indexed(t: pa.Table) -> pa.Table:
    ids, times, x = _rows(t)
    index = Index(ids, x)
    keys = [t.column(c)[:1].cast(pa.int32()).combine_chunks() for c in ("size", "part")]
    return pa.Table.from_arrays([*keys, *_binary(ids, times, x, index.values, index.order), pa.array([index.start])], names=[c.split()[0] for c in INDEX.split(", ")])


def _packed(t: pa.Table) -> pa.Table:
    keys = [t.column(c)[:1].cast(pa.int32()).combine_chunks() for c in ("size", "block")]
    return pa.Table.from_arrays([*keys, *_binary(*_rows(t))], names=[c.split()[0] for c in BLOCK.split(", ")])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For each row of queries (vec_id, embedding) its k nearest of vectors (vec_id, embedding) by inner product in double precision, rows with the query's own vec_id left out: query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id.

    Vectors are dealt by hash into shards of about SHARD; each shard's index is built once and stored. Queries are dealt into blocks; every block meets every shard, which answers with its own k, and the best k of all remain. The score is computed on the original vectors, so the answer differs from the exact one only where no shard's search has looked at a vector: recall is measured in the tests.

    Vectors that are null or zero, or hold null or non-finite components, take no part, and neither do null ids. A vector meets those of its own length only. If there are fewer than k others, all are given. Equal vectors collide alike and are verified together, so ties are exact among them. Equal rows are indexed once and count as often as they are there, so repeated rows of vectors are answers of their own, and repeated query rows give repeated answers, of which the first k of a query's id stay. Empty tables give none. Other columns do not matter.
    """
    spark = vectors.sparkSession

    def clean(d: DataFrame) -> DataFrame:
        d = d.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
        return stored(d.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("size", F.size("v")), "vectors")

    v, q = clean(vectors), clean(queries)
    number = lambda d, most, name: d.groupBy("size").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    shards = number(v, SHARD, "parts")
    # more and smaller blocks only if there are too few shards for all cores; what a query finds does not hang on its block
    least = -(-2 * spark.sparkContext.defaultParallelism // max(1, shards.agg(F.sum("parts")).first()[0] or 1))
    blocks = number(q, QUERIES, "blocks").select("size", F.greatest("blocks", F.lit(least)).alias("blocks"))
    dealt = lambda d, n, of, name: d.join(n, "size").withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.col(of)).cast("int"))
    index = stored(dealt(v, shards, "parts", "part").groupBy("size", "part").applyInArrow(_indexed, INDEX), "index")
    asked = stored(dealt(q, blocks, "blocks", "block").groupBy("size", "block").applyInArrow(_packed, BLOCK), "queries")
    key = ["size", "part", "block"]
    # a stated query set against all rows, in blocks: a block is repeated for each shard, and no row of one meets a row of the other before the shard's search
    left = index.join(blocks, "size").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = asked.join(shards, "size").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if a.num_rows and b.num_rows:
            s, r = a.to_pylist()[0], b.to_pylist()[0]
            ids, q_ids = np.frombuffer(s["ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            shard = Index(ids, np.frombuffer(s["x"]).reshape(len(ids), -1), np.frombuffer(s["line_values"]), np.frombuffer(s["line_order"], np.int32), s["start"])
            times = np.frombuffer(s["times"], np.int64)
            for qid, n, vector in zip(q_ids.tolist(), np.frombuffer(r["times"], np.int64).tolist(), np.frombuffer(r["x"]).reshape(len(q_ids), -1)):
                rows, products = shard.search(vector, qid, k)
                for c, x in zip(out, (np.full(len(rows), qid), ids[rows], products, np.minimum(times[rows] * n, k))):
                    c.append(x)
        types = (np.int64, np.int64, np.float64, np.int64)
        return pa.table(dict(zip(("query_id", "vec_id", "score", "times"), (pa.array(np.concatenate(c) if c else np.empty(0, t), pa.from_numpy_dtype(t)) for c, t in zip(out, types)))))

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score double, times long")
    found = found.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
