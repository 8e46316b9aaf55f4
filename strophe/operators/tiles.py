"""Similarities of all positions of series, worked out tile by tile: a task has some rows of a matrix and meets the other positions batch by batch, so neither a matrix nor a series is ever in one place, and what only needs a row's cells takes them where they come up."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Rows of a stripe, and columns of a tile. What is sent is, for every bunch of stripes, the other side once.
ROWS, COLUMNS = 1024, 256
#: How often the other side of a long series is sent at least, and most stripes of a bunch, to which it is sent once.
SENT, BUNCH = 8, 64
#: Rows of a tile that are worked out together.
NEAR = 64
#: Columns of numbers that a position can bring along.
NUMBERS = ("num_a", "num_b")
#: Cells of a batch that a task gives on.
CELLS = 1 << 18


class Vectors:
    """Vectors as rows of a matrix (padded with zeros), with their positions, lengths (-1: null, or with a null component), norms and two numbers each."""

    def __init__(self, pos, x, length, a, b):
        self.pos, self.x, self.length, self.a, self.b = pos, x, length, a, b
        square = np.zeros(len(x))
        for k in range(x.shape[1]):
            square += x[:, k] * x[:, k]
        self.norm = np.sqrt(square)

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Vectors:
        c = {n: batch.column(n) for n in ("pos", "vec", *NUMBERS)}
        v = c["vec"]
        length = np.where(v.is_valid().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy()), 0)
        flat = v.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        x = np.zeros((len(v), int(length.max(initial=0))))
        row = np.repeat(np.arange(len(v)), length)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        x[row, at] = np.where(bad, 0.0, flat.to_numpy(zero_copy_only=False)) if len(flat) else 0.0
        length = np.where(v.is_valid().to_numpy(zero_copy_only=False), length, -1)
        length[row[bad]] = -1
        return cls(c["pos"].to_numpy(), x, length, *[c[n].to_numpy(zero_copy_only=False).astype(float) for n in NUMBERS])

    @classmethod
    def joined(cls, some: list[Vectors]) -> Vectors:
        wide = max(v.x.shape[1] for v in some)
        x = np.concatenate([np.pad(v.x, ((0, 0), (0, wide - v.x.shape[1]))) for v in some])
        return cls(*[np.concatenate([getattr(v, n) for v in some]) if n else x for n in ("pos", "", "length", "a", "b")])

    def cut(self, start: int, stop: int) -> Vectors:
        return Vectors(self.pos[start:stop], self.x[start:stop], self.length[start:stop], self.a[start:stop], self.b[start:stop])


def cosines(x: Vectors, y: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The cosine similarities of all pairs, 0 where a vector has no length, and which are null. Products are summed up in the order of components, so equal vectors have equal similarities to the last bit."""
    v = np.zeros((len(x.pos), len(y.pos)))
    xs, ys = np.ascontiguousarray(x.x.T), np.ascontiguousarray(y.x.T)
    for s in range(0, len(v), NEAR):  # what two arrays of a tile's part take stays in a core's cache
        own = v[s : s + NEAR]
        part = np.empty_like(own)
        for k in range(min(len(xs), len(ys))):
            np.multiply(xs[k][s : s + NEAR, None], ys[k][None, :], out=part)
            own += part
    n = x.norm[:, None] * y.norm[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        v /= n
    v[n == 0] = 0.0
    null = (x.length[:, None] < 0) | (y.length[None, :] < 0) | ((x.length[:, None] != y.length[None, :]) & (n != 0))
    return v, null


class Stripe:
    """Some rows of a matrix (key, number, rows: Vectors, sorted by position), and its tiles from left to right: (columns: Vectors, values, nulls)."""

    def __init__(self, key: tuple, own: np.ndarray, rows: Vectors, columns: Iterator[Vectors], width: int):
        self.key, self.own, self.rows, self.columns, self.width = key, own, rows, columns, width

    def tiles(self) -> Iterator[tuple[Vectors, np.ndarray, np.ndarray]]:
        for many in self.columns:
            for at in range(0, len(many.pos), self.width):
                some = many.cut(at, at + self.width)
                yield (some, *cosines(self.rows, some))

    def around(self, before: int, after: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int, bool, bool]]:
        """Tiles with columns of their neighbours: (positions, values, nulls, start, stop, whether nothing was before, whether nothing follows); every column is once within start and stop, with `before` columns before and `after` behind it, as far as there are such."""
        held, done, first = None, 0, True
        for at, v, null in self.tiles():
            new = (at.pos, v, null)
            held = new if held is None else tuple(np.concatenate(x, axis=-1) for x in zip(held, new))
            ready = len(held[0]) - after
            if ready > done:
                yield (*held, done, ready, first, False)
                cut = max(0, ready - before)
                first = first and not cut
                held, done = tuple(x[..., cut:] for x in held), ready - cut
        if held is not None:
            yield (*held, done, len(held[0]), first, True)


def _stretches(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, int, int, Vectors]]:
    for b in batches:
        if not b.num_rows:
            continue
        heads = [b.column(k) for k in range(n_keys + 2)]
        new = np.zeros(b.num_rows, bool)
        for h in heads:
            h = h.to_numpy(zero_copy_only=False)
            new[1:] |= h[1:] != h[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            *key, stripe, side = (h[s].as_py() for h in heads)
            yield tuple(key), stripe, side, Vectors.of(b.slice(s, e - s))


def stripes(left: DataFrame, right: DataFrame, keys: list[str], f: Callable[[Stripe], Iterator[list]], columns: str, halo: tuple[int, int] = (0, 0), low: int | None = None, high: int | None = None, size: int | None = None) -> DataFrame:
    """Applies f to every stripe of the matrices between the series left and right (keys, pos, vec, and numbers num_a and num_b): (keys, columns). f gives columns of values for the stripe. halo: how many rows before and after its own a stripe has. low, high: columns that lie further than that before a stripe's first or behind its last row are left out. size: how many rows a stripe has."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    def whole(df: DataFrame) -> DataFrame:
        return df.select(*keys, "pos", "vec", *[(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c) for c in NUMBERS])

    spark = left.sparkSession
    left, right = whole(left), whole(right)
    size, width = size or ROWS, COLUMNS
    # stripes are sent the other side in bunches, so many that a series has some SENT of these, and no more than BUNCH in one
    bunches = left.groupBy(*keys).agg(F.greatest(F.lit(1), F.least(F.lit(BUNCH), F.floor((F.max("pos") / size + 1) / SENT))).cast("long").alias("bunch"))
    left = left.join(bunches, keys)
    at = lambda shift: F.floor((F.col("pos") + shift) / (F.col("bunch") * size)).cast("int")
    mine = left.withColumn("stripe", F.explode(F.sequence(at(-halo[1]), at(halo[0]))) if any(halo) else at(0))
    numbers = left.select(*keys, "bunch", at(0).alias("stripe")).distinct()
    others = right.join(numbers, keys)
    if low is not None:
        others = others.where(F.col("pos") >= F.col("stripe") * F.col("bunch") * size - low)
    if high is not None:
        others = others.where(F.col("pos") < (F.col("stripe") + 1) * F.col("bunch") * size + high)
    order = [*keys, "bunch", "stripe", "side", "pos", "vec", *NUMBERS]
    sides = mine.withColumn("side", F.lit(0)).select(*order).unionByName(others.withColumn("side", F.lit(1)).select(*order))
    for k in keys:
        sides = sides.where(F.col(k).isNotNull())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = sides.repartition(tasks, *keys, "stripe").sortWithinPartitions(*order[: len(keys) + 4])
    schema = StructType([left.schema[k] for k in keys] + list(StructType.fromDDL(columns)))
    out, n_keys = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ((*key, bunch), number), some in groupby(_stretches(batches, n_keys + 1), lambda s: s[:2]):
            rows: list[Vectors] = []
            first = None
            for _, _, side, v in some:
                if side:
                    first = v
                    break
                rows.append(v)
            if not rows or first is None:
                continue
            all_ = Vectors.joined(rows)
            columns_ = (s[3] for s in chain([(0, 0, 1, first)], some))
            for cols in _bunch(tuple(key), all_, columns_, number, bunch, f, size, width, halo, low, high):
                cols = [c if isinstance(c, pa.Array) else np.asarray(c) for c in cols]
                for s in range(0, len(cols[0]), CELLS):
                    part = [c[s : s + CELLS] for c in cols]
                    n = len(part[0])
                    own = [pa.array([k], out.field(x).type).take(pa.array(np.zeros(n, np.int32))) for x, k in enumerate(key)]
                    yield pa.RecordBatch.from_arrays(own + [c if isinstance(c, pa.Array) else pa.array(c, out.field(n_keys + x).type) for x, c in enumerate(part)], schema=out)

    return dealt.mapInArrow(run, schema)


def _bunch(key: tuple, rows: Vectors, columns: Iterator[Vectors], number: int, bunch: int, f: Callable[[Stripe], Iterator[list]], size: int, width: int, halo: tuple[int, int], low: int | None, high: int | None) -> Iterator[list]:
    """What f gives for each stripe of a bunch. The columns come once; if there are several stripes, they are kept in a file of the task."""
    numbers = [n for n in np.unique(rows.pos // size).tolist() if n // bunch == number]
    if bunch == 1:
        yield from f(Stripe(key, rows.pos // size == number, rows, columns, width))
        return
    with tempfile.TemporaryFile() as file:
        many = 0
        for v in columns:
            for x in (v.pos, v.x, v.length, v.a, v.b):
                np.save(file, x)
            many += 1

        def again(start: float, stop: float) -> Iterator[Vectors]:
            file.seek(0)
            for _ in range(many):
                v = Vectors(*[np.load(file) for _ in range(5)])
                a, b = np.searchsorted(v.pos, [start, stop])
                if a < b:
                    yield v.cut(a, b)

        for n in numbers:
            a, b = np.searchsorted(rows.pos, [n * size - halo[0], (n + 1) * size + halo[1]])
            own = rows.cut(a, b)
            some = again(-np.inf if low is None else n * size - low, np.inf if high is None else (n + 1) * size + high)
            yield from f(Stripe(key, own.pos // size == n, own, some, width))


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded as Spark's round does: halves of the shortest decimal away from zero."""
    size = np.abs(v) * 10.0**digits
    whole = np.floor(size)
    part = size - whole
    out = np.copysign(np.where(part >= 0.5, whole + 1, whole) / 10.0**digits, v)
    for at in np.argwhere(np.abs(part - 0.5) < 1e-4 * max(1.0, 10.0 ** (digits - 9))):
        x = tuple(at)
        out[x] = float(Decimal(repr(float(v[x]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def flat(stripe: Stripe, at: Vectors, keep: np.ndarray | None, *values: np.ndarray) -> list[np.ndarray]:
    """The columns i, j and values of a tile's cells, those to keep."""
    if keep is None:
        i, j = np.repeat(stripe.rows.pos, len(at.pos)), np.tile(at.pos, len(stripe.rows.pos))
        return [i, j, *[v.ravel() for v in values]]
    r, c = np.nonzero(keep)
    return [stripe.rows.pos[r], at.pos[c], *[v[r, c] for v in values]]


def similarities(left: DataFrame, right: DataFrame, keys: list[str], upper: bool = False, within: int | None = None, digits: int | None = None) -> DataFrame:
    """The cosine similarities (keys, i, j, v) of all positions of two series; upper: only those with j >= i; within: only those with i and j no further apart; digits: rounded to so many, as Spark's round does, which takes a decimal number for each."""

    def cells(stripe: Stripe) -> Iterator[list]:
        for at, v, null in stripe.tiles():
            far = at.pos[None, :] - stripe.rows.pos[:, None]
            keep = far >= 0 if upper else None
            if within is not None:
                keep = (np.abs(far) <= within) & (True if keep is None else keep)
            i, j, v, null = flat(stripe, at, keep, v, null)
            v = v if digits is None else half_up(v, digits)
            yield [i, j, pa.array(v, pa.float64(), mask=null) if null.any() else v]

    return stripes(left, right, keys, cells, "i int, j int, v double", low=0 if upper else within, high=within)


def per_matrix(feat: DataFrame, key: str, f: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """Applies f to the whole matrix of a series, with nulls as not-a-number; it gives rows for the columns after the key. A series is one task's work, but only its vectors are sent; cells are worked out where they are needed."""

    def run(stripe: Stripe) -> Iterator[list]:
        n = int(stripe.rows.pos.max()) + 1
        m = np.zeros((n, n))
        for at, v, null in stripe.tiles():
            m[np.ix_(stripe.rows.pos, at.pos)] = np.where(null, np.nan, v)
        rows = f(m)
        if rows:
            yield list(zip(*rows))

    return stripes(feat, feat, [key], run, columns, size=1 << 30)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], rank: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """The cells (keys, i, j, v) of each row that rank highest, as many as the row's num_a, ties to the smaller j. rank(i, j, similarities, nulls) gives what they rank by, and which take part (None: all)."""

    def best(stripe: Stripe) -> Iterator[list]:
        want = np.nan_to_num(stripe.rows.a).astype(int)
        bar, pool = np.full(len(want), -np.inf), []
        full = want <= 0
        held, room = 0, 3 * int(want.sum()) + 4 * ROWS * COLUMNS

        def fewer() -> list:
            r, j, v = (np.concatenate(x) for x in zip(*pool))
            o = np.lexsort((j, -v, r))
            r, j, v = r[o], j[o], v[o]
            starts = np.searchsorted(r, np.arange(len(want) + 1))
            place = np.arange(len(r)) - starts[r]
            keep = place < want[r]
            last = place == want[r] - 1
            bar[r[last]] = v[last]
            full[r[last]] = True
            return [(r[keep], j[keep], v[keep])]

        for at, v, null in stripe.tiles():
            v, part = rank(stripe.rows.pos[:, None], at.pos[None, :], v, null)
            take = ((v > bar[:, None]) | ~full[:, None]) & (want > 0)[:, None]
            r, c = np.nonzero(take if part is None else take & part)
            pool.append((r, at.pos[c], v[r, c]))
            held += len(r)
            if held > room:
                pool = fewer()
                held = len(pool[0][0])
        if pool:
            r, j, v = fewer()[0]
            yield [stripe.rows.pos[r], j, v]

    return stripes(left, right, keys, best, "i int, j int, v double")


def by_similarity(i: np.ndarray, j: np.ndarray, v: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, None]:
    """Falling similarities, as Spark sorts them: not-a-number first, null last."""
    return np.where(null, -np.inf, np.where(np.isnan(v), np.inf, v)), None


def _apart(row: np.ndarray, j: np.ndarray, v: np.ndarray, distance: int) -> np.ndarray:
    """Of peaks, by row and then j, which stay if the greatest is taken first (on ties the later), and each only if it is `distance` from those taken: in rounds, what beats all that are near and left stays, and what is near it goes."""
    kept, left = np.zeros(len(row), bool), np.arange(len(row))
    while len(left):
        r, at, x = row[left], j[left], v[left]
        close = [(s, (r[s:] == r[:-s]) & (at[s:] - at[:-s] < distance)) for s in range(1, min(distance, len(left)))]
        beaten = np.zeros(len(left), bool)
        for s, near in close:
            beaten[:-s] |= near & (x[s:] >= x[:-s])
            beaten[s:] |= near & (x[s:] < x[:-s])
        gone = ~beaten
        for s, near in close:
            gone[:-s] |= near & ~beaten[s:]
            gone[s:] |= near & ~beaten[:-s]
        kept[left[~beaten]] = True
        left = left[~gone]
    return kept


def peaks(left: DataFrame, right: DataFrame, keys: list[str], height: float, distance: int = 1) -> DataFrame:
    """Local maxima (keys, i, j) of rows that reach the height: runs of equal values with smaller ones on both sides, at their middle (the earlier of two). Of those nearer than `distance` the greater stays, on ties the later: the greatest first, each if it is far enough from those that stay."""

    def found(stripe: Stripe) -> Iterator[list]:
        n = len(stripe.rows.pos)
        before, value, begun = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int64)  # each row's last two runs
        all_ = []
        for at, v, null in stripe.tiles():
            v = np.where(null, np.nan, v)
            r, c = np.nonzero(v != np.concatenate([value[:, None], v[:, :-1]], 1))
            own = np.arange(n)
            row = np.concatenate([own, own, r])
            val = np.concatenate([before, value, v[r, c]])
            start = np.concatenate([begun, begun, at.pos[c]])
            o = np.argsort(row, kind="stable")
            row, val, start = row[o], val[o], start[o]
            mid = np.flatnonzero((row[:-2] == row[2:]) & (val[:-2] < val[1:-1]) & (val[2:] < val[1:-1]) & (val[1:-1] >= height)) + 1
            all_.append((row[mid], (start[mid] + start[mid + 1] - 1) // 2, val[mid]))
            last = np.searchsorted(row, own, "right") - 1
            before, value, begun = val[last - 1], val[last], start[last]
        row, j, v = (np.concatenate(x) for x in zip(*all_))
        if distance > 1:
            o = np.lexsort((j, row))
            o = o[_apart(row[o], j[o], v[o], distance)]
            row, j = row[o], j[o]
        yield [stripe.rows.pos[row], j]

    return stripes(left, right, keys, found, "i int, j int")


def _scaled(v: np.ndarray, null: np.ndarray, at: Vectors) -> np.ndarray:
    """Values scaled to 0 to 1 by their column's least and greatest (a, b), rounded to nine digits; 0 where these are one."""
    wide = at.b - at.a
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (v - at.a[None, :]) / wide[None, :]
    x[:, ~(wide != 0)] = 0.0
    x[null | np.isnan(x)] = 0.0
    return half_up(x, 9)


#: Steps of a billionth that a first count puts together.
STEPS = 1 << 15


def above_percentile(left: DataFrame, right: DataFrame, keys: list[str], percent: float) -> DataFrame:
    """Cells (keys, i, j) whose value, scaled to 0 to 1 by column, reaches the percentile of all. Scaled values are billionths, so their percentile comes from exact counts: first of STEPS at a time, then of single ones where the percentile lies. No cell is shuffled."""

    def extent(stripe: Stripe) -> Iterator[list]:
        n = len(stripe.rows.pos)
        lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
        for _, v, null in stripe.tiles():
            lo, hi = np.minimum(lo, np.where(null, np.inf, v).min(1)), np.maximum(hi, np.where(null, -np.inf, v).max(1))
        yield [stripe.rows.pos, lo, hi]

    def counted(stripe: Stripe) -> Iterator[list]:
        counts = np.zeros(10**9 // STEPS + 1, np.int64)
        for at, v, null in stripe.tiles():
            counts += np.bincount(np.rint(_scaled(v, null, at) * 1e9).astype(np.int64).ravel() // STEPS, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield [some, counts[some]]

    def near(stripe: Stripe) -> Iterator[list]:
        lo, hi = int(stripe.rows.a[0]), int(stripe.rows.b[0])  # the steps in which the values beside the percentile lie
        counts: dict[int, int] = {}
        for at, v, null in stripe.tiles():
            x = np.rint(_scaled(v, null, at) * 1e9).astype(np.int64)
            some, n = np.unique(x[(x // STEPS == lo) | (x // STEPS == hi)], return_counts=True)
            for value, k in zip(some.tolist(), n.tolist()):
                counts[value] = counts.get(value, 0) + k
        yield [np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))]

    def reaching(stripe: Stripe) -> Iterator[list]:
        cut = stripe.rows.a[0]
        for at, v, null in stripe.tiles():
            yield flat(stripe, at, _scaled(v, null, at) >= cut)

    def at_rank(counts: DataFrame, value: str, *ranks: str) -> DataFrame:
        """For each key the values at ranks (from 0) that it has as columns; counts are few, as values are steps."""
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = counts.withColumn("upto", F.sum("n").over(w))
        return c.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > F.col(r), F.struct(F.col(value).alias("x"), (F.col("upto") - F.col("n")).alias("below")))).alias(r) for r in ranks])

    # a column's extent is that of the other series' row
    ends = stored(stripes(right, left, keys, extent, "pos int, num_a double, num_b double"), "extents")
    right = right.select(*keys, "pos", "vec").join(ends, [*keys, "pos"])
    rough = stored(stripes(left, right, keys, counted, "step int, n long").groupBy(*keys, "step").agg(F.sum("n").alias("n")), "steps")
    place = rough.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, ((F.col("n") - 1) * (percent / 100)).alias("place"))
    place = place.select(*keys, "place", F.floor("place").alias("low"), F.ceil("place").alias("high"))
    found = at_rank(rough.join(place, keys), "step", "low", "high").select(*keys, F.col("low.x").alias("num_a"), F.col("high.x").alias("num_b"), F.col("low.below").alias("under"), F.col("high.below").alias("over"))
    found = stored(found, "places")
    fine = stripes(left.select(*keys, "pos", "vec").join(found, keys), right, keys, near, "value long, n long").groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    # ranks within the counted steps: of the low one's step, and of the high one's, which come right behind it
    ranks = place.join(found, keys).select(*keys, "place", (F.col("low") - F.col("under")).alias("low"), (F.col("high") - F.col("under")).alias("high"))
    two = at_rank(fine.join(ranks, keys), "value", "low", "high").select(*keys, (F.col("low.x") / 1e9).alias("x"), (F.col("high.x") / 1e9).alias("y"))
    part = F.col("place") - F.col("low")
    cut = place.join(two, keys).select(*keys, F.round(F.when(F.col("low") == F.col("high"), F.col("x")).otherwise((F.col("high") - F.col("place")) * F.col("x") + part * F.col("y")), 9).alias("num_a"))
    return stripes(left.select(*keys, "pos", "vec").join(stored(cut, "cuts"), keys), right, keys, reaching, "i int, j int")


def _shifted(v: np.ndarray, x: int, y: int, h: int, w: int) -> np.ndarray:
    """The values x rows below and y columns right of each place at which h by w of them lie within."""
    return v[x : len(v) - h + 1 + x, y : v.shape[1] - w + 1 + y]


def _windows(feat: DataFrame, key: str, h: int, w: int, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """What f makes of a series' full matrix where h by w cells lie wholly within: (key, i, j, v), by the upper left; f gives values and which are null."""

    def run(stripe: Stripe) -> Iterator[list]:
        for pos, v, null, _, stop, _, last in stripe.around(w - 1, 0):
            if len(v) < h or v.shape[1] < w:
                continue
            out, gone = f(v, null)
            rows = np.flatnonzero(stripe.own[: len(out)])
            out, gone = out[rows].ravel(), gone[rows].ravel()
            at = pos[: v.shape[1] - w + 1]
            yield [np.repeat(stripe.rows.pos[rows], len(at)), np.tile(at, len(rows)), pa.array(out, pa.float64(), mask=gone)]

    return stripes(feat, feat, [key], run, "i int, j int, v double", halo=(0, h - 1))


def convolved(feat: DataFrame, key: str, kernel: list[list[float]]) -> DataFrame:
    """The convolution of a series' full matrix with a kernel, where the kernel lies wholly within: (key, i, j, v), by the upper left of what it covers."""
    h, w = len(kernel), len(kernel[0])

    def run(v: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.where(null, 0.0, v)
        out, gone = 0.0, True
        for x in range(h):
            for y in range(w):
                out = out + float(kernel[h - 1 - x][w - 1 - y]) * _shifted(v, x, y, h, w)
                gone = gone & _shifted(null, x, y, h, w)
        return out, gone

    return _windows(feat, key, h, w, run)


def diagonal_ratings(feat: DataFrame, key: str, size: int, digits: int, rating_digits: int | None = None) -> DataFrame:
    """For each block of size by size cells (key, i, j, at its upper left) of a series' full matrix, similarities being rounded and one larger: the mean of its diagonal over the mean of its other cells, 0 where that is 0; rating_digits: rounded to so many."""

    def run(v: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.where(null, 0.0, half_up(v, digits) + 1)
        block, dia, gone = 0.0, 0.0, True
        for x in range(size):
            for y in range(size):
                part = _shifted(v, x, y, size, size)
                block = block + part
                if x == y:
                    dia = dia + part
                    gone = gone & _shifted(null, x, y, size, size)
        rest = half_up((block - dia) / (size * size - size), 9)
        out = np.divide(dia / size, rest, out=np.zeros_like(rest), where=rest != 0)
        return out if rating_digits is None else half_up(out, rating_digits), gone

    return _windows(feat, key, size, size, run).withColumnRenamed("v", "rating")


def entropy_fusion(feat: DataFrame, key: str, size: int = 10, resolution: int = 10) -> DataFrame:
    """A series' full matrix times the mean entropy (bits) of the windows of size by size cells around: values are quantised to `resolution` steps of the greatest (half to even, negative ones to 0), and windows beyond the edges count as the nearest ones."""

    def greatest(stripe: Stripe) -> Iterator[list]:
        yield [[max(float(np.where(null, -np.inf, v).max()) for _, v, null in stripe.tiles())]]

    def run(stripe: Stripe) -> Iterator[list]:
        top, n = stripe.rows.a[0], int(stripe.rows.b[0])
        if n < size:
            return
        own, pos = np.flatnonzero(stripe.own), stripe.rows.pos
        share = lambda c: c * np.log2(np.maximum(c, 1)) / (size * size)
        for at, v, null, start, stop, first, last in stripe.around(size - 1, size - 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                q = np.nan_to_num(np.rint(np.maximum(np.where(null, 0.0, v), 0.0) / top * resolution)).astype(int)
            e = np.log2(size * size)
            for k in range(resolution + 1):
                is_k = (q == k).astype(float)
                e = e - share(sum(_shifted(is_k, x, y, size, size) for x in range(size) for y in range(size)))
            e = np.pad(e, (((size - 1) * int(pos[0] == 0), (size - 1) * int(pos[-1] == n - 1)), ((size - 1) * first, (size - 1) * last)), mode="edge")
            mean = sum(_shifted(e, x, y, size, size) for x in range(size) for y in range(size)) / (size * size)
            up, left = (0 if pos[0] == 0 else size - 1), (0 if first else size - 1)  # where the first mean belongs
            part = np.ix_(own, np.arange(start, stop))
            out = v[part] * mean[np.ix_(own - up, np.arange(start, stop) - left)]
            yield [np.repeat(pos[own], stop - start), np.tile(at[start:stop], len(own)), pa.array(out.ravel(), pa.float64(), mask=null[part].ravel())]

    tops = stored(stripes(feat, feat, [key], greatest, "top double"), "greatest").groupBy(key).agg(F.max("top").alias("num_a"))
    n = feat.groupBy(key).agg((F.max("pos") + 1).alias("num_b"))
    return stripes(feat.select(key, "pos", "vec").join(tops, key).join(n, key), feat, [key], run, "i int, j int, v double", halo=(size - 1, size - 1))


def time_lag_median(feat: DataFrame, key: str, radius: int) -> DataFrame:
    """The part j >= i of a series' matrix with each value replaced by the median of the 2 * radius + 1 values around it on its diagonal; beyond the ends are zeros."""
    n = 2 * radius + 1

    def run(stripe: Stripe) -> Iterator[list]:
        own = np.flatnonzero(stripe.own)
        above, below = max(0, radius - int(own[0])), max(0, radius - (len(stripe.own) - 1 - int(own[-1])))
        for pos, v, null, start, stop, _, _ in stripe.around(radius, radius):
            v = np.pad(np.where(null, 0.0, v), ((above, below), (max(0, radius - start), max(0, radius - (len(pos) - stop)))))
            r, c = int(own[0]) + above, start + max(0, radius - start)
            parts = [v[r + k : r + k + len(own), c + k : c + k + stop - start] for k in range(-radius, radius + 1)]
            for turn in range(n):  # neighbours change places until all are in order
                for k in range(turn % 2, n - 1, 2):
                    parts[k], parts[k + 1] = np.minimum(parts[k], parts[k + 1]), np.maximum(parts[k], parts[k + 1])
            i, j = np.nonzero(pos[None, start:stop] >= stripe.rows.pos[own][:, None])
            yield [stripe.rows.pos[own][i], pos[start:stop][j], parts[radius][i, j]]

    return stripes(feat, feat, [key], run, "i int, j int, v double", halo=(radius, radius), low=radius)


def block_means(feat: DataFrame, key: str, window: int) -> DataFrame:
    """A series' matrix by blocks: each axis is cut into floor(n / window) nearly equal parts, the first ones longer by one; (key, bi, bj, v) with the mean of a block. What is shuffled are sums of the parts of blocks in a tile."""

    def run(stripe: Stripe) -> Iterator[list]:
        n = int(stripe.rows.a[0])
        parts = max(n // window, 1)
        short, longer = divmod(n, parts)
        block = lambda x: np.where(x < longer * (short + 1), x // (short + 1), longer + (x - longer * (short + 1)) // short)
        bi = block(stripe.rows.pos.astype(np.int64))
        r = np.flatnonzero(np.diff(bi, prepend=-1))
        for at, v, null in stripe.tiles():
            bj = block(at.pos.astype(np.int64))
            c = np.flatnonzero(np.diff(bj, prepend=-1))
            s, k = [np.add.reduceat(np.add.reduceat(x, r, axis=0), c, axis=1) for x in (np.where(null, 0.0, v), (~null).astype(np.int64))]
            yield [np.repeat(bi[r], len(c)), np.tile(bj[c], len(r)), s.ravel(), k.ravel()]

    n = feat.groupBy(key).agg((F.max("pos") + 1).alias("num_a"))
    sums = stripes(feat.select(key, "pos", "vec").join(n, key), feat, [key], run, "bi int, bj int, s double, k long")
    return sums.groupBy(key, "bi", "bj").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("v"))


def largest(feat: DataFrame, key: str, n: int, least: float, digits: int) -> DataFrame:
    """Of each stripe of a series' matrix the n largest rounded cells (key, i, j, v), i < j, above `least`, ties to the smaller row and column; so a series' n largest are among them."""

    def run(stripe: Stripe) -> Iterator[list]:
        bar = least
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for at, v, null in stripe.tiles():
            keep = (at.pos[None, :] > stripe.rows.pos[:, None]) & (v > bar - 10.0**-digits) & ~null
            new = flat(stripe, at, keep, v)
            new[2] = half_up(new[2], digits)
            i, j, v = (np.concatenate(x) for x in zip(best, new))
            o = np.lexsort((j, i, -v))
            o = o[v[o] > least][:n]
            best = [i[o], j[o], v[o]]
            if len(o) == n:
                bar = max(bar, float(best[2][-1]))
        yield best

    return stripes(feat, feat, [key], run, "i int, j int, v double", low=0)
