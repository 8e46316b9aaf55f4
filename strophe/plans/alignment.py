"""Alignment of real-valued series and what is measured along segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import matrices as M
from ..operators import statistics as S
from ..operators import tiles as T
from ..sources import adapters as A
from .matrices import _MUTUAL, _N, _segments, _smooth
from .registry import query

_KNN = "(SELECT k.label, i, j FROM (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v DESC, j) AS k FROM ssm) k JOIN (SELECT label, max(i) + 1 AS n FROM ssm GROUP BY 1) z ON z.label = k.label WHERE k <= 2 * ceil(sqrt(n * 0.5 - 1)))"
_SIZES = "n AS (SELECT label, count(*)::INT AS n FROM feat GROUP BY 1)"


@query(f"WITH {_SIZES}, {_smooth(f'SELECT * FROM {_KNN} WHERE j > i', 'label', 'greatest(0, -d)', 'n - d', 'n', 1)}, {_segments('label', 3, 0.5)} SELECT * FROM segs WHERE j0 - i0 >= 3")
def feature_self_align(spark, d):
    return L.self_align(A.features(spark, d), "label", 0.5, 3, 1, 1, 0.5)


_CROSS = "cr AS (SELECT p.a, p.b, x.pos AS i, y.pos AS j, list_cosine_similarity(x.vec, y.vec) AS v FROM fp p JOIN feat x ON x.label = p.a JOIN feat y ON y.label = p.b), cm AS (SELECT a, b, max(i) + 1 AS n FROM cr GROUP BY ALL), ck AS (SELECT *, row_number() OVER (PARTITION BY a, b, i ORDER BY v DESC, j) AS k FROM cr)"


@query(f"""WITH fp AS (SELECT DISTINCT label AS a, label + 1 AS b FROM feat WHERE label + 1 IN (SELECT label FROM feat)), z AS (SELECT label, count(*)::INT AS n FROM feat GROUP BY 1), n AS (SELECT a, b, x.n AS ni, y.n AS nj FROM fp JOIN z x ON x.label = a JOIN z y ON y.label = b), {_CROSS},
{_smooth('SELECT ck.a, ck.b, i, j FROM ck JOIN cm ON cm.a = ck.a AND cm.b = ck.b WHERE k <= 2 * ceil(sqrt(n * 0.5 - 1))', 'a, b', 'greatest(0, -d)', 'least(ni, nj - d)', 'n', 1)}, {_segments('a, b', 3, 0.5)} SELECT * FROM segs""")
def feature_mutual_align(spark, d):
    f = A.features(spark, d)
    labels = f.select("label").distinct()
    pairs = labels.select(F.col("label").alias("a"), (F.col("label") + 1).alias("b")).join(labels.select(F.col("label").alias("b")), "b").select("a", "b")
    return L.mutual_align(f, pairs, "label", 0.5, 3, 1, 0.5)


@query(f"WITH {_MUTUAL} SELECT a, b, i0, j0, len FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY len DESC, j0 - i0, i0) AS k FROM segs) WHERE k = 1")
def longest_segment(spark, d):
    s = A.sequences(spark, d)
    return L.longest_segment(M.mutual_align(s, S.pairings(s), 6, 2, 0.4), ["a", "b"])


@query(f"""WITH {_N}, {_smooth('SELECT * FROM cell', 'seq_id', 'greatest(0, -d)', 'n - d', 'n', 2)}, rn AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, d ORDER BY i) AS g FROM sm),
en AS (SELECT seq_id, d, g, min(i) FILTER (raw = 1) AS i0, max(i) FILTER (raw = 1) AS i1 FROM rn GROUP BY ALL), st AS (SELECT rn.seq_id, rn.d, rn.g, i0, i1, i, raw FROM rn JOIN en ON en.seq_id = rn.seq_id AND en.d = rn.d AND en.g = rn.g WHERE i BETWEEN i0 AND i1),
ho AS (SELECT *, i - row_number() OVER (PARTITION BY seq_id, d, g, raw ORDER BY i) AS h FROM st), hs AS (SELECT seq_id, d, g, i0, i1, raw, h, count(*) AS n FROM ho GROUP BY ALL)
SELECT seq_id, i0::INT AS i0, (i0 + d)::INT AS j0, (i1 - i0 + 1)::INT AS len, max(CASE WHEN raw = 0 THEN n ELSE 0 END)::BIGINT AS gap FROM hs WHERE i1 - i0 + 1 >= 5 GROUP BY seq_id, d, g, i0, i1""")
def widest_gap(spark, d):
    s = A.sequences(spark, d)
    n = M.lengths(s).select("seq_id", F.col("n").alias("ni"), F.col("n").alias("nj"))
    return L.widest_gap(M.smoothed(M.equality_cells(s), n, ["seq_id"], 2), ["seq_id"], 5)


_KERNEL = [[1.0, 0.5, 0.0], [0.0, 2.0, -1.0], [0.25, 0.0, 1.0]]
_TAPS = ", ".join(f"({x}, {y}, {_KERNEL[2 - x][2 - y]}::DOUBLE)" for x in range(3) for y in range(3))


@query(f"SELECT label, i - x AS i, j - y AS j, round(sum(v * w), 5) + 0.0 AS v FROM ssm CROSS JOIN (VALUES {_TAPS}) AS k(x, y, w) GROUP BY ALL HAVING count(*) = 9".replace("SELECT label, i - x AS i, j - y AS j", "SELECT label, (i - x)::INT AS i, (j - y)::INT AS j"))
def convolved(spark, d):
    x = T.convolved(A.features(spark, d), "label", _KERNEL)
    return x.select("label", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("v", 5) + 0.0).alias("v"))


@query("SELECT label, i, j, v FROM (SELECT label, i, j, round(v, 6) AS v, row_number() OVER (PARTITION BY label ORDER BY round(v, 6) DESC, i, j) AS k FROM ssm WHERE i < j AND round(v, 6) > 0.05) WHERE k <= 20")
def largest_cells(spark, d):
    return L.largest_cells(T.largest(A.features(spark, d), "label", 20, 0.05, 6), ["label"], 20, 0.05)


_AB = "ca AS (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM run WHERE len >= 4)), cb AS (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM run WHERE len BETWEEN 3 AND 5)), un AS (SELECT coalesce(ca.seq_id, cb.seq_id) AS seq_id, count(ca.i) AS na, count(cb.i) AS nb, count(ca.i + cb.i) AS both FROM ca FULL JOIN cb ON ca.seq_id = cb.seq_id AND ca.i = cb.i AND ca.j = cb.j GROUP BY 1)"


def _two(spark, d):
    r = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"])
    return M.segment_cells(r.where("len >= 4"), ["seq_id"]), M.segment_cells(r.where("len between 3 and 5"), ["seq_id"])


@query(f'WITH {_AB} SELECT seq_id, round((na - "both") / nullif(na, 0) * ("both" / nullif(nb, 0)), 6) + 0.0 AS noise FROM un'.replace("AS both", 'AS "both"'))
def noise_factor(spark, d):
    return L.noise_factor(*_two(spark, d), ["seq_id"]).withColumn("noise", F.round("noise", 6) + 0.0)


@query(f'WITH {_AB} SELECT seq_id, round((nb - "both") / (nb + 1) + ((na - "both") / (nb + 1)) ** 0.9, 6) AS distance FROM un'.replace("AS both", 'AS "both"'))
def target_distance(spark, d):
    return L.target_distance(*_two(spark, d), ["seq_id"]).withColumn("distance", F.round("distance", 6))


@query("""SELECT label, i, j, round(list_sort(list_concat(around, list_resize([0.0::DOUBLE], 5 - len(around), 0.0)))[3], 6) + 0.0 AS v FROM (SELECT label, i, j, list(v) OVER (PARTITION BY label, j - i ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM ssm WHERE j >= i)""")
def time_lag_median(spark, d):
    x = T.time_lag_median(A.features(spark, d), "label", 2)
    return x.withColumn("v", F.round("v", 6) + 0.0)


@query(f"WITH ps AS (SELECT DISTINCT seq_id, j0 AS pos FROM run WHERE len >= 5) SELECT c.seq_id, c.i, c.j FROM cell c ANTI JOIN ps a ON a.seq_id = c.seq_id AND a.pos = c.i ANTI JOIN ps b ON b.seq_id = c.seq_id AND b.pos = c.j")
def divide_matrix(spark, d):
    cells = M.equality_cells(A.sequences(spark, d))
    at = M.diag_segments(cells, ["seq_id"]).where("len >= 5").select("seq_id", F.col("j0").alias("pos")).distinct()
    return L.without_positions(cells, at, ["seq_id"])


@query("""WITH f AS (SELECT label, pos, unnest(range(0, 64)) AS k, unnest(vec) AS v FROM feat), s AS (SELECT label, pos, k, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) * CASE WHEN k < 32 THEN 0.7 ELSE 0.3 END AS v FROM f WINDOW w AS (PARTITION BY label, k)), l AS (SELECT label, pos, list(v ORDER BY k) AS vec FROM s GROUP BY ALL)
SELECT a.label, a.pos AS i, b.pos AS j, round(list_cosine_similarity(a.vec, b.vec), 6) AS v FROM l a JOIN l b ON a.label = b.label AND a.pos < b.pos""")
def mixed_affinity(spark, d):
    x = M.scaled(A.features(spark, d), "label")
    both = x.select("label", "pos", L.mixed([(F.slice("vec", 1, 32), 0.7), (F.slice("vec", 33, 32), 0.3)]).alias("vec"))
    return M.ssm(both, "label", upper=True, digits=6).where("i < j")


@query("""WITH f AS (SELECT label, (pos // 4)::INT AS pos, unnest(range(0, 64)) AS k, unnest(vec) AS v FROM feat) SELECT label, pos, round(sum(m * (k + 1)), 5) + 0.0 AS weight FROM (SELECT label, pos, k, avg(v) AS m FROM f GROUP BY ALL) GROUP BY ALL""")
def beat_sync(spark, d):
    f = A.features(spark, d)
    frames = f.select("label", F.col("pos").alias("frame"), "vec")
    beats = f.where("pos % 4 = 0").select("label", F.floor(F.col("pos") / 4).cast("int").alias("pos"), F.col("pos").alias("frame"))
    x = L.synced(frames, beats, "label").select("label", "pos", F.posexplode("vec").alias("k", "v"))
    return x.groupBy("label", "pos").agg((F.round(F.sum(F.col("v") * (F.col("k") + 1)), 5) + 0.0).alias("weight"))
