"""Encoding, windows and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequences as S
from ..operators import tiles as T
from ..sources import adapters as A
from .registry import query


@query("SELECT seq_id, pos, sym FROM seq")
def dict_encode(spark, d):
    return A.sequences(spark, d).select("seq_id", "pos", "sym")


@query("""SELECT seq_id, pos, "start", CASE WHEN isinf("end") THEN -1 ELSE "end" END AS "end" FROM iv""")
def intervals_from_points(spark, d):
    x = S.intervals_from_points(A.grid(spark, d))
    return x.select("seq_id", "pos", "start", F.when(F.col("end") == S.INF, -1.0).otherwise(F.col("end")).alias("end"))


@query("""
WITH f AS (SELECT seq_id, pos, t AS s, lead(t, 1, 'inf'::DOUBLE) OVER (PARTITION BY seq_id ORDER BY pos) AS e, sym AS value FROM seq),
x AS (SELECT iv.seq_id, iv.pos, value, row_number() OVER (PARTITION BY iv.seq_id, iv.pos ORDER BY least("end", e) - greatest("start", s) DESC, s) AS n FROM iv JOIN f ON iv.seq_id = f.seq_id AND s < "end" AND "start" < e)
SELECT seq_id, pos, value FROM x WHERE n = 1""")
def grid_summarize(spark, d):
    f = A.sequences(spark, d).select("seq_id", "pos", "t", F.col("sym").alias("value"))
    return S.grid_summarize(f, A.grid(spark, d))


@query("""
WITH w AS (SELECT seq_id, (pos // 3)::INT AS pos, sym, count(*) AS n FROM seq GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY seq_id, pos) AS total FROM w)
SELECT seq_id, pos, arg_min(sym, (-n, sym)) AS sym FROM m WHERE total = 3 GROUP BY seq_id, pos""")
def downsample_mode(spark, d):
    return S.downsample_mode(A.sequences(spark, d), 3)


@query("""
WITH s AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS step FROM grid WINDOW w AS (PARTITION BY seq_id ORDER BY pos))
SELECT seq_id, 2 * pos AS pos, round(t, 3) AS t FROM s UNION ALL SELECT seq_id, 2 * pos + 1, round(t + step / 2, 3) FROM s WHERE step IS NOT NULL""")
def interpolate_grid(spark, d):
    return S.interpolate_grid(A.grid(spark, d)).select("seq_id", "pos", F.round("t", 3).alias("t"))


@query("""SELECT seq_id, pos, round(CASE WHEN count(*) OVER w = 4 THEN avg(sym) OVER w END, 6) AS value FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def running_mean(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", F.col("sym").cast("double").alias("value"))
    return S.running_mean(s, 4).withColumn("value", F.round("value", 6))


@query("""SELECT seq_id, pos, CASE WHEN count(*) OVER w = 5 THEN quantile_cont(sym::DOUBLE, 0.5) OVER w ELSE sym END AS value FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def median_filter(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", F.col("sym").cast("double").alias("value"))
    return S.median_filter(s, 2)


@query("""SELECT seq_id, pos, round(CASE WHEN count(*) OVER w = 5 THEN avg(sym) OVER w ELSE sym END, 6) AS value FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def mean_filter(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", F.col("sym").cast("double").alias("value"))
    return S.mean_filter(s, 2).withColumn("value", F.round("value", 6))


@query("""
WITH v AS (SELECT seq_id, pos FROM seq WHERE sym_name = 'view'), g AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY pos)::INT AS grp FROM (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) > 3)::INT, 0) AS n FROM v))
SELECT seq_id, grp, min(pos) AS first, max(pos) AS last, count(*) AS n FROM g GROUP BY seq_id, grp""")
def group_adjacent(spark, d):
    return S.group_adjacent(A.sequences(spark, d).where("sym_name = 'view'"), ["seq_id"], "pos", 3)


@query("""SELECT seq_id, pos, sum(n) OVER (PARTITION BY seq_id ORDER BY pos)::INT AS run FROM (SELECT *, coalesce((sym <> lag(sym) OVER (PARTITION BY seq_id ORDER BY pos))::INT, 0) AS n FROM seq)""")
def relabel_adjacent(spark, d):
    return S.relabel_adjacent(A.sequences(spark, d))


@query("""SELECT seq_id, pos FROM (SELECT *, lead(sym) OVER w AS b, lead(sym, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE sym = 0 AND b = 4 AND c = 0""")
def subarray_search(spark, d):
    return S.subarray_search(A.sequences(spark, d), [0, 4, 0])


@query("""SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1)::INT AS ord, sym FROM (SELECT seq_id, sym, min(pos) AS pos FROM seq GROUP BY ALL)""")
def ordered_unique(spark, d):
    return S.ordered_unique(A.sequences(spark, d))


@query("""
WITH c AS (SELECT seq_id, sym, count(*) AS n FROM seq GROUP BY ALL), m AS (SELECT *, rank() OVER (PARTITION BY seq_id ORDER BY n DESC) AS k FROM c)
SELECT seq_id, CASE WHEN count(*) > 1 THEN -1 ELSE min(sym) END AS sym FROM m WHERE k = 1 GROUP BY seq_id""")
def mode_strict(spark, d):
    return S.mode(A.sequences(spark, d), ["seq_id"], "sym", strict=True)


@query("""
WITH s AS (SELECT label, max(i) + 1 AS n FROM ssm GROUP BY label), p AS (SELECT *, greatest(n // 8, 1) AS parts FROM s), q AS (SELECT *, n // parts AS short, n % parts AS longer FROM p),
c AS (SELECT ssm.label, v, CASE WHEN i < longer * (short + 1) THEN i // (short + 1) ELSE longer + (i - longer * (short + 1)) // short END::INT AS bi, CASE WHEN j < longer * (short + 1) THEN j // (short + 1) ELSE longer + (j - longer * (short + 1)) // short END::INT AS bj FROM ssm JOIN q ON ssm.label = q.label)
SELECT label, bi, bj, round(avg(v), 6) AS v FROM c GROUP BY label, bi, bj""")
def block_summarize(spark, d):
    return T.block_means(A.features(spark, d), "label", 8).withColumn("v", F.round("v", 6))
