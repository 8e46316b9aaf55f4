"""Values over time and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as E
from ..sources import adapters as A
from .registry import query


@query("SELECT grp, version, round(value / avg(value) OVER (PARTITION BY grp), 6) AS value FROM dated")
def relative_by_song(spark, d):
    return E.relative(A.dated(spark, d)).select("grp", "version", F.round("value", 6).alias("value"))


@query("SELECT date::VARCHAR AS date, round(avg(value), 7) AS value FROM dated GROUP BY 1")
def merge_by_date(spark, d):
    return E.average_same_dates(A.dated(spark, d)).select(F.col("date").cast("string").alias("date"), F.round("value", 7).alias("value"))


@query("SELECT grp, version, round(CASE WHEN count(*) OVER w = 30 THEN avg(value) OVER w END, 4) AS mean FROM dated WINDOW w AS (PARTITION BY grp ORDER BY date, version ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def running_mean_by_date(spark, d):
    return E.running_mean_by_date(A.dated(spark, d), 30).select("grp", "version", F.round("mean", 4).alias("mean"))


@query("""WITH c AS (SELECT year(date)::INT AS year, grp, count(*) AS n FROM dated GROUP BY ALL), s AS (SELECT y::INT AS year, grp FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM c) CROSS JOIN (SELECT DISTINCT grp FROM c))
SELECT s.year, s.grp, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (PARTITION BY s.year ORDER BY s.grp))::BIGINT AS cum FROM s LEFT JOIN c ON c.year = s.year AND c.grp = s.grp""")
def year_counts(spark, d):
    return E.year_counts(A.dated(spark, d))


@query("SELECT year(date)::INT AS year, grp, round(count(*) / sum(count(*)) OVER (PARTITION BY year(date)), 6) AS share FROM dated GROUP BY year(date), grp")
def year_share(spark, d):
    return E.year_share(A.dated(spark, d)).withColumn("share", F.round("share", 6))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def nested_lookup(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", E.nested(e, "props", "k").cast("int").alias("k"))


@query("SELECT item, param1, param2, method, round(avg(p), 9) AS p, round(avg(r), 9) AS r, round(avg(l), 9) AS l FROM result GROUP BY ALL")
def avg_over_refs(spark, d):
    x = E.avg_over_refs(A.results(spark, d))
    return x.select("item", "param1", "param2", "method", *[F.round(c, 9).alias(c) for c in "prl"])


@query("SELECT item, ref, param1, param2, method, p, r, l FROM (SELECT *, row_number() OVER (PARTITION BY item, ref ORDER BY l DESC, param1, param2, method) AS k FROM result) WHERE k = 1")
def best_per_group(spark, d):
    return E.best_per_group(A.results(spark, d), ["item", "ref"], "l", ["param1", "param2", "method"])


@query("SELECT i.item, p.param1, p.param2, m.method, m.ref FROM (SELECT DISTINCT item FROM result) i CROSS JOIN (SELECT DISTINCT param1, param2 FROM result) p CROSS JOIN (SELECT a.method, b.ref FROM (SELECT DISTINCT method FROM result) a CROSS JOIN (SELECT DISTINCT ref FROM result) b) m ANTI JOIN (SELECT * FROM result WHERE l > 0.35) r ON r.item = i.item AND r.param1 = p.param1 AND r.param2 = p.param2 AND r.method = m.method AND r.ref = m.ref")
def missing_runs(spark, d):
    r = A.results(spark, d)
    wanted = r.select("item").distinct().crossJoin(r.select("param1", "param2").distinct()).crossJoin(r.select("method").distinct()).crossJoin(r.select("ref").distinct())
    return E.missing_runs(wanted, r.where("l > 0.35"), ["item", "param1", "param2", "method", "ref"])


@query("""WITH m AS (SELECT item, avg(l) FILTER (method = 'A') AS x, avg(l) FILTER (method = 'N') AS y FROM result GROUP BY 1) SELECT item, round(x - y, 9) + 0.0 AS diff FROM m WHERE x IS NOT NULL AND y IS NOT NULL ORDER BY round(x - y, 9), item LIMIT 25""")
def method_diff_worst25(spark, d):
    x = E.method_diff(A.results(spark, d), "A", "N").withColumn("diff", F.round("diff", 9) + 0.0)
    return x.orderBy("diff", "item").limit(25)


@query("SELECT method, round(quantile_cont(l, 0.0), 6) AS q0, round(quantile_cont(l, 0.25), 6) AS q1, round(quantile_cont(l, 0.5), 6) AS q2, round(quantile_cont(l, 0.75), 6) AS q3, round(quantile_cont(l, 1.0), 6) AS q4 FROM result GROUP BY method")
def quartiles_by_group(spark, d):
    x = E.quartiles(A.results(spark, d), "method", "l")
    return x.select("method", *[F.round(f"q{k}", 6).alias(f"q{k}") for k in range(5)])


@query("""WITH m AS (SELECT item, method, max(l) AS l FROM (SELECT item, ref, method, max(l) AS l FROM result GROUP BY ALL) GROUP BY ALL) SELECT method, count(*) AS n, round(avg(l), 6) AS l FROM m GROUP BY method""")
def method_log(spark, d):
    r = A.results(spark, d).groupBy("item", "ref", "method").agg(F.max("l").alias("l")).groupBy("item", "method").agg(F.max("l").alias("l"))
    return r.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("l"))


def _curve(spark, d):
    x = E.relative(A.dated(spark, d))
    return x.select("grp", F.datediff("date", F.lit("1992-01-01")).cast("double").alias("x"), F.col("value").alias("y"))


@query()
def lowess(spark, d):
    return E.lowess(_curve(spark, d), "grp").withColumn("y", F.round("y", 6))


@query()
def lowess_loo_band(spark, d):
    x = E.lowess_loo_band(_curve(spark, d), "grp")
    return x.select("x", *[F.round(c, 6).alias(c) for c in ("y", "lo", "hi")])
