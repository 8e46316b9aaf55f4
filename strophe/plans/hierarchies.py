"""Measures of segmentations on several levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hierarchies as H
from ..sources import adapters as A
from .registry import query


def _grid(spark, d):
    return A.grid(spark, d).withColumnRenamed("seq_id", "item")


def _labels(spark, d):
    codes = A.sequences(spark, d).groupBy("sym_name").agg(F.min("sym").alias("code"))
    b = H.beatwise_labels(A.hierarchy(spark, d), _grid(spark, d), "")
    return b.join(codes, F.col("label") == F.col("sym_name"), "left").select("item", "level", "pos", F.coalesce("code", F.lit(-1)).alias("label"))


@query('SELECT item, level, seg, "start", "end", label FROM hier')
def segment_levels(spark, d):
    return A.hierarchy(spark, d)


@query("SELECT item, level, pos, label FROM lab")
def beatwise_labels(spark, d):
    return _labels(spark, d)


_MONO = """sp AS (SELECT item, level, min("start") AS a, max("end") AS b FROM hier GROUP BY ALL), ct AS (SELECT DISTINCT h.item, sp.level, h."start" AS t FROM hier h JOIN sp ON sp.item = h.item AND h.level <= sp.level AND h."start" >= sp.a AND h."start" < sp.b),
pc AS (SELECT *, lead(t) OVER (PARTITION BY item, level ORDER BY t) AS nx FROM ct), mono AS (SELECT p.item, p.level, p.t AS "start", least(h."end", coalesce(nx, h."end")) AS "end", label FROM pc p JOIN hier h ON h.item = p.item AND h.level = p.level AND h."start" <= p.t AND p.t < h."end")"""


@query(f'WITH {_MONO} SELECT item, level, (row_number() OVER (PARTITION BY item, level ORDER BY "start") - 1)::INT AS seg, "start", "end", label FROM mono')
def make_monotonic(spark, d):
    return H.make_monotonic(A.hierarchy(spark, d))


_MONOTONE = """bs AS (SELECT item, level, "start" AS t FROM {0} UNION SELECT item, level, "end" FROM {0}), lv AS (SELECT item, max(level) AS m FROM {0} GROUP BY 1),
lost AS (SELECT DISTINCT bs.item FROM bs JOIN lv ON lv.item = bs.item AND level < m ANTI JOIN bs n ON n.item = bs.item AND n.level = bs.level + 1 AND n.t = bs.t)"""


@query("WITH " + _MONOTONE.format("hier") + " SELECT lv.item, lost.item IS NULL AS monotonic FROM lv LEFT JOIN lost ON lost.item = lv.item")
def monotonicity(spark, d):
    return H.monotonicity(A.hierarchy(spark, d))


_RECALL = """x AS (SELECT l.item, l.level, l.label, u.label AS above, count(*) AS n FROM {0} l JOIN {0} u ON u.item = l.item AND u.level = l.level - 1 AND u.pos = l.pos GROUP BY ALL),
g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM x GROUP BY ALL), r AS (SELECT item, level, sum(same) / nullif(sum(n * (n - 1) / 2), 0) AS r FROM g GROUP BY ALL)
SELECT item, round(CASE WHEN count(r) = count(*) THEN avg(r) END, 6) AS recall FROM r GROUP BY item"""


@query("WITH " + _RECALL.format("lab"))
def label_monotonicity(spark, d):
    return H.pairwise_recall(_labels(spark, d)).withColumn("recall", F.round("recall", 6))


@query("""WITH own AS (SELECT g.seq_id AS item, l.level, g.pos, coalesce((SELECT max(h.seg) FROM hier h WHERE h.item = g.seq_id AND h.level = l.level AND h."start" <= g.t), -1) AS label FROM grid g CROSS JOIN (SELECT unnest([0, 1, 2]) AS level) l), """ + _RECALL.format("own"))
def interval_monotonicity(spark, d):
    return H.interval_monotonicity(A.hierarchy(spark, d), _grid(spark, d)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_MONO}, mn AS (SELECT *, row_number() OVER (PARTITION BY item, level ORDER BY "start") AS seg FROM mono),
ch AS (SELECT p.item, p.level, p.seg, p.label, string_agg(c.label, '|' ORDER BY c."start") AS parts FROM mn p JOIN mn c ON c.item = p.item AND c.level = p.level + 1 AND c."start" >= p."start" AND c."start" < p."end" GROUP BY ALL),
k AS (SELECT item, level, label, parts, count(*) AS n FROM ch WHERE parts <> label GROUP BY ALL), g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM k GROUP BY ALL)
SELECT item, round(avg(CASE WHEN n = 1 THEN 1 ELSE same / (n * (n - 1) / 2) END), 6) AS transitivity FROM g GROUP BY item""")
def transitivity_strict(spark, d):
    return H.transitivity_strict(H.make_monotonic(A.hierarchy(spark, d))).withColumn("transitivity", F.round("transitivity", 6))


@query("SELECT item, round(avg(coalesce((n - u) / nullif(n - 1, 0), 1)), 6) AS repetitiveness FROM (SELECT item, level, count(*) AS n, count(DISTINCT label) AS u FROM hier GROUP BY ALL) GROUP BY item")
def repetitiveness(spark, d):
    return H.repetitiveness(A.hierarchy(spark, d)).withColumn("repetitiveness", F.round("repetitiveness", 6))


@query("SELECT item, round(count(*) / count(DISTINCT level), 6) AS complexity FROM hier GROUP BY item")
def complexity(spark, d):
    return H.complexity(A.hierarchy(spark, d)).withColumn("complexity", F.round("complexity", 6))


@query("""SELECT item, round(avg("end" - "start") / nullif(max("end") - min("start"), 0), 6) AS simplicity FROM hier GROUP BY item""")
def simplicity(spark, d):
    return H.simplicity(A.hierarchy(spark, d)).withColumn("simplicity", F.round("simplicity", 6))


@query(f"WITH {_MONO}, a AS (SELECT item, count(*) AS n FROM hier GROUP BY 1), b AS (SELECT item, count(*) AS m FROM mono GROUP BY 1) SELECT a.item, round(n / m, 6) AS treeness FROM a JOIN b ON a.item = b.item")
def treeness(spark, d):
    return H.treeness(A.hierarchy(spark, d)).withColumn("treeness", F.round("treeness", 6))


@query("""WITH g AS (SELECT item, level, label || coalesce('|' || lead(label) OVER w, '') AS gram, lead(label) OVER w AS f, count(*) OVER (PARTITION BY item, level) AS n FROM hier WINDOW w AS (PARTITION BY item, level ORDER BY "start")),
e AS (SELECT item, level, entropy(gram) AS e FROM g WHERE f IS NOT NULL OR n < 2 GROUP BY ALL) SELECT item, round(avg(s), 6) + 0.0 AS salience FROM (SELECT item, e - lag(e) OVER (PARTITION BY item ORDER BY level) AS s FROM e) GROUP BY item""")
def salience(spark, d):
    return H.salience(A.hierarchy(spark, d)).withColumn("salience", F.round("salience", 6) + 0.0)


_TARGET = """rel AS (SELECT h.item, level, "start" - t0 AS "start", "end" - t0 AS "end", label FROM hier h JOIN (SELECT seq_id, min(t) - 1000 AS t0 FROM seq GROUP BY 1) z ON z.seq_id = h.item), tg AS (SELECT item, 20.0 * 86400 AS target FROM rel GROUP BY 1)"""


def _relative(spark, d):
    z = A.sequences(spark, d).groupBy(F.col("seq_id").alias("item")).agg((F.min("t") - 1000).alias("t0"))
    h = A.hierarchy(spark, d).join(z, "item")
    return h.select("item", "level", "seg", (F.col("start") - F.col("t0")).alias("start"), (F.col("end") - F.col("t0")).alias("end"), "label")


@query(f"""WITH {_TARGET}, c AS (SELECT rel.item, level, "start", least("end", target) AS "end", label FROM rel JOIN tg ON tg.item = rel.item WHERE "start" < target), s AS (SELECT rel.item, level, any_value(target) AS target, min("start") AS a, max("end") AS b FROM rel JOIN tg ON tg.item = rel.item GROUP BY ALL),
u AS (SELECT * FROM c UNION ALL SELECT item, level, 0, least(a, target), '-1' FROM s WHERE a > 0 UNION ALL SELECT item, level, b, target, '-1' FROM s WHERE b < target)
SELECT item, level, (row_number() OVER (PARTITION BY item, level ORDER BY "start") - 1)::INT AS seg, round("start", 3) AS "start", round("end", 3) AS "end", label FROM u""")
def adjust_start_end(spark, d):
    items = A.table(spark, d, "events").select(F.col("user_id").alias("item")).distinct()
    x = H.adjust_start_end(_relative(spark, d), items.withColumn("target", F.lit(20.0 * 86400)))
    return x.withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


@query("""WITH f AS (SELECT *, coalesce((label <> lag(label) OVER (PARTITION BY item, level ORDER BY "start"))::INT, 0) AS n FROM hier), g AS (SELECT *, sum(n) OVER (PARTITION BY item, level ORDER BY "start") AS g FROM f)
SELECT item, level, (row_number() OVER (PARTITION BY item, level ORDER BY min("start")) - 1)::INT AS seg, min("start") AS "start", max("end") AS "end", any_value(label) AS label FROM g GROUP BY item, level, g""")
def simplify(spark, d):
    return H.simplify(A.hierarchy(spark, d))


_MEETS = "m{0} AS (SELECT a.item, a.pos AS i, b.pos AS j, max(a.level) AS meet FROM {1} a JOIN {1} b ON a.item = b.item AND a.level = b.level AND a.label = b.label AND a.pos < b.pos WHERE a.level > 0 GROUP BY ALL), t{0} AS (SELECT m.item, m.i, m.j, p.pos AS k FROM m{0} m JOIN (SELECT DISTINCT item, pos FROM {1}) p ON p.item = m.item AND p.pos <> m.i LEFT JOIN m{0} o ON o.item = m.item AND o.i = m.i AND o.j = p.pos WHERE m.meet > coalesce(o.meet, 0))"
_EST = "est AS (SELECT seq_id AS item, 0 AS level, pos, 0 AS label FROM grid UNION ALL SELECT seq_id, 1, pos, (pos // 4) % 3 FROM grid UNION ALL SELECT seq_id, 2, pos, pos // 2 FROM grid)"


@query("WITH " + _MEETS.format("", "lab") + " SELECT item, i, j, count(*) AS n FROM t GROUP BY ALL")
def meet_triples(spark, d):
    return H.meet_counts(_labels(spark, d))


@query("WITH " + _EST + ", " + _MEETS.format("a", "lab") + ", " + _MEETS.format("b", "est") + """, it AS (SELECT DISTINCT item FROM lab), na AS (SELECT item, count(*) AS n FROM ta GROUP BY 1), nb AS (SELECT item, count(*) AS n FROM tb GROUP BY 1), nc AS (SELECT ta.item, count(*) AS n FROM ta SEMI JOIN tb ON ta.item = tb.item AND ta.i = tb.i AND ta.j = tb.j AND ta.k = tb.k GROUP BY 1),
pr AS (SELECT it.item, coalesce(nc.n, 0) / nullif(nb.n, 0) AS p, coalesce(nc.n, 0) / nullif(na.n, 0) AS r FROM it LEFT JOIN na ON na.item = it.item LEFT JOIN nb ON nb.item = it.item LEFT JOIN nc ON nc.item = it.item)
SELECT item, round(coalesce(p, 0), 6) AS p, round(coalesce(r, 0), 6) AS r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS l FROM pr""")
def lmeasure(spark, d):
    g = _grid(spark, d)
    p = F.col("pos")
    est = g.select("item", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.lit(0).alias("label")), F.struct(F.lit(1).alias("level"), (F.floor(p / 4) % 3).cast("int").alias("label")), F.struct(F.lit(2).alias("level"), F.floor(p / 2).cast("int").alias("label")))).alias("x"), "pos").select("item", "x.level", "pos", "x.label")
    x = H.lmeasure(_labels(spark, d), est)
    return x.select("item", *[F.round(c, 6).alias(c) for c in "prl"])


@query("SELECT l.item, l.level, l.label, u.label AS above, count(*) AS n FROM lab l JOIN lab u ON u.item = l.item AND u.level = l.level - 1 AND u.pos = l.pos GROUP BY ALL")
def label_overlap(spark, d):
    return H.label_overlap(_labels(spark, d))


@query("""WITH b AS (SELECT item, pos, label FROM lab WHERE level = 2), m AS (SELECT l.item, l.level, l.label, round(avg(b.label), 9) AS m FROM lab l JOIN b ON b.item = l.item AND b.pos = l.pos WHERE l.level < 2 GROUP BY ALL), k AS (SELECT *, (dense_rank() OVER (PARTITION BY item, level ORDER BY m) - 1)::INT AS new FROM m)
SELECT l.item, l.level, l.pos, new AS label FROM lab l JOIN k ON k.item = l.item AND k.level = l.level AND k.label = l.label UNION ALL SELECT item, level, pos, label FROM lab WHERE level = 2""")
def content_labels(spark, d):
    return H.content_labels(_labels(spark, d))
