"""Section dictionaries and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grammars as G
from ..operators import hierarchies as H
from ..operators import kernels as K
from ..sources import adapters as A
from .hierarchies import _MONO
from .registry import query

_RULES = """rule AS (SELECT 'WORLD' AS parent, r_regionkey AS ord, r_name AS child FROM region UNION ALL SELECT r_name, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _rules(spark, d):
    r, n, s = A.table(spark, d, "region"), A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    a = r.select(F.lit("WORLD").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("child"))
    b = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("child"))
    c = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("child"))
    return a.unionByName(b).unionByName(c)


@query("""WITH p AS (SELECT seq_id, pos, sym AS a, lead(sym) OVER w AS b, lead(sym, 2) OVER w AS c FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos)), q AS (SELECT *, (a = b AND b = c)::INT AS same FROM p WHERE c IS NOT NULL),
r AS (SELECT *, coalesce(sum(1 - same) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM q), k AS (SELECT *, CASE WHEN same = 1 THEN sum(same) OVER (PARTITION BY seq_id, run ORDER BY pos) ELSE 0 END AS k FROM r),
n AS (SELECT seq_id, a, b, count(*) AS n, min(pos) AS f FROM k WHERE k % 2 = 0 GROUP BY ALL HAVING count(*) > 1) SELECT seq_id, a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, f) AS m FROM n) WHERE m = 1""")
def bigram_top(spark, d):
    return G.bigram_top(A.sequences(spark, d))


@query(f"WITH RECURSIVE {_RULES}, walk AS (SELECT lpad(ord::VARCHAR, 9, '0') AS path, child, 1 AS depth FROM rule WHERE parent = 'WORLD' UNION ALL SELECT path || '.' || lpad(r.ord::VARCHAR, 9, '0'), r.child, depth + 1 FROM walk JOIN rule r ON r.parent = walk.child) SELECT (row_number() OVER (ORDER BY path) - 1)::INT AS ord, child, depth FROM walk ANTI JOIN rule ON rule.parent = walk.child")
def expand_sections(spark, d):
    return G.expand_sections(_rules(spark, d), "WORLD")


@query(f"WITH RECURSIVE {_RULES}, walk AS (SELECT parent AS top, child, 1 AS depth FROM rule UNION ALL SELECT top, r.child, depth + 1 FROM walk JOIN rule r ON r.parent = walk.child) SELECT top AS parent, max(depth) AS depth FROM walk GROUP BY top")
def section_depth(spark, d):
    return G.section_depth(_rules(spark, d))


@query(f"""WITH {_MONO}, mn AS (SELECT *, row_number() OVER (PARTITION BY item, level ORDER BY "start") AS seg FROM mono), ch AS (SELECT p.item, p.level, p.seg, p.label, string_agg(c.label, '|' ORDER BY c."start") AS parts FROM mn p JOIN mn c ON c.item = p.item AND c.level = p.level + 1 AND c."start" >= p."start" AND c."start" < p."end" GROUP BY ALL),
n AS (SELECT label AS lhs, parts AS rhs, count(*) AS n FROM ch GROUP BY ALL) SELECT lhs, rhs, n, round(n / sum(n) OVER (PARTITION BY lhs), 6) AS p FROM n""")
def pcfg_rules(spark, d):
    return G.pcfg_rules(H.children(H.make_monotonic(A.hierarchy(spark, d)))).withColumn("p", F.round("p", 6))


@query("""WITH w AS (SELECT sym AS a, lead(sym) OVER x AS b, lead(sym, 2) OVER x AS c, lead(sym, 3) OVER x AS e FROM seq WINDOW x AS (PARTITION BY seq_id ORDER BY pos)), g AS (SELECT a || '-' || b AS gram, 2 AS size FROM w WHERE b IS NOT NULL UNION ALL SELECT a || '-' || b || '-' || c, 3 FROM w WHERE c IS NOT NULL UNION ALL SELECT a || '-' || b || '-' || c || '-' || e, 4 FROM w WHERE e IS NOT NULL)
SELECT gram, size, n, n * size AS coverage FROM (SELECT gram, size, count(*) AS n FROM g GROUP BY gram, size) WHERE n > 1""")
def recurring_subseqs(spark, d):
    return G.recurring_subseqs(A.sequences(spark, d), (2, 3, 4))


@query("""WITH s AS (SELECT seq_id, pos, sym AS label FROM seq), r AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM (SELECT *, coalesce((label <> lag(label) OVER (PARTITION BY seq_id ORDER BY pos))::INT, 0) AS n FROM s)), k AS (SELECT *, row_number() OVER (PARTITION BY seq_id, g ORDER BY pos) - 1 AS k FROM r)
SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1)::INT AS pos, label FROM k WHERE label NOT IN (0, 1) OR k % (label + 2) = 0""")
def contract_sections(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", F.col("sym").alias("label"))
    return G.contract_sections(s, spark.createDataFrame([(0, 2), (1, 3)], "label int, size int"))


@query()
def pair_induction(spark, d):
    def f(syms):
        _, sections, _ = G.induce([syms])
        return [(p, k, c) for p, cs in sorted(sections.items()) for k, c in enumerate(cs)]

    return K.per_sequence(A.sequences(spark, d), f, "parent int, ord int, child int")


@query()
def section_layers(spark, d):
    def f(syms):
        left, sections, _ = G.induce([syms])
        return [(n, k, lab, dur) for n, (labs, durs) in enumerate(G.section_layers(left[0], sections)) for k, (lab, dur) in enumerate(zip(labs, durs))]

    return K.per_sequence(A.sequences(spark, d), f, "level int, ord int, label int, duration int")


@query()
def most_salient(spark, d):
    return K.per_sequence(A.sequences(spark, d), lambda syms: G.salient([syms]), "section int, size int, n int")
