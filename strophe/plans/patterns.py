"""Patterns, sections and wider looks at matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import hierarchies as H
from ..operators import matrices as M
from ..operators import patterns as P
from ..operators import tiles as T
from ..sources import adapters as A
from .hierarchies import _MONO
from .matrices import _N
from .registry import query


def _segments(spark, d, least=3):
    return M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where(F.col("len") >= least)


@query("SELECT seq_id, pos, len, round(mean, 6) AS mean FROM (" + " UNION ALL ".join(f"SELECT seq_id, pos, {n} AS len, avg(sym) OVER w AS mean, count(*) OVER w AS n FROM seq WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in (3, 4, 5)) + ") WHERE n = len")
def sliding_means(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", F.col("sym").cast("double").alias("value"))
    return P.sliding_means(s, 3, 5).withColumn("mean", F.round("mean", 6))


@query("""WITH b AS (SELECT seq_id, pos, (sym > 1)::INT AS v FROM seq), g AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM (SELECT *, coalesce((v <> lag(v) OVER (PARTITION BY seq_id ORDER BY pos))::INT, 0) AS n FROM b)), z AS (SELECT seq_id, g, count(*) AS n FROM g GROUP BY ALL),
f AS (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM z WINDOW w AS (PARTITION BY seq_id ORDER BY g)) SELECT g.seq_id, g.pos, CASE WHEN v = 0 AND coalesce(f.n <= 2 AND f.n / (a + f.n + b) <= 0.4, false) THEN 1 ELSE v END AS value FROM g JOIN f ON f.seq_id = g.seq_id AND f.g = g.g""")
def fill_gaps(spark, d):
    s = A.sequences(spark, d).select("seq_id", "pos", (F.col("sym") > 1).cast("int").alias("value"))
    return P.fill_gaps(s, 2, 0.4)


@query("""WITH sq AS (SELECT label, i, j, round(v, 3) + 1 AS v FROM ssm), b AS (SELECT a.label, a.i, a.j, sum(c.v) AS block, sum(c.v) FILTER (c.i - a.i = c.j - a.j) AS dia, count(*) AS n FROM sq a JOIN sq c ON c.label = a.label AND c.i >= a.i AND c.i < a.i + 3 AND c.j >= a.j AND c.j < a.j + 3 GROUP BY ALL)
SELECT label, i, j, round(CASE WHEN round((block - dia) / 6, 9) = 0 THEN 0 ELSE dia / 3 / round((block - dia) / 6, 9) END, 3) + 0.0 AS rating FROM b WHERE n = 9""")
def diagonal_ratings(spark, d):
    return T.diagonal_ratings(A.features(spark, d), "label", 3, 3, 3)


@query("""WITH t AS (SELECT label, max(v) AS top, max(i) + 1 AS n FROM ssm GROUP BY 1), q AS (SELECT s.label, i, j, n, round_even(greatest(0, v) / top * 4, 0)::INT AS q FROM ssm s JOIN t ON t.label = s.label),
w AS (SELECT label, any_value(n) AS n, a, b, entropy(q) AS e FROM (SELECT *, unnest(range(greatest(0, j - 2), least(j, n - 3) + 1)) AS b FROM (SELECT *, unnest(range(greatest(0, i - 2), least(i, n - 3) + 1)) AS a FROM q)) GROUP BY label, a, b),
p AS (SELECT label, i, j, least(greatest(i + x - 2, 0), n - 3) AS a, least(greatest(j + y - 2, 0), n - 3) AS b FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS x) CROSS JOIN (SELECT unnest([0, 1, 2]) AS y)),
m AS (SELECT p.label, i, j, avg(e) AS e FROM p JOIN w ON w.label = p.label AND w.a = p.a AND w.b = p.b GROUP BY ALL) SELECT m.label, m.i, m.j, round(v * e, 6) + 0.0 AS v FROM m JOIN ssm s ON s.label = m.label AND s.i = m.i AND s.j = m.j""")
def entropy_fusion(spark, d):
    return T.entropy_fusion(A.features(spark, d), "label", 3, 4).withColumn("v", F.round("v", 6) + 0.0)


@query("""WITH a AS (SELECT * FROM run WHERE len >= 3), r AS (SELECT * FROM run WHERE len >= 5) SELECT a.seq_id, a.i0, a.j0, a.len, coalesce(min(abs((a.j0 - a.i0) - (r.j0 - r.i0))), 1) AS dist FROM a LEFT JOIN r ON r.seq_id = a.seq_id AND a.i0 + a.len - 1 > r.i0 AND r.i0 + r.len - 1 > a.i0 GROUP BY ALL""")
def segment_distances(spark, d):
    s = _segments(spark, d)
    x = P.min_distance(s, s.where("len >= 5"), "seq_id")
    return x.select("seq_id", "i0", "j0", "len", F.col("dist").cast("long").alias("dist"))


@query(f"""WITH {_N}, s AS (SELECT * FROM run WHERE len >= 2), c AS (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM s)),
f AS (SELECT c.seq_id, i, j, (count(*) OVER (PARTITION BY c.seq_id, i ORDER BY j RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) = least(3, n - j) OR count(*) OVER (PARTITION BY c.seq_id, i ORDER BY j RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) = least(3, j + 1))::INT AS fl FROM c JOIN n ON n.seq_id = c.seq_id)
SELECT k.seq_id, i0, j0, len, avg(fl) >= 0.9 AS block FROM (SELECT *, unnest(range(0, len)) AS k FROM s) k JOIN f ON f.seq_id = k.seq_id AND f.i = i0 + k AND f.j = j0 + k GROUP BY ALL""")
def remove_blocks(spark, d):
    s = A.sequences(spark, d)
    return P.without_blocks(_segments(spark, d, 2), M.lengths(s), "seq_id", 3)


_PAT = "pt AS (SELECT seq_id, i0 AS p, len, list_sort(list_distinct(list_append(list(j0 - i0), 0))) AS t FROM run WHERE len >= 3 GROUP BY ALL)"


@query(f"WITH {_PAT} SELECT seq_id, p, len, array_to_string(t, ',') AS t FROM pt")
def translations(spark, d):
    x = P.translations(_segments(spark, d), "seq_id")
    return x.select("seq_id", "p", "len", F.concat_ws(",", F.transform("t", lambda v: v.cast("string"))).alias("t"))


@query(f"""WITH {_PAT}, g AS (SELECT *, sum(w) OVER (PARTITION BY seq_id, t ORDER BY p, len) AS g FROM (SELECT *, coalesce((p >= max(p + len) OVER (PARTITION BY seq_id, t ORDER BY p, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS w FROM pt))
SELECT seq_id, min(p) AS p, (max(p + len) - min(p))::INT AS len, array_to_string(t, ',') AS t FROM g GROUP BY seq_id, t, g""")
def merge_patterns(spark, d):
    x = P.merged_patterns(P.translations(_segments(spark, d), "seq_id"), "seq_id")
    return x.select("seq_id", "p", "len", F.concat_ws(",", F.transform("t", lambda v: v.cast("string"))).alias("t"))


@query("""WITH s AS (SELECT DISTINCT seq_id, i0 AS p, len + j0 - i0 AS len, j0 - i0 AS sub FROM run WHERE len >= 4)
SELECT * FROM s ANTI JOIN s o ON o.seq_id = s.seq_id AND o.p <= s.p AND s.p + s.len <= o.p + o.len AND s.sub % o.sub = 0 AND (o.len > s.len OR o.len = s.len AND o.sub < s.sub)""")
def sections(spark, d):
    return P.sections(_segments(spark, d, 4), "seq_id")


@query("SELECT seq_id, sum(len)::BIGINT AS n, count(*) FILTER (len = 1) AS isolated FROM run GROUP BY seq_id")
def isolated_cells(spark, d):
    return P.isolated_cells(M.equality_cells(A.sequences(spark, d)), ["seq_id"])


@query("""WITH p AS (SELECT DISTINCT seq_id, sym AS a, b FROM (SELECT *, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM seq) WHERE b IS NOT NULL), q AS (SELECT *, count(*) OVER (PARTITION BY seq_id, a) AS x, count(*) OVER (PARTITION BY seq_id, b) AS y FROM p) SELECT seq_id, a, b FROM q WHERE x = 1 AND y = 1""".replace("FROM seq)", "FROM seq_orders)"))
def successor_chains(spark, d):
    return P.successor_chains(A.order_sequences(spark, d))


@query("SELECT (pos // 8)::BIGINT AS label, sym, count(*) AS n FROM seq GROUP BY ALL")
def label_values(spark, d):
    s = A.sequences(spark, d)
    return P.label_values(s, s.select("seq_id", "pos", F.floor(F.col("pos") / 8).alias("label")))



@query(f"""WITH {_N}, c AS (SELECT seq_id, k AS param, i0 + x AS i, j0 + x AS j FROM (SELECT *, unnest(range(0, len)) AS x FROM (SELECT seq_id, i0, j0, len, unnest([0, 1, 2]) AS k FROM run) WHERE len = k + 2)),
m AS (SELECT DISTINCT seq_id, combo, i, j FROM (SELECT seq_id, i, j, param, unnest(range(1, 8)) AS combo FROM c) WHERE (combo >> param) & 1 = 1), r AS (SELECT seq_id, combo, min(i) AS i0, min(j) AS j0, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY seq_id, combo, j - i ORDER BY i) AS g FROM m) GROUP BY seq_id, combo, j - i, g),
w AS (SELECT seq_id, combo, i, count(*) AS c FROM m GROUP BY ALL), s AS (SELECT seq_id, combo, count(*) AS filled, sum(c) AS s, sum(c * c) AS ss FROM w GROUP BY ALL), l AS (SELECT seq_id, combo, max(len) AS len FROM r GROUP BY ALL),
x AS (SELECT s.seq_id, s.combo, round(coalesce(filled / n.n * ln(l.len) / nullif(sqrt(greatest(0, ss / n.n - (s / n.n) ** 2)) / (s / n.n), 0), 0), 6) AS rating FROM s JOIN l ON l.seq_id = s.seq_id AND l.combo = s.combo JOIN n ON n.seq_id = s.seq_id)
SELECT seq_id, arg_min(combo, (-rating, combo))::INT AS combo, max(rating) AS rating FROM x GROUP BY seq_id""")
def combination_search(spark, d):
    s = A.sequences(spark, d)
    segs = _segments(spark, d, 2).where("len <= 4").withColumn("param", F.col("len") - 2)
    cells = P.combinations(M.segment_cells(segs, ["seq_id", "param"]), ["seq_id"], "param", 3)
    sizes = M.lengths(s).join(cells.select("seq_id", "combo").distinct(), "seq_id")
    r = M.matrix_rating(cells, sizes, ["seq_id", "combo"], True).withColumn("rating", F.round("rating", 6))
    return E.best_per_group(r, ["seq_id"], "rating", ["combo"]).select("seq_id", "combo", "rating")


@query("""WITH h AS (SELECT * FROM hier WHERE level < 2), f AS (SELECT *, coalesce((label <> lag(label) OVER (PARTITION BY item, level ORDER BY "start"))::INT, 1) AS n FROM h), a AS (SELECT item, level, count(DISTINCT label) = sum(n) AS alone FROM f GROUP BY ALL)
SELECT item, bool_or(alone AND level = 0) <> bool_or(alone AND level = 1) AS auto FROM a GROUP BY item""")
def auto_labeled(spark, d):
    return H.auto_labeled(A.hierarchy(spark, d))


@query(f"""WITH {_MONO}, mn AS (SELECT *, row_number() OVER (PARTITION BY item, level ORDER BY "start") AS seg FROM mono), ch AS (SELECT p.item, p.level, p.seg, p.label, string_agg(c.label, '|' ORDER BY c."start") AS parts, count(*) AS k FROM mn p JOIN mn c ON c.item = p.item AND c.level = p.level + 1 AND c."start" >= p."start" AND c."start" < p."end" GROUP BY ALL),
r AS (SELECT item, sum(k) AS size FROM (SELECT DISTINCT item, level, label, parts, k FROM ch) GROUP BY 1), n AS (SELECT item, count(*) AS n FROM mono GROUP BY 1) SELECT n.item, round(size / n, 6) AS dlength FROM n JOIN r ON r.item = n.item""")
def description_length(spark, d):
    return H.description_length(H.make_monotonic(A.hierarchy(spark, d))).withColumn("dlength", F.round("dlength", 6))


@query("""WITH f AS (SELECT label, pos, k, v FROM (SELECT label, pos, unnest(range(0, 64)) AS k, unnest(vec) AS v FROM feat)), s AS (SELECT label, pos, k, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v FROM f WINDOW w AS (PARTITION BY label, k)), l AS (SELECT label, pos, list(v ORDER BY k) AS vec FROM s GROUP BY ALL)
SELECT a.label, a.pos AS i, b.pos AS j, round(list_cosine_similarity(a.vec, b.vec), 6) AS v FROM l a JOIN l b ON a.label = b.label AND a.pos < b.pos""")
def scaled_affinity(spark, d):
    return M.ssm(M.scaled(A.features(spark, d), "label"), "label", upper=True, digits=6).where("i < j")


@query("""WITH f AS (SELECT vec_id, unnest(range(0, 64)) AS k, unnest(vec) AS v FROM feat), m AS (SELECT k, quantile_cont(v, 0.5) AS m FROM f GROUP BY 1) SELECT vec_id, string_agg((v > m)::INT::VARCHAR, '' ORDER BY f.k) AS bits FROM f JOIN m ON m.k = f.k GROUP BY vec_id""")
def median_patterns(spark, d):
    return M.median_bits(A.features(spark, d))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY p DESC, param1, param2, ref, method) AS k FROM result), m AS (SELECT item, max(l) AS best FROM result GROUP BY 1) SELECT b.item, l AS chosen, best FROM b JOIN m ON m.item = b.item WHERE k = 1""")
def choice_by_rating(spark, d):
    r = A.results(spark, d)
    a = E.best_per_group(r, ["item"], "p", ["param1", "param2", "ref", "method"]).select("item", F.col("l").alias("chosen"))
    return a.join(r.groupBy("item").agg(F.max("l").alias("best")), "item")
