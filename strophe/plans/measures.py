"""Wider measures of hierarchies, tempo, values over time and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import graphs as G
from ..operators import hierarchies as H
from ..operators import matrices as M
from ..operators import sequences as Q
from ..operators import sets as T
from ..operators import statistics as S
from ..sources import adapters as A
from . import graphs as graph_plans
from .graphs import _COMP, _FORM, _OCC
from .hierarchies import _MEETS, _MONO, _grid, _labels
from .matrices import _rating
from .registry import SQL, query
from .statistics import _OVERLAP, _REL

_ABOVE = "ab AS (SELECT l.item, l.level, l.label, u.label AS above, count(*) AS n FROM lab l JOIN lab u ON u.item = l.item AND u.level = l.level - 1 AND u.pos = l.pos GROUP BY ALL)"


@query('SELECT item, level, seg, "start", "end", replace(label, \'i\', \'\') AS label FROM hier')
def homogenize_labels(spark, d):
    return H.homogenized(A.hierarchy(spark, d), "i")


@query(f"""WITH {_ABOVE}, g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, coalesce(sum(n) FILTER (above = label), 0) AS own, sum(n) AS n FROM ab GROUP BY ALL), r AS (SELECT item, level, sum(same + own * (n - own)) / nullif(sum(n * (n - 1) / 2), 0) AS r FROM g GROUP BY ALL)
SELECT item, round(CASE WHEN count(r) = count(*) THEN avg(r) END, 6) AS recall FROM r GROUP BY item""")
def label_monotonicity_alone(spark, d):
    return H.label_monotonicity_alone(_labels(spark, d)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {_ABOVE}, g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM ab GROUP BY ALL), r AS (SELECT item, level, sum(same) AS same, sum(n * (n - 1) / 2) AS alike, sum(n) AS n FROM g GROUP BY ALL)
SELECT item, round(avg((n * (n - 1) / 2 - alike + same) / nullif(n * (n - 1) / 2, 0)), 6) AS recall FROM r GROUP BY item""")
def label_monotonicity_of_all(spark, d):
    return H.label_monotonicity_of_all(_labels(spark, d)).withColumn("recall", F.round("recall", 6))


_CHILDREN = f"""{_MONO}, mn AS (SELECT *, row_number() OVER (PARTITION BY item, level ORDER BY "start") AS seg FROM mono),
ch AS (SELECT p.item, p.level, p.seg, p.label, string_agg(c.label, '|' ORDER BY c."start") AS parts FROM mn p JOIN mn c ON c.item = p.item AND c.level = p.level + 1 AND c."start" >= p."start" AND c."start" < p."end" GROUP BY ALL)"""


@query(f"""WITH {_CHILDREN}, k AS (SELECT item, level, label, parts, count(*) AS n FROM ch GROUP BY ALL), g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM k GROUP BY ALL), x AS (SELECT item, sum(same) AS same, sum(n * (n - 1) / 2) AS alike, sum(n) AS n FROM g GROUP BY 1)
SELECT item, round(CASE WHEN alike = 0 THEN 1 ELSE (n * (n - 1) / 2 - alike + same) / (n * (n - 1) / 2) END, 6) AS transitivity FROM x""")
def transitivity_of_all(spark, d):
    return H.transitivity_of_all(H.make_monotonic(A.hierarchy(spark, d))).withColumn("transitivity", F.round("transitivity", 6))


@query()
def transitivity_of_order(spark, d):
    return H.transitivity_of_order(H.make_monotonic(A.hierarchy(spark, d)), 1).withColumn("transitivity", F.round("transitivity", 6))


def _node(level: int, below: str) -> str:
    return f"""q{level} AS (SELECT p.item, p."start", CASE WHEN count(*) = 1 THEN any_value(c.tree) ELSE '(' || p.label || ' ' || string_agg(c.tree, ' ' ORDER BY c."start") || ')' END AS tree, CASE WHEN count(*) = 1 THEN any_value(c.size) ELSE sum(c.size) + 1 END AS size
FROM mono p JOIN {below} c ON c.item = p.item AND c."start" >= p."start" AND c."start" < p."end" WHERE p.level = {level} GROUP BY p.item, p."start", p.label)"""


@query(f"""WITH {_MONO}, q2 AS (SELECT item, "start", label AS tree, 1 AS size FROM mono WHERE level = 2), {_node(1, 'q2')}, {_node(0, 'q1')}
SELECT item, CASE WHEN count(*) = 1 THEN any_value(tree) ELSE '(S ' || string_agg(tree, ' ' ORDER BY "start") || ')' END AS tree, (CASE WHEN count(*) = 1 THEN any_value(size) ELSE sum(size) + 1 END)::BIGINT AS size FROM q0 GROUP BY item""")
def label_trees(spark, d):
    return H.label_trees(H.make_monotonic(A.hierarchy(spark, d)))


@query("WITH " + _MEETS.format("", "lab") + " SELECT item, j - i AS dj, k - i AS dk, count(*) AS n FROM t GROUP BY ALL")
def relative_triples(spark, d):
    return H.relative_triples(_labels(spark, d))


@query(" UNION ALL ".join(f"SELECT '{m}' AS measure, count({c}) AS n, count(*) FILTER ({c} = 1) AS ones, round(median({c}), 6) AS median, round(avg({c}), 6) AS mean, round(min({c}), 6) AS least FROM ({SQL[q]})" for m, q, c in (("interval", "interval_monotonicity", "recall"), ("label", "label_monotonicity", "recall"), ("strict", "transitivity_strict", "transitivity"), ("repetition", "repetitiveness", "repetitiveness"))))
def hierarchy_analysis(spark, d):
    h, lab, mono = A.hierarchy(spark, d), _labels(spark, d), H.make_monotonic(A.hierarchy(spark, d))
    measures = {"interval": H.interval_monotonicity(h, _grid(spark, d)), "label": H.pairwise_recall(lab), "strict": H.transitivity_strict(mono), "repetition": H.repetitiveness(h)}
    # rounded before they are summed up: a median may lie on the edge of two roundings
    x = H.summary({name: m.select("item", F.round(m.columns[1], 6).alias("value")) for name, m in measures.items()})
    return x.select("measure", "n", "ones", *[F.round(c, 6).alias(c) for c in ("median", "mean", "least")])


@query("""WITH st AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS step FROM grid WINDOW w AS (PARTITION BY seq_id ORDER BY pos)), g2 AS (SELECT seq_id, 2 * pos AS pos, t FROM st UNION ALL SELECT seq_id, 2 * pos + 1, t + step / 2 FROM st WHERE step IS NOT NULL),
l2 AS (SELECT item, level, pos, coalesce(code, -1)::INT AS label FROM (SELECT g.seq_id AS item, l.level, g.pos, (SELECT arg_max(h.label, h."start") FROM hier h WHERE h.item = g.seq_id AND h.level = l.level AND h."start" <= g.t) AS name FROM g2 g CROSS JOIN (SELECT unnest([0, 1, 2]) AS level) l) LEFT JOIN (SELECT sym_name, min(sym) AS code FROM seq GROUP BY 1) ON sym_name = name),
x AS (SELECT l.item, l.level, l.label, u.label AS above, count(*) AS n FROM l2 l JOIN l2 u ON u.item = l.item AND u.level = l.level - 1 AND u.pos = l.pos GROUP BY ALL), g AS (SELECT item, level, label, sum(n * (n - 1) / 2) AS same, sum(n) AS n FROM x GROUP BY ALL), r AS (SELECT item, level, sum(same) / nullif(sum(n * (n - 1) / 2), 0) AS r FROM g GROUP BY ALL)
SELECT item, round(CASE WHEN count(r) = count(*) THEN avg(r) END, 6) AS recall FROM r GROUP BY item""")
def label_count_test(spark, d):
    codes = A.sequences(spark, d).groupBy("sym_name").agg(F.min("sym").alias("code"))
    grid = Q.interpolate_grid(A.grid(spark, d)).withColumnRenamed("seq_id", "item")
    b = H.beatwise_labels(A.hierarchy(spark, d), grid, "").join(codes, F.col("label") == F.col("sym_name"), "left")
    return H.pairwise_recall(b.select("item", "level", "pos", F.coalesce("code", F.lit(-1)).alias("label"))).withColumn("recall", F.round("recall", 6))


@query()
def aligned_lmeasure(spark, d):
    lab = _labels(spark, d)
    p = F.col("pos")
    est = lab.where("level = 2 and pos % 5 != 3").select("item", "level", "pos", "label").unionByName(lab.where("level = 1 and pos % 5 != 3").select("item", "level", F.col("pos"), F.floor(p / 6).cast("int").alias("label")))
    x = H.aligned_lmeasure(lab, est)
    return x.select("item", *[F.round(c, 6).alias(c) for c in "prl"])


@query("""WITH tm AS (SELECT seq_id, 60 * (count(*) - 1) / nullif(max(t) - min(t), 0) AS t FROM grid GROUP BY 1), u AS (SELECT seq_id, t, CASE WHEN t < 0.0004 THEN ceil(log2(0.0004 / t)) ELSE 0 END AS up FROM tm WHERE t IS NOT NULL), v AS (SELECT *, t * 2.0 ** up AS x FROM u)
SELECT seq_id, 2.0::DOUBLE ** (up - CASE WHEN x > 0.0005 THEN ceil(log2(x / 0.0005)) ELSE 0 END) AS factor FROM v""")
def tempo_factor(spark, d):
    return S.tempo(A.grid(spark, d)).where("tempo is not null").select("seq_id", S.tempo_factor(F.col("tempo"), 0.0004, 0.0005).alias("factor"))


@query("""WITH st AS (SELECT *, coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS step FROM grid WINDOW w AS (PARTITION BY seq_id ORDER BY pos)), g2 AS (SELECT seq_id, 2 * pos AS pos, t FROM st UNION ALL SELECT seq_id, 2 * pos + 1, t + step / 2 FROM st WHERE step IS NOT NULL)
SELECT '2/3' AS factor, seq_id, (pos // 3)::INT AS pos, round(t, 3) AS t FROM g2 WHERE pos % 3 = 0 UNION ALL SELECT '1/2', seq_id, (pos // 2)::INT, round(t, 3) FROM grid WHERE pos % 2 = 0""")
def adjusted_grid(spark, d):
    g = A.grid(spark, d)
    a, b = (S.adjusted_grid(g, f).select(F.lit(f).alias("factor"), "seq_id", "pos", F.round("t", 3).alias("t")) for f in ("2/3", "1/2"))
    return a.unionByName(b)


def _vote_sql(h0: str, h1: str, h2: str) -> str:
    share = "SELECT seq_id, gram, n / sum(n) OVER (PARTITION BY seq_id) AS n FROM ({})"
    return f"""h0 AS ({share.format(h0)}), h1 AS ({share.format(h1)}), h2 AS ({share.format(h2)}), gg AS (SELECT gram FROM h0 UNION SELECT gram FROM h1 UNION SELECT gram FROM h2),
f0 AS (SELECT i.seq_id, gg.gram, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT seq_id FROM h0) i CROSS JOIN gg LEFT JOIN h0 h ON h.seq_id = i.seq_id AND h.gram = gg.gram), f1 AS (SELECT i.seq_id, gg.gram, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT seq_id FROM h1) i CROSS JOIN gg LEFT JOIN h1 h ON h.seq_id = i.seq_id AND h.gram = gg.gram),
f2 AS (SELECT i.seq_id, gg.gram, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT seq_id FROM h2) i CROSS JOIN gg LEFT JOIN h2 h ON h.seq_id = i.seq_id AND h.gram = gg.gram),
ds AS (""" + " UNION ALL ".join(f"SELECT a.seq_id AS a, b.seq_id AS b, {k} AS k, {v} AS vote, round(0.5 * sum((a.n - b.n) ** 2 / (a.n + b.n + 1e-6)), 9) AS d FROM f{k} a JOIN f0 b ON a.gram = b.gram AND a.seq_id // 50 = b.seq_id // 50 GROUP BY ALL" for k, v in ((0, 0), (1, 1), (2, -1))) + """),
vt AS (SELECT a, b, arg_min(vote, (d, k)) AS vote FROM ds GROUP BY ALL), gv AS (SELECT a AS seq_id, avg(vote) AS g FROM vt GROUP BY 1), gt AS (SELECT b AS seq_id, avg(vote) AS h FROM vt GROUP BY 1), sc AS (SELECT gv.seq_id, round((g - h) / 2, 9) AS score FROM gv JOIN gt ON gt.seq_id = gv.seq_id)
SELECT seq_id, round(score, 6) + 0.0 AS score, CASE WHEN score > 0.33 THEN 1 WHEN score < -0.33 THEN -1 ELSE 0 END AS choice FROM sc"""


_HALF = "SELECT seq_id, pos, arg_min(sym, (-n, sym)) AS sym FROM (SELECT *, sum(n) OVER (PARTITION BY seq_id, pos) AS total FROM (SELECT seq_id, (pos // 2)::INT AS pos, sym, count(*) AS n FROM seq GROUP BY ALL)) WHERE total = 2 GROUP BY seq_id, pos"
_BOTH = "SELECT seq_id, sym::VARCHAR AS gram, count(*) AS n FROM {0} GROUP BY ALL UNION ALL SELECT seq_id, sym || '-' || b AS gram, count(*) AS n FROM (SELECT seq_id, sym, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM {0}) WHERE b IS NOT NULL GROUP BY ALL"


@query(f"WITH s2 AS (SELECT seq_id, 2 * pos AS pos, sym FROM seq UNION ALL SELECT seq_id, 2 * pos + 1, sym FROM seq), s3 AS ({_HALF}), {_vote_sql(_BOTH.format('seq'), _BOTH.format('s3'), _BOTH.format('s2'))}")
def tempo_votes(spark, d):
    s = A.sequences(spark, d)
    x = S.tempo_votes(*[S.freq_trans_hist(S.adjusted(s, f)) for f in ("1", "1/2", "2")])
    return x.select("seq_id", (F.round("score", 6) + 0.0).alias("score"), "choice")


@query("WITH dd AS (SELECT seq_id, j0 - i0 AS d FROM run WHERE len >= 3), " + _vote_sql("SELECT seq_id, d::VARCHAR AS gram, count(*) AS n FROM dd GROUP BY ALL", "SELECT seq_id, (d // 2)::VARCHAR AS gram, count(*) AS n FROM dd GROUP BY ALL", "SELECT seq_id, (d * 2)::VARCHAR AS gram, count(*) AS n FROM dd GROUP BY ALL"))
def pattern_votes(spark, d):
    segs = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 3")
    x = S.tempo_votes(*S.interval_hists(segs))
    return x.select("seq_id", (F.round("score", 6) + 0.0).alias("score"), "choice")


@query(f"""WITH {_REL}, st AS (SELECT seq_id, count(*) AS n, min(rel) AS lo, max(rel) AS hi, stddev_samp(rel) AS sd FROM rel GROUP BY 1), pl AS (SELECT *, unnest(range(0, 60)) AS place FROM st WHERE n > 1 AND sd > 0),
de AS (SELECT pl.seq_id, place, round(sum(exp(-0.5 * ((lo + (hi - lo) * place / 59 - rel) / (sd * n ** -0.2)) ** 2)), 9) AS y FROM pl JOIN rel ON rel.seq_id = pl.seq_id GROUP BY ALL), nb AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM de WINDOW w AS (PARTITION BY seq_id ORDER BY place)) SELECT seq_id, place::INT AS place FROM nb WHERE a < y AND b < y""")
def onset_density_peaks(spark, d):
    return S.density_peaks(S.onset_position(A.grid(spark, d, "click"), A.grid(spark, d)), "rel", 60)


@query("""WITH m AS (SELECT label, list_sum(vec) / len(vec) AS m FROM feat), t AS (SELECT label, max(m) AS top, stddev_pop(m) / nullif(avg(m), 0) AS variation FROM m GROUP BY 1), q AS (SELECT m.label, variation, round_even(round(m / top * 20, 9), 0)::BIGINT AS q FROM m JOIN t ON t.label = m.label) SELECT label, round(variation, 5) + 0.0 AS variation, round(entropy(q), 6) AS entropy FROM q GROUP BY label, variation""")
def distribution_measures(spark, d):
    x = S.vector_measures(A.features(spark, d), "label", 20)
    return x.select("label", (F.round("variation", 5) + 0.0).alias("variation"), F.round("entropy", 6).alias("entropy"))


@query("SELECT seq_id, pos, nx - pos AS dist FROM (SELECT seq_id, pos, lead(pos) OVER (PARTITION BY seq_id ORDER BY pos) AS nx FROM seq WHERE sym <> 0) WHERE nx IS NOT NULL")
def nonzero_distances(spark, d):
    return S.nonzero_distances(A.sequences(spark, d), "sym")


@query("""WITH v AS (SELECT grp, 'gd' || strftime(date, '%y-%m-%d') || '.' || version AS version FROM dated), x AS (SELECT grp, version, strptime('20' || substr(version, 3, 8), '%Y-%m-%d')::DATE AS date FROM v), y AS (SELECT grp, version, CASE WHEN date > '2024-01-01' THEN (date - INTERVAL 100 YEAR)::DATE ELSE date END AS date FROM x)
SELECT grp, version, date::VARCHAR AS date, (row_number() OVER (PARTITION BY grp ORDER BY date, version) - 1)::INT AS ord FROM y""")
def versions_by_date(spark, d):
    ids = A.dated(spark, d).select("grp", F.concat(F.lit("gd"), F.date_format("date", "yy-MM-dd"), F.lit("."), F.col("version").cast("string")).alias("version"))
    return E.versions_by_date(ids, "2024-01-01").withColumn("date", F.col("date").cast("string"))


@query("SELECT grp, year, round(coefficient, 6) AS coefficient, round(coefficient / avg(coefficient) OVER (PARTITION BY grp), 6) AS relative FROM (SELECT grp, year(date)::INT AS year, stddev_samp(value) / avg(value) AS coefficient FROM dated GROUP BY ALL)")
def relative_coefficients(spark, d):
    x = E.relative_coefficients(A.dated(spark, d).withColumn("year", F.year("date")), ["year"])
    return x.select("grp", "year", F.round("coefficient", 6).alias("coefficient"), F.round("relative", 6).alias("relative"))


@query("""WITH r AS (SELECT date, value, value / avg(value) OVER (PARTITION BY grp) AS rel FROM dated), g AS (SELECT date, avg(value) AS value, avg(rel) AS rel FROM r GROUP BY 1) SELECT date::VARCHAR AS date, round(value, 7) AS value, round(rel, 6) AS relative, round(CASE WHEN count(*) OVER w = 30 THEN avg(value) OVER w END, 6) AS mean, round(CASE WHEN count(*) OVER w = 30 THEN avg(rel) OVER w END, 6) AS relative_mean FROM g WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def overall_evolution(spark, d):
    x = E.overall_evolution(A.dated(spark, d), 30)
    return x.select(F.col("date").cast("string").alias("date"), F.round("value", 7).alias("value"), F.round("relative", 6).alias("relative"), F.round("mean", 6).alias("mean"), F.round("relative_mean", 6).alias("relative_mean"))


_MEAN = "mp AS (SELECT item, param1, round(avg(l), 9) AS l FROM result GROUP BY ALL)"


@query(f"WITH {_MEAN} SELECT item, param1, l FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY l DESC, param1) AS k FROM mp) WHERE k = 1")
def levels_analysis(spark, d):
    return E.best_level(A.results(spark, d), "param1").select("item", "param1", "l")


@query("SELECT item, count(DISTINCT ref) AS refs FROM result WHERE method = 'N' GROUP BY item HAVING count(DISTINCT ref) > 1")
def several_references(spark, d):
    return E.several_references(A.results(spark, d), "N")


@query(f"WITH {_MEAN}, ra AS (SELECT item, param1, round(avg(r), 9) AS rating FROM result GROUP BY ALL), pk AS (SELECT item, arg_min(param1, (-rating, param1)) AS param1 FROM ra GROUP BY 1), be AS (SELECT item, max(l) AS best FROM mp GROUP BY 1) SELECT count(*) AS items, round(avg(l), 9) AS chosen, round(avg(best), 9) AS best, round(avg((l = best)::INT), 9) AS hits FROM pk JOIN mp ON mp.item = pk.item AND mp.param1 = pk.param1 JOIN be ON be.item = pk.item")
def rating_study(spark, d):
    r = A.results(spark, d)
    x = E.rating_study(r, r.groupBy("item", "param1").agg(F.round(F.avg("r"), 9).alias("rating")), "param1")
    return x.select("items", *[F.round(c, 9).alias(c) for c in ("chosen", "best", "hits")])


_CLOSED = f"WITH RECURSIVE {_COMP}, tc AS (SELECT a.seq_id, a.pos AS i, b.pos AS j FROM co a JOIN co b ON a.seq_id = b.seq_id AND a.root = b.root AND a.pos < b.pos), tr AS (SELECT seq_id, min(i) AS i0, min(j) AS j0, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY seq_id, j - i ORDER BY i) AS g FROM tc) GROUP BY seq_id, j - i, g)"


@query(_CLOSED + ", " + _rating("SELECT * FROM tr", "max").removeprefix("WITH "))
def closure_rating(spark, d):
    s, segs = graph_plans._segments(spark, d)
    c = M.closure(G.position_components(segs).withColumnRenamed("root", "comp"), ["seq_id"])
    return M.matrix_rating(c, M.lengths(s), ["seq_id"], True).withColumn("rating", F.round("rating", 6))


def _sets(spark, d):
    return A.sequences(spark, d).select("seq_id", F.floor(F.col("pos") / 5).alias("id"), F.col("sym").alias("x"))


_SETS = "se AS (SELECT seq_id, id, list_sort(list_distinct(list(sym))) AS xs FROM (SELECT seq_id, (pos // 5)::BIGINT AS id, sym FROM seq) GROUP BY ALL), us AS (SELECT seq_id, xs, min(id) AS id, count(*) AS n FROM se GROUP BY ALL), hd AS (SELECT a.seq_id, a.id AS inner_id, a.n, b.id AS outer_id FROM us a JOIN us b ON a.seq_id = b.seq_id AND len(a.xs) < len(b.xs) AND list_has_all(b.xs, a.xs))"


@query(f"WITH {_SETS} SELECT u.seq_id, u.id, len(u.xs)::INT AS size, (u.n + coalesce((SELECT sum(n) FROM hd WHERE hd.seq_id = u.seq_id AND hd.outer_id = u.id), 0))::BIGINT AS rating FROM us u ANTI JOIN hd ON hd.seq_id = u.seq_id AND hd.inner_id = u.id")
def maximal_sets(spark, d):
    return T.maximal_sets(_sets(spark, d), "seq_id")


@query(f"WITH {_SETS} SELECT seq_id, inner_id AS \"inner\", n, outer_id AS \"outer\" FROM hd")
def integrate_subsets(spark, d):
    return T.containments(_sets(spark, d), "seq_id")


@query(_OVERLAP.replace("WITH ", "WITH RECURSIVE ", 1) + ", ed AS (SELECT a, b FROM o WHERE round(common / greatest(la, lb), 6) >= 0.9), bi AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT a, a AS b FROM bi UNION SELECT re.a, bi.b FROM re JOIN bi ON bi.a = re.b), ids AS (SELECT DISTINCT seq_id FROM seq) SELECT ids.seq_id AS id, coalesce(min(re.b), ids.seq_id) AS grp FROM ids LEFT JOIN re ON re.a = ids.seq_id GROUP BY ids.seq_id")
def groups_by_similarity(spark, d):
    s = A.sequences(spark, d)
    pairs = S.multiset_overlap(s, S.pairings(s)).select("a", "b", F.round("isect", 6).alias("similarity"))
    return T.groups_by_similarity(pairs, s.select(F.col("seq_id").alias("id")).distinct(), 0.9)


@query(f"WITH RECURSIVE {_OCC}, pp AS (SELECT DISTINCT a.pattern AS a, b.pattern AS b FROM oc a JOIN oc b ON a.seq_id = b.seq_id AND a.pos = b.pos), rr AS (SELECT a, b FROM pp UNION SELECT rr.a, pp.b FROM rr JOIN pp ON pp.a = rr.b), gr AS (SELECT a AS pattern, min(b) AS grp FROM rr GROUP BY a) SELECT grp, count(*) AS total FROM gr JOIN oc ON oc.pattern = gr.pattern GROUP BY grp ORDER BY total DESC, grp LIMIT 8")
def frequent_pattern_groups(spark, d):
    occ = G.pattern_occurrences(*graph_plans._segments(spark, d, 4))
    g = G.group_by_cooc(occ).join(occ.groupBy("pattern").agg(F.count("*").alias("n")), "pattern")
    return T.largest_groups(g, 8, "n")


@query(f"WITH {_OCC}, px AS (SELECT DISTINCT seq_id, pattern AS id, len, pos + k AS pos FROM (SELECT *, unnest(range(0, len)) AS k FROM oc)), cm AS (SELECT x.seq_id, x.id AS a, y.id AS b, x.len AS la, y.len AS lb, x.pos FROM px x JOIN px y ON x.seq_id = y.seq_id AND x.pos = y.pos AND x.id < y.id), rn AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id, a, b ORDER BY pos) AS g FROM cm), rl AS (SELECT seq_id, a, b, la, lb, g, count(*) AS n FROM rn GROUP BY ALL) SELECT seq_id, a, b, round(max(n) / greatest(la, lb), 6) AS similarity FROM rl GROUP BY seq_id, a, b, la, lb")
def cooc_similarity(spark, d):
    occ = G.pattern_occurrences(*graph_plans._segments(spark, d, 4))
    x = occ.select("seq_id", F.col("pattern").alias("id"), "len", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)).alias("pos")).distinct()
    return T.longest_common(x, x, "seq_id").withColumn("similarity", F.round("similarity", 6))


@query("""WITH ps AS (SELECT seq_id // 50 AS song, seq_id, sym, pos FROM seq), nd AS (SELECT a.song, a.sym AS c, b.sym AS d, a.seq_id, min(abs(a.pos - b.pos)) AS dist FROM ps a JOIN ps b ON a.seq_id = b.seq_id AND a.sym < b.sym GROUP BY ALL), ct AS (SELECT song, c, d, dist, count(*) AS n FROM nd GROUP BY ALL) SELECT song::BIGINT AS song, c, d, arg_min(dist, (-n, dist)) AS dist FROM ct GROUP BY ALL""")
def comp_distances(spark, d):
    s = A.sequences(spark, d).select(S.song().alias("song"), F.col("sym").alias("comp"), "seq_id", "pos")
    return T.nearest_distances(s, "song")


@query(f"""WITH {_FORM}, sp AS (SELECT seq_id, coalesce(lag(sym) OVER (PARTITION BY seq_id ORDER BY pos), -2) AS src, sym AS dst FROM seq UNION ALL SELECT seq_id, arg_max(sym, pos), -1 FROM seq GROUP BY 1), lp AS (SELECT seq_id, sum(ln(p)) AS logp FROM sp JOIN fp ON fp.src = sp.src AND fp.dst = sp.dst GROUP BY 1) SELECT seq_id, round(logp, 6) AS logp, round(exp(logp - max(logp) OVER ()), 6) AS share FROM lp""")
def sequence_probability(spark, d):
    s = A.sequences(spark, d)
    x = T.sequence_probability(s, G.markov_form(s))
    return x.select("seq_id", F.round("logp", 6).alias("logp"), F.round("share", 6).alias("share"))


@query("SELECT DISTINCT seq_id, pos FROM (SELECT seq_id, unnest([i0 + k, j0 + k]) AS pos FROM (SELECT *, unnest(range(0, len)) AS k FROM run WHERE len >= 5))")
def connected_positions(spark, d):
    e = G.alignment_edges(graph_plans._segments(spark, d)[1], "seq_id", "seq_id")
    return e.select(F.col("a").alias("seq_id"), F.explode(F.array("i", "j")).alias("pos")).distinct()


@query(f"WITH RECURSIVE {_COMP}, z AS (SELECT seq_id, root, count(*) AS n FROM co GROUP BY ALL), ad AS (SELECT x.seq_id, x.root AS c, y.root AS d, count(*) AS n FROM co x JOIN co y ON y.seq_id = x.seq_id AND y.pos = x.pos + 1 GROUP BY ALL), st AS (SELECT ad.seq_id, c, d FROM ad JOIN z p ON p.seq_id = ad.seq_id AND p.root = c JOIN z q ON q.seq_id = ad.seq_id AND q.root = d WHERE round(ad.n / greatest(p.n, q.n), 9) >= 0.5), b2 AS (SELECT seq_id, c, d FROM st UNION SELECT seq_id, d, c FROM st), r2 AS (SELECT seq_id, c, c AS d FROM b2 UNION SELECT r2.seq_id, r2.c, b2.d FROM r2 JOIN b2 ON b2.seq_id = r2.seq_id AND b2.c = r2.d), gp AS (SELECT seq_id, c, min(d) AS grp FROM r2 GROUP BY ALL) SELECT co.seq_id, co.pos, coalesce(grp, root)::INT AS grp FROM co LEFT JOIN gp ON gp.seq_id = co.seq_id AND gp.c = co.root")
def grouped_components(spark, d):
    comp = G.position_components(graph_plans._segments(spark, d)[1])
    return G.grouped_components(comp, 0.5)


