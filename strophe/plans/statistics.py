"""Histograms, divergences, tempo and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from ..sources import adapters as A
from .registry import query

_GRAM4 = "SELECT seq_id, sym || '-' || b || '-' || c || '-' || e AS gram, count(*) AS n FROM (SELECT seq_id, sym, lead(sym) OVER w AS b, lead(sym, 2) OVER w AS c, lead(sym, 3) OVER w AS e FROM {} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE e IS NOT NULL GROUP BY ALL"
_GRAM2 = "SELECT seq_id, sym || '-' || b AS gram, count(*) AS n FROM (SELECT seq_id, sym, lead(sym) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM seq) WHERE b IS NOT NULL GROUP BY ALL"
_CHI = """WITH h AS ({}), r AS (SELECT seq_id, gram, n / sum(n) OVER (PARTITION BY seq_id) AS n FROM h), ids AS (SELECT DISTINCT seq_id FROM r), g AS (SELECT DISTINCT gram FROM r),
f AS (SELECT ids.seq_id, g.gram, coalesce(r.n, 0) AS n FROM ids CROSS JOIN g LEFT JOIN r ON r.seq_id = ids.seq_id AND r.gram = g.gram),
dist AS (SELECT x.seq_id AS a, y.seq_id AS b, 0.5 * sum((x.n - y.n) ** 2 / (x.n + y.n + 1e-6)) AS d FROM f x JOIN f y ON x.gram = y.gram AND x.seq_id // 50 = y.seq_id // 50 GROUP BY ALL)"""


@query("SELECT seq_id, sym, count(*) AS n FROM seq GROUP BY ALL")
def frequency_hist(spark, d):
    return S.frequency_hist(A.sequences(spark, d))


@query(_GRAM2)
def tuple_hist_2(spark, d):
    return S.tuple_hist(A.sequences(spark, d), 2)


@query(_GRAM4.format("seq"))
def tuple_hist_4(spark, d):
    return S.tuple_hist(A.sequences(spark, d), 4)


@query(f"WITH h AS (SELECT seq_id, sym::VARCHAR AS gram, count(*) AS n FROM seq GROUP BY ALL UNION ALL {_GRAM2}) SELECT seq_id, gram, round(n / sum(n) OVER (PARTITION BY seq_id), 6) AS n FROM h")
def freq_trans_hist(spark, d):
    return S.freq_trans_hist(A.sequences(spark, d)).withColumn("n", F.round("n", 6))


@query(_CHI.format(_GRAM2) + " SELECT a, b, round(d, 6) + 0.0 AS d FROM dist")
def chi2_matrix(spark, d):
    x = S.chi2_distances(S.tuple_hist(A.sequences(spark, d), 2, relative=True))
    return x.select("a", "b", (F.round("d", 6) + 0.0).alias("d"))


@query("SELECT seq_id, round(entropy(sym), 6) AS entropy FROM seq GROUP BY seq_id")
def entropy(spark, d):
    return S.entropy(A.sequences(spark, d), ["seq_id"], "sym").withColumn("entropy", F.round("entropy", 6))


@query("SELECT seq_id, round(60 * (count(*) - 1) / nullif(max(t) - min(t), 0), 9) AS tempo FROM grid GROUP BY seq_id")
def tempo(spark, d):
    return S.tempo(A.grid(spark, d)).withColumn("tempo", F.round("tempo", 9))


_REL = """rel AS (SELECT o.seq_id, o.pos, (o.t - b."start") / (b."end" - b."start") AS rel FROM onsets o JOIN iv b ON b.seq_id = o.seq_id AND b."start" <= o.t AND o.t < b."end" WHERE NOT isinf(b."end"))"""


@query(f"WITH {_REL} SELECT seq_id, pos, round(rel, 6) AS rel FROM rel")
def onset_position(spark, d):
    return S.onset_position(A.grid(spark, d, "click"), A.grid(spark, d)).withColumn("rel", F.round("rel", 6))


@query(f"""WITH {_REL}, m AS (SELECT seq_id, rel, min(rel) OVER (PARTITION BY seq_id) AS a, max(rel) OVER (PARTITION BY seq_id) AS b FROM rel), l AS (SELECT seq_id, rel, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM m),
h AS (SELECT seq_id, least(floor((rel - lo) / (hi - lo) * 16), 15)::INT AS bin, count(*) AS n FROM l GROUP BY ALL) SELECT seq_id, bin, round(n / sum(n) OVER (PARTITION BY seq_id), 6) AS n FROM h""")
def onset_hist(spark, d):
    return S.onset_hist(A.grid(spark, d, "click"), A.grid(spark, d), 16).withColumn("n", F.round("n", 6))


@query(_CHI.format(_GRAM2) + """, mean AS (SELECT a, avg(d) AS m FROM dist GROUP BY a), total AS (SELECT a // 50 AS song, avg(d) AS mu, stddev_pop(d) AS sd FROM dist GROUP BY 1) SELECT a AS seq_id, round(abs((m - mu) / nullif(sd, 0)), 6) AS z FROM mean JOIN total ON song = a // 50""")
def outlier_scores(spark, d):
    x = S.chi2_distances(S.tuple_hist(A.sequences(spark, d), 2, relative=True))
    return S.outlier_scores(x).withColumn("z", F.round("z", 6))


@query("""
WITH len AS (SELECT seq_id, count(*) AS v FROM seq GROUP BY 1), tm AS (SELECT seq_id, 60 * (count(*) - 1) / nullif(max(t) - min(t), 0) AS v FROM grid GROUP BY 1), e AS (SELECT seq_id, entropy(sym) AS v FROM seq GROUP BY 1),
z AS (SELECT seq_id, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) AS z FROM len UNION ALL SELECT seq_id, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) FROM tm UNION ALL SELECT seq_id, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) FROM e)
SELECT seq_id FROM z GROUP BY seq_id HAVING count(*) FILTER (z > 1.5) < 2 AND max(z) <= 3""")
def outlier_filter(spark, d):
    s = A.sequences(spark, d)
    lengths = s.groupBy("seq_id").agg(F.count("*").alias("v"))
    scores = [S.z_scores(lengths, "v"), S.z_scores(S.tempo(A.grid(spark, d)), "tempo"), S.z_scores(S.entropy(s, ["seq_id"], "sym"), "entropy")]
    return S.outlier_filter(scores, 1.5, 2, 3.0)


_MODE = "SELECT seq_id, pos, arg_min(sym, (-n, sym)) AS sym FROM (SELECT *, sum(n) OVER (PARTITION BY seq_id, pos) AS total FROM (SELECT seq_id, (pos // {0})::INT AS pos, sym, count(*) AS n FROM {1} GROUP BY ALL)) WHERE total = {0} GROUP BY seq_id, pos"


@query(f"""
WITH s2 AS (SELECT seq_id, 2 * pos AS pos, sym FROM seq UNION ALL SELECT seq_id, 2 * pos + 1, sym FROM seq), s3 AS ({_MODE.format(2, "seq")}), s4 AS ({_MODE.format(3, "s2")}),
h AS (SELECT *, 0 AS k, '1' AS factor, 1.0::DOUBLE AS f FROM ({_GRAM4.format("seq")}) UNION ALL SELECT *, 1, '2', 2.0 FROM ({_GRAM4.format("s2")}) UNION ALL SELECT *, 2, '1/2', 0.5 FROM ({_GRAM4.format("s3")}) UNION ALL SELECT *, 3, '2/3', 2.0::DOUBLE / 3 FROM ({_GRAM4.format("s4")})),
r AS (SELECT seq_id, k, factor, f, gram, n / sum(n) OVER (PARTITION BY seq_id, k) AS n FROM h), centre AS (SELECT gram, sum(n) / (SELECT count(DISTINCT seq_id) FROM seq) AS c FROM r WHERE k = 0 GROUP BY gram),
opt AS (SELECT DISTINCT seq_id, k, factor, f FROM r), grams AS (SELECT gram FROM r UNION SELECT gram FROM centre),
dd AS (SELECT opt.seq_id, opt.k, opt.factor, opt.f, 0.5 * sum((coalesce(r.n, 0) - coalesce(c, 0)) ** 2 / (coalesce(r.n, 0) + coalesce(c, 0) + 1e-6)) AS d FROM opt CROSS JOIN grams LEFT JOIN r ON r.seq_id = opt.seq_id AND r.k = opt.k AND r.gram = grams.gram LEFT JOIN centre ON centre.gram = grams.gram GROUP BY ALL),
tm AS (SELECT seq_id, 60 * (count(*) - 1) / nullif(max(t) - min(t), 0) AS tempo FROM grid GROUP BY 1), tn AS (SELECT * FROM tm WHERE tempo IS NOT NULL),
u AS (SELECT dd.*, tempo * f AS new, mean, abs(tempo * f - mean) AS td FROM dd JOIN tn ON tn.seq_id = dd.seq_id CROSS JOIN (SELECT avg(tempo) AS mean FROM tn)),
sc AS (SELECT *, round(coalesce(d / nullif(max(d) OVER w, 0), 0) + coalesce(td / nullif(max(td) OVER w, 0), 0), 9) AS score FROM u WINDOW w AS (PARTITION BY seq_id))
SELECT seq_id, arg_min(factor, (score, k)) AS factor FROM sc WHERE k = 0 OR (new BETWEEN 0.0002 AND 0.0006 AND new BETWEEN mean / 2 AND mean * 2) GROUP BY seq_id""")
def double_time_choice(spark, d):
    return S.double_time_choice(A.sequences(spark, d), A.grid(spark, d), 0.0002, 0.0006)


_PAIRS = """pairs AS (SELECT DISTINCT least(x.seq_id, y.seq_id) AS a, greatest(x.seq_id, y.seq_id) AS b FROM (SELECT seq_id, row_number() OVER (PARTITION BY seq_id // 50 ORDER BY md5('3:' || seq_id), seq_id) - 1 AS k, count(*) OVER (PARTITION BY seq_id // 50) AS n FROM (SELECT DISTINCT seq_id FROM seq)) x
CROSS JOIN (SELECT unnest(range(1, {0})) AS s) JOIN (SELECT seq_id, row_number() OVER (PARTITION BY seq_id // 50 ORDER BY md5('3:' || seq_id), seq_id) - 1 AS k FROM (SELECT DISTINCT seq_id FROM seq)) y ON y.k = (x.k + s) % x.n AND y.seq_id // 50 = x.seq_id // 50 WHERE s < x.n AND x.seq_id <> y.seq_id)"""


@query(f"WITH {_PAIRS.format(11)} SELECT a, b FROM pairs")
def pairings(spark, d):
    return S.pairings(A.sequences(spark, d), 20)


_OVERLAP = f"""WITH {_PAIRS.format(11)}, h AS (SELECT seq_id, sym, count(*) AS n FROM seq GROUP BY ALL), z AS (SELECT seq_id, count(*) AS len FROM seq GROUP BY 1),
c AS (SELECT a, b, sum(least(x.n, y.n)) AS common FROM pairs JOIN h x ON x.seq_id = a JOIN h y ON y.seq_id = b AND y.sym = x.sym GROUP BY ALL),
o AS (SELECT pairs.a, pairs.b, coalesce(common, 0)::BIGINT AS common, la.len AS la, lb.len AS lb FROM pairs JOIN z la ON la.seq_id = pairs.a JOIN z lb ON lb.seq_id = pairs.b LEFT JOIN c ON c.a = pairs.a AND c.b = pairs.b)"""


@query(_OVERLAP + " SELECT a, b, round(common / (la + lb - common), 6) AS jaccard FROM o")
def multi_jaccard(spark, d):
    s = A.sequences(spark, d)
    return S.multiset_overlap(s, S.pairings(s)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(_OVERLAP + " SELECT a, b, common, round(common / greatest(la, lb), 6) AS isect FROM o")
def isect_similarity(spark, d):
    s = A.sequences(spark, d)
    return S.multiset_overlap(s, S.pairings(s)).select("a", "b", "common", F.round("isect", 6).alias("isect"))


@query("WITH h AS (SELECT seq_id, sym, count(*) AS n FROM seq GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, sym) - 1 AS k FROM h) SELECT seq_id, round(sum(k * n) / sum(n), 6) AS variation FROM r GROUP BY seq_id")
def freq_variation(spark, d):
    return S.freq_variation(A.sequences(spark, d)).withColumn("variation", F.round("variation", 6))
