"""Patterns, cliques, components and sections as relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import inlining as I
from ..operators import kernels as K
from ..operators import matrices as M
from ..operators import parts as N
from ..operators import sequences as Q
from ..operators import similar as L
from ..operators import spectral as P
from ..operators import statistics as S
from ..sources import adapters as A
from .matrices import _MUTUAL
from .registry import query


def _patterns(spark, d):
    """The symbols of repeated stretches as patterns of their songs: (song, pattern, syms), and where they are: (pattern, seq_id, pos)."""
    s = A.sequences(spark, d)
    runs = M.diag_segments(M.equality_cells(s), ["seq_id"]).where("len >= 5")
    at = runs.select("seq_id", "len", F.explode(F.array("i0", "j0")).alias("pos")).distinct()
    k = at.select("seq_id", "len", "pos", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("k")).withColumn("p", F.col("pos") + F.col("k"))
    k = k.join(s.select("seq_id", F.col("pos").alias("p"), "sym"), ["seq_id", "p"])
    g = k.groupBy("seq_id", "len", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sym"))), lambda x: x["sym"]).alias("syms"))
    g = g.withColumn("song", S.song()).withColumn("pattern", F.concat_ws("-", F.col("song").cast("string"), F.transform("syms", lambda x: x.cast("string"))))
    return g.select("song", "pattern", "syms").distinct(), g.select("pattern", "seq_id", "pos").distinct()


_PATTERNS = """wh AS (SELECT DISTINCT seq_id, len, unnest([i0, j0]) AS pos FROM run WHERE len >= 5), oc AS (SELECT a.seq_id, a.pos, list(s.sym ORDER BY s.pos) AS syms FROM wh a JOIN seq s ON s.seq_id = a.seq_id AND s.pos >= a.pos AND s.pos < a.pos + a.len GROUP BY a.seq_id, a.pos, a.len),
pt AS (SELECT DISTINCT seq_id // 50 AS song, (seq_id // 50) || '-' || array_to_string(syms, '-') AS pattern, syms FROM oc), cn AS (SELECT pattern, song, len(syms) AS n, sym, count(*) AS c FROM (SELECT pattern, song, syms, unnest(syms) AS sym FROM pt) GROUP BY ALL),
ov AS (SELECT a.song, a.pattern AS a, b.pattern AS b, sum(least(a.c, b.c)) / max(greatest(a.n, b.n)) AS overlap FROM cn a JOIN cn b ON a.song = b.song AND a.sym = b.sym AND a.pattern < b.pattern GROUP BY ALL)"""


@query(f"WITH {_PATTERNS} SELECT song, a, b, round(overlap, 6) AS overlap FROM ov WHERE overlap >= 0.8 - 1e-9")
def pattern_overlaps(spark, d):
    return L.overlaps(_patterns(spark, d)[0], "song", 0.8).withColumn("overlap", F.round("overlap", 6))


@query()
def pattern_cascade(spark, d):
    """Patterns of a song that are alike by overlap and by alignment."""
    x, _ = L.cascade(_patterns(spark, d)[0], "song", 0.5)
    return x.select("song", "a", "b", *(F.round(c, 6).alias(c) for c in ("overlap", "alignment")))


@query()
def cascade_steps(spark, d):
    """How many pairs of patterns each step of the cascade leaves, the last one by where they are."""
    patterns, occurrences = _patterns(spark, d)
    return L.cascade(patterns, "song", 0.5, occurrences)[1]


@query(f"""WITH {_PATTERNS}, ln AS (SELECT song, len(syms) AS n, count(*) AS c FROM pt GROUP BY ALL) SELECT a.song, sum(CASE WHEN a.n = b.n THEN a.c * (a.c - 1) / 2 ELSE a.c * b.c END)::BIGINT AS pairs FROM ln a JOIN ln b ON a.song = b.song AND a.n <= b.n AND a.n >= 0.8 * b.n - 1e-9 GROUP BY 1""")
def pattern_length_pairs(spark, d):
    return L.length_pairs(_patterns(spark, d)[0], "song", 0.8)


def _song_graph(spark, d):
    """The alignment graph of songs: edges (u, v) between positions of sequences, as numbers."""
    s = A.sequences(spark, d)
    e = G.alignment_edges(M.mutual_align(s, S.pairings(s), 6, 2, 0.4))
    return e.select(G.node(F.col("a"), F.col("i")).alias("u"), G.node(F.col("b"), F.col("j")).alias("v"))


_GRAPH = f"""{_MUTUAL}, ed AS MATERIALIZED (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (SELECT a * {G.ROOM} + i0 + k AS u, b * {G.ROOM} + j0 + k AS v FROM (SELECT *, unnest(range(0, len)) AS k FROM segs)) WHERE u <> v),
nb AS MATERIALIZED (SELECT u, list(v) AS f, list(v) FILTER (v > u) AS g FROM (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed) GROUP BY u)"""


@query(f"""WITH RECURSIVE {_GRAPH}, cq AS (SELECT [u] AS c, coalesce(g, []) AS g, f FROM nb UNION ALL SELECT list_append(c, w), list_intersect(x.g, coalesce(nb.g, [])), list_intersect(x.f, nb.f) FROM (SELECT c, g, f, unnest(g) AS w FROM cq) x JOIN nb ON nb.u = w)
SELECT array_to_string(c, ' ') AS nodes, len(c)::INT AS size FROM cq WHERE len(f) = 0 AND len(c) > 2""")
def song_cliques(spark, d):
    x = N.cliques(_song_graph(spark, d))
    return x.select(F.concat_ws(" ", F.transform("nodes", lambda v: v.cast("string"))).alias("nodes"), "size")


@query(f"WITH {_GRAPH} SELECT ed.u, ed.v FROM ed JOIN nb a ON a.u = ed.u JOIN nb b ON b.u = ed.v WHERE len(list_intersect(a.f, b.f)) > 0")
def clique_union(spark, d):
    return N.in_cliques(_song_graph(spark, d))


# Affinity -------------------------------------------------------------------------------------


def _halves(spark, d):
    f = A.features(spark, d)
    return [f.select("label", "pos", F.slice("vec", a, 32).alias("vec")) for a in (1, 33)]


_REC = """rp AS MATERIALIZED (SELECT label, pos, vec[1:32] AS v, vec[33:64] AS w FROM feat), nn AS (SELECT label, count(*) AS n FROM feat GROUP BY 1),
ds AS (SELECT a.label, a.pos AS i, b.pos AS j, round(1 - list_cosine_similarity(a.v, b.v), 9) AS d FROM rp a JOIN rp b ON a.label = b.label AND abs(a.pos - b.pos) >= 9),
kn AS MATERIALIZED (SELECT x.label, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY d, j) AS r FROM ds) x JOIN nn ON nn.label = x.label WHERE r <= least(n - 1, 2 * ceil(sqrt(greatest(0, n - 17))))),
sy AS MATERIALIZED (SELECT a.* FROM kn a SEMI JOIN kn b ON a.label = b.label AND a.i = b.j AND a.j = b.i), bw AS (SELECT label, median(m) AS b FROM (SELECT label, i, max(d) AS m FROM sy GROUP BY ALL) GROUP BY 1),
rc AS MATERIALIZED (SELECT sy.label, i, j, exp(-coalesce(d / nullif(b, 0), 0)) AS v FROM sy JOIN bw ON bw.label = sy.label)"""
_LAG = f"""{_REC}, sm AS MATERIALIZED (SELECT x.label, i, i + lag AS j, list_sort(vs)[len(vs) - 4] AS v FROM (SELECT label, j - i AS lag, i + o AS i, list(v) AS vs FROM (SELECT *, unnest(range(-4, 5)) AS o FROM rc) GROUP BY ALL) x JOIN nn ON nn.label = x.label WHERE len(vs) > 4 AND i >= 0 AND i + lag >= 0 AND i < n AND i + lag < n)"""
_PATH = """pd AS (SELECT label, i, d FROM (SELECT label, pos AS i, list_sum(list_transform(list_zip(w, lead(w) OVER (PARTITION BY label ORDER BY pos)), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, lead(pos) OVER (PARTITION BY label ORDER BY pos) AS nx FROM rp) WHERE nx IS NOT NULL),
pv AS (SELECT pd.label, i, exp(-coalesce(d / nullif(s, 0), 0)) AS v FROM pd JOIN (SELECT label, median(d) AS s FROM pd GROUP BY 1) t ON t.label = pd.label), pa AS MATERIALIZED (SELECT label, i, i + 1 AS j, v FROM pv UNION ALL SELECT label, i + 1, i, v FROM pv)"""
_BAL = f"{_LAG}, {_PATH}, dg AS (SELECT label, i, sum(r) AS r, sum(p) AS p FROM (SELECT label, i, v AS r, 0 AS p FROM sm UNION ALL SELECT label, i, 0, v FROM pa) GROUP BY ALL), mu AS (SELECT label, coalesce(sum(p * (p + r)) / nullif(sum((p + r) ** 2), 0), 0) AS mu FROM dg GROUP BY 1)"


@query(f"WITH {_REC} SELECT label, i, j, round(v, 6) AS v FROM rc")
def recurrence_affinity(spark, d):
    return P.recurrence(_halves(spark, d)[0], "label").withColumn("v", F.round("v", 6))


@query(f"WITH {_LAG} SELECT label, i::INT AS i, j::INT AS j, round(v, 6) AS v FROM sm")
def recurrence_smoothed(spark, d):
    f = _halves(spark, d)[0]
    return P.lag_median(P.recurrence(f, "label"), f, "label").withColumn("v", F.round("v", 6))


@query(f"WITH {_REC}, {_PATH} SELECT label, i, j, round(v, 6) AS v FROM pa")
def path_affinity(spark, d):
    return P.path(_halves(spark, d)[1], "label").withColumn("v", F.round("v", 6))


@query(f"WITH {_BAL} SELECT x.label, i::INT AS i, j::INT AS j, round(mu * sum(r) + (1 - mu) * sum(p), 6) + 0.0 AS v FROM (SELECT label, i, j, v AS r, 0 AS p FROM sm UNION ALL SELECT label, i, j, 0, v FROM pa) x JOIN mu ON mu.label = x.label GROUP BY x.label, i, j, mu")
def balanced_affinity(spark, d):
    return P.affinity(*_halves(spark, d), "label").withColumn("v", F.round("v", 6) + 0.0)


@query(f"WITH {_BAL} SELECT label, round(mu, 6) AS mu FROM mu")
def affinity_balance(spark, d):
    rep, loc = _halves(spark, d)
    return P.balance(P.lag_median(P.recurrence(rep, "label"), rep, "label"), P.path(loc, "label"), "label").withColumn("mu", F.round("mu", 6))


@query()
def balanced_labels(spark, d):
    """Clusters of positions by the balanced affinity, on up to eleven levels; only the eigenvectors are a task's work for a series."""
    x = P.affinity(*_halves(spark, d), "label")
    return K.per_group(x, "label", lambda f: [(k, p, int(c)) for k, lab in enumerate(K.laplacian_labels_of_cells(*(f[c].to_numpy() for c in "ijv"), whole=False)) for p, c in enumerate(lab)], "level int, pos int, cluster int")


_STUDY = """nn AS (SELECT label, count(*) AS n FROM feat GROUP BY 1), rk AS MATERIALIZED (SELECT s.label, i, j, n, row_number() OVER (PARTITION BY s.label, i ORDER BY v DESC, j) AS r FROM ssm s JOIN nn ON nn.label = s.label),
kp AS MATERIALIZED (SELECT label, i, j, sigma FROM rk JOIN (SELECT unnest([0.3, 0.5, 0.8]::DOUBLE[]) AS sigma) ON r <= round_even(2 * ceil(sqrt(n * sigma - 1)), 0)),
sg AS MATERIALIZED (SELECT label, sigma, min(i) AS i0, min(j) AS j0, count(*)::INT AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY label, sigma, j - i ORDER BY i) AS g FROM kp) GROUP BY label, sigma, j - i, g),
sb AS MATERIALIZED (SELECT label, sigma, beta, i0, j0, len FROM sg JOIN (SELECT unnest([2, 3, 4]) AS beta) ON len >= beta WHERE i0 <> j0),
rw AS (SELECT label, sigma, beta, i, count(*) AS c FROM (SELECT label, sigma, beta, i0 + k AS i FROM (SELECT *, unnest(range(0, len)) AS k FROM sb)) GROUP BY ALL), rs AS (SELECT label, sigma, beta, count(*) AS filled, sum(c) AS s, sum(c * c) AS ss FROM rw GROUP BY ALL),
le AS (SELECT label, sigma, beta, max(len) AS length FROM sb GROUP BY ALL), gd AS (SELECT label, n, sigma, beta FROM nn CROSS JOIN (SELECT unnest([0.3, 0.5, 0.8]::DOUBLE[]) AS sigma) CROSS JOIN (SELECT unnest([2, 3, 4]) AS beta)),
rt AS MATERIALIZED (SELECT gd.label, gd.sigma, gd.beta, round(coalesce(filled / n * ln(length) / nullif(sqrt(greatest(0, ss / n - (s / n) ** 2)) / (s / n), 0), 0), 6) AS rating FROM gd LEFT JOIN rs USING (label, sigma, beta) LEFT JOIN le USING (label, sigma, beta)),
bs AS (SELECT label, arg_min(sigma, (-m, sigma)) AS s FROM (SELECT label, sigma, round(avg(rating), 6) AS m FROM rt GROUP BY ALL) GROUP BY 1), bb AS (SELECT rt.label, arg_min(beta, (-rating, beta)) AS b FROM rt JOIN bs ON bs.label = rt.label AND rt.sigma = s GROUP BY 1)"""


@query(f"WITH {_STUDY} SELECT rt.label, sigma, beta, rating, sigma = s AS best_sigma, sigma = s AND beta = b AS best FROM rt JOIN bs ON bs.label = rt.label JOIN bb ON bb.label = rt.label")
def sigma_beta_study(spark, d):
    f = A.features(spark, d)
    n, sigmas = f.groupBy("label").agg(F.count("*").alias("n")), [0.3, 0.5, 0.8]
    return P.parameter_study(P.foremost(f, n, "label", sigmas), n, "label", sigmas, [2, 3, 4])


# Sections -------------------------------------------------------------------------------------


@query(f"""WITH {_PATTERNS} SELECT p.song, p.pattern AS section FROM pt p ANTI JOIN pt o ON o.song = p.song AND len(o.syms) > len(p.syms) AND contains(',' || array_to_string(o.syms, ',') || ',', ',' || array_to_string(p.syms, ',') || ',')""")
def uncontained_sections(spark, d):
    p = _patterns(spark, d)[0].withColumnRenamed("pattern", "section")
    return I.uncontained(p, "song").select("song", "section")


def _rules(spark, d):
    """A dictionary for each sequence: runs of equal symbols as sections, and passages of four runs as sections of these."""
    s = A.sequences(spark, d)
    w = Window.partitionBy("seq_id").orderBy("pos")
    g = Q.islands(s, ["seq_id"], "pos", F.col("sym") != F.lag("sym").over(w))
    n = g.groupBy("seq_id", "grp").agg(F.first("sym").alias("sym"), F.count("*").cast("int").alias("n"))
    run = F.concat_ws("x", F.col("sym").cast("string"), F.col("n").cast("string"))
    runs = n.select("seq_id", run.alias("parent"), "sym", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord")).distinct().select("seq_id", "parent", "ord", F.col("sym").cast("string").alias("child"))
    return runs.unionByName(n.select("seq_id", F.concat(F.lit("passage "), F.floor(F.col("grp") / 4).cast("string")).alias("parent"), (F.col("grp") % 4).alias("ord"), run.alias("child")))


@query("""SELECT seq_id, 'passage ' || (grp // 4) AS parent, (row_number() OVER (PARTITION BY seq_id, grp // 4 ORDER BY pos) - 1)::INT AS ord, sym::VARCHAR AS child
FROM (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY pos)::INT AS grp FROM (SELECT *, coalesce((sym <> lag(sym) OVER (PARTITION BY seq_id ORDER BY pos))::INT, 0) AS new FROM seq))""")
def inlined_repetitions(spark, d):
    return I.inlined(_rules(spark, d), "seq_id")
