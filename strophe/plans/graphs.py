"""Alignment graphs, components and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import matrices as M
from ..operators import statistics as S
from ..sources import adapters as A
from .matrices import _MUTUAL
from .registry import query


def _segments(spark, d, least=5):
    s = A.sequences(spark, d)
    return s, M.diag_segments(M.equality_cells(s), ["seq_id"]).where(F.col("len") >= least)


_EDGES = "ed AS (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM run WHERE len >= 5))"
_COMP = f"{_EDGES}, bi AS (SELECT seq_id, i AS a, j AS b FROM ed UNION SELECT seq_id, j, i FROM ed), re AS (SELECT seq_id, a, a AS b FROM bi UNION SELECT re.seq_id, re.a, bi.b FROM re JOIN bi ON bi.seq_id = re.seq_id AND bi.a = re.b), co AS (SELECT seq_id, a::INT AS pos, min(b)::INT AS root FROM re GROUP BY ALL)"


@query(f"WITH {_MUTUAL} SELECT a, i0 + k AS i, b, j0 + k AS j, count(*) AS n FROM (SELECT *, unnest(range(0, len)) AS k FROM segs) GROUP BY ALL")
def alignment_edges(spark, d):
    s = A.sequences(spark, d)
    return G.alignment_edges(M.mutual_align(s, S.pairings(s), 6, 2, 0.4))


@query(f"WITH RECURSIVE {_COMP} SELECT seq_id, pos, root FROM co")
def components(spark, d):
    return G.position_components(_segments(spark, d)[1])


@query(f"WITH RECURSIVE {_COMP} SELECT a.seq_id, a.pos AS i, b.pos AS j FROM co a JOIN co b ON a.seq_id = b.seq_id AND a.root = b.root AND a.pos < b.pos")
def transitive_closure(spark, d):
    c = G.position_components(_segments(spark, d)[1])
    return M.closure(c.withColumnRenamed("root", "comp"), ["seq_id"])


_LABELS = f"{_COMP}, cl AS (SELECT seq.seq_id, seq.pos, coalesce(label, -1)::INT AS label FROM seq LEFT JOIN (SELECT seq_id, pos, dense_rank() OVER (PARTITION BY seq_id ORDER BY root) - 1 AS label FROM co) c ON c.seq_id = seq.seq_id AND c.pos = seq.pos)"


@query(f"WITH RECURSIVE {_LABELS} SELECT * FROM cl")
def comp_labels(spark, d):
    s, segs = _segments(spark, d)
    return G.comp_labels(s, G.position_components(segs))


@query(f"WITH RECURSIVE {_COMP}, n AS (SELECT co.seq_id, root, sym, count(*) AS n FROM co JOIN seq ON seq.seq_id = co.seq_id AND seq.pos = co.pos GROUP BY ALL) SELECT seq_id, root, arg_min(sym, (-n, sym)) AS sym FROM n GROUP BY ALL")
def comp_modes(spark, d):
    s, segs = _segments(spark, d)
    return G.comp_modes(s, G.position_components(segs))


@query("""WITH c AS (SELECT seq_id, pos, pos // 4 AS root FROM seq), e AS (SELECT c.seq_id, root, entropy(sym) AS e, count(*) AS n FROM c JOIN seq ON seq.seq_id = c.seq_id AND seq.pos = c.pos GROUP BY ALL)
SELECT seq_id, round(sum(e), 6) AS entropy, count(*) AS comps, sum(n)::BIGINT AS points FROM e GROUP BY seq_id""")
def msa_entropy(spark, d):
    s = A.sequences(spark, d)
    c = s.select("seq_id", "pos", F.floor(F.col("pos") / 4).cast("int").alias("root"))
    return G.msa_entropy(s, c).withColumn("entropy", F.round("entropy", 6))


@query(f"""WITH {_MUTUAL}, x AS (SELECT a // 50 AS song, least(i0 + k, j0 + k) AS i, greatest(i0 + k, j0 + k) AS j, count(*) AS n FROM (SELECT *, unnest(range(0, len)) AS k FROM segs) WHERE i0 <> j0 GROUP BY ALL),
kp AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY song) AS most FROM x) WHERE n >= 0.5 * most), gr AS (SELECT *, i - row_number() OVER (PARTITION BY song, j - i ORDER BY i) AS g FROM kp) SELECT song::BIGINT AS song, min(i)::INT AS i0, min(j)::INT AS j0, count(*)::INT AS len, round(avg(n), 6) AS mean FROM gr GROUP BY song, j - i, g""")
def structure_graph(spark, d):
    s = A.sequences(spark, d)
    e = G.alignment_edges(M.mutual_align(s, S.pairings(s), 6, 2, 0.4))
    x = G.structure_graph(e.select(S.song("a").alias("song"), F.col("i").alias("x"), F.col("j").alias("y")), ["song"])
    return x.select("song", "i0", "j0", "len", F.round("mean", 6).alias("mean"))


@query("""WITH v AS (SELECT a.seq_id, b.pos - a.pos AS dx, b.sym - a.sym AS dy, a.pos, a.sym FROM seq a JOIN seq b ON a.seq_id = b.seq_id AND a.pos < b.pos), n AS (SELECT seq_id, dx, dy, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT v.seq_id, dx, dy, q.pos - v.pos AS tx, q.sym - v.sym AS ty, count(*) AS c FROM v JOIN seq q ON q.seq_id = v.seq_id GROUP BY ALL)
SELECT n.seq_id, n.dx, n.dy, n.n::INT AS n_points, count(*)::INT AS n_translators FROM n JOIN t ON t.seq_id = n.seq_id AND t.dx = n.dx AND t.dy = n.dy AND t.c = n.n GROUP BY ALL""")
def siatec(spark, d):
    return G.siatec(A.sequences(spark, d))


_OCC = "oc AS (SELECT string_agg(s.sym, '-' ORDER BY s.pos) AS pattern, o.len, o.seq_id, o.pos FROM (SELECT DISTINCT seq_id, len, unnest([i0, j0]) AS pos FROM run WHERE len >= 4) o JOIN seq s ON s.seq_id = o.seq_id AND s.pos >= o.pos AND s.pos < o.pos + o.len GROUP BY o.seq_id, o.len, o.pos)"


@query(f"WITH {_OCC} SELECT * FROM oc")
def pattern_occurrences(spark, d):
    return G.pattern_occurrences(*_segments(spark, d, 4))


@query(f"WITH {_OCC} SELECT pattern, len, count(DISTINCT seq_id) AS n_seqs, count(*) AS n_occs FROM oc WHERE len(list_distinct(string_split(pattern, '-'))) > 1 GROUP BY ALL HAVING count(DISTINCT seq_id) >= 2")
def filter_patterns(spark, d):
    return G.filter_patterns(G.pattern_occurrences(*_segments(spark, d, 4)), 2)


@query(f"WITH RECURSIVE {_OCC}, pp AS (SELECT DISTINCT a.pattern AS a, b.pattern AS b FROM oc a JOIN oc b ON a.seq_id = b.seq_id AND a.pos = b.pos), rr AS (SELECT a, b FROM pp UNION SELECT rr.a, pp.b FROM rr JOIN pp ON pp.a = rr.b) SELECT a AS pattern, min(b) AS grp FROM rr GROUP BY a")
def group_by_cooc(spark, d):
    return G.group_by_cooc(G.pattern_occurrences(*_segments(spark, d, 4)))


@query(f"WITH {_OCC}, m AS (SELECT a.seq_id AS s1, b.seq_id AS s2, a.pos AS x, b.pos AS y, unnest(range(0, a.len)) AS k FROM oc a JOIN oc b ON a.pattern = b.pattern AND (a.seq_id < b.seq_id OR a.seq_id = b.seq_id AND a.pos < b.pos)) SELECT s1, (x + k)::INT AS p1, s2, (y + k)::INT AS p2, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 2")
def connection_counts(spark, d):
    x = G.connection_counts(G.pattern_occurrences(*_segments(spark, d, 4)), 2)
    return x.select("s1", F.col("p1").cast("int").alias("p1"), "s2", F.col("p2").cast("int").alias("p2"), "n")


_FORM = "fo AS (SELECT src, dst, count(*) AS n FROM (SELECT sym AS src, coalesce(lead(sym) OVER (PARTITION BY seq_id ORDER BY pos), -1) AS dst FROM seq UNION ALL SELECT -2, sym FROM seq WHERE pos = 0) GROUP BY ALL), fp AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM fo)"


@query(f"WITH {_FORM} SELECT src, dst, round(p, 6) AS p FROM fp")
def markov_form(spark, d):
    return G.markov_form(A.sequences(spark, d)).withColumn("p", F.round("p", 6))


@query(f"WITH RECURSIVE {_FORM}, wa AS (SELECT [dst] AS way, dst, -ln(p) AS cost, [-ln(p)] AS costs FROM fp WHERE src = -2 UNION ALL SELECT list_append(way, fp.dst), fp.dst, cost - ln(p), list_append(costs, cost - ln(p)) FROM wa JOIN fp ON fp.src = wa.dst AND NOT list_contains(way, fp.dst)), be AS (SELECT way, costs FROM wa WHERE dst = -1 ORDER BY round(cost, 12), way LIMIT 1) SELECT (k - 1)::INT AS ord, way[k] AS sym, round(costs[k], 6) AS cost FROM (SELECT *, unnest(range(1, len(way))) AS k FROM be)")
def form_essence(spark, d):
    return G.form_essence(G.markov_form(A.sequences(spark, d))).withColumn("cost", F.round("cost", 6))


@query(f"WITH RECURSIVE {_LABELS}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM cl WHERE label = -1) SELECT seq_id, min(pos) AS start, count(*) AS len FROM g GROUP BY seq_id, g")
def gaps_by_length(spark, d):
    s, segs = _segments(spark, d)
    return G.gaps(G.comp_labels(s, G.position_components(segs)))


@query(f"WITH RECURSIVE {_COMP}, z AS (SELECT seq_id, root, count(*) AS n FROM co GROUP BY ALL), a AS (SELECT x.seq_id, x.root AS c, y.root AS d, count(*) AS n FROM co x JOIN co y ON y.seq_id = x.seq_id AND y.pos = x.pos + 1 GROUP BY ALL) SELECT a.seq_id, c, d, round(a.n / greatest(p.n, q.n), 6) AS share FROM a JOIN z p ON p.seq_id = a.seq_id AND p.root = c JOIN z q ON q.seq_id = a.seq_id AND q.root = d")
def comp_adjacency(spark, d):
    return G.comp_adjacency(G.position_components(_segments(spark, d)[1])).withColumn("share", F.round("share", 6))
