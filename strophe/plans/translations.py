"""Patterns with translations, and how they lie to one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import matrices as M
from ..operators import patterns as P
from ..operators import translations as T
from ..sources import adapters as A
from .registry import query

_PAT = "pt AS (SELECT seq_id, i0 AS p, len, list_sort(list_distinct(list_append(list(j0 - i0), 0))) AS t FROM run WHERE len >= 4 GROUP BY ALL), oc AS (SELECT seq_id, p, len, p + x AS s, p + x + len AS e FROM (SELECT *, unnest(t) AS x FROM pt))"
_MEET = "mt AS (SELECT a.seq_id, a.p, a.len, a.s, a.e, b.p AS q, b.len AS qlen, b.s AS bs, b.e AS be, least(a.e, b.e) - greatest(a.s, b.s) AS n FROM oc a JOIN oc b ON a.seq_id = b.seq_id AND a.s < b.e AND b.s < a.e WHERE a.p <> b.p OR a.len <> b.len)"


def _patterns(spark, d):
    return P.translations(M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 4"), "seq_id")


def _joined(df):
    return df.withColumn("t", F.concat_ws(",", F.transform("t", lambda v: v.cast("string"))))


@query(f'WITH {_PAT} SELECT seq_id, p, len, s AS "start", e AS "end" FROM oc')
def pattern_limits(spark, d):
    return T.occurrences(_patterns(spark, d), "seq_id")


@query(f"WITH {_PAT} SELECT DISTINCT seq_id, p, len, unnest([s, e]) AS pos FROM oc")
def pattern_boundaries(spark, d):
    return T.boundaries(_patterns(spark, d), "seq_id")


@query(f"WITH {_PAT}, ix AS (SELECT DISTINCT seq_id, p, len, unnest(range(s, e)) AS pos FROM oc), z AS (SELECT seq_id, p, len, count(*) AS n FROM ix GROUP BY ALL) SELECT a.seq_id, a.p, a.len, b.p AS q, b.len AS qlen, count(*) AS common, count(*) = any_value(z.n) AS contains FROM ix a JOIN ix b ON a.seq_id = b.seq_id AND a.pos = b.pos JOIN z ON z.seq_id = b.seq_id AND z.p = b.p AND z.len = b.len GROUP BY ALL")
def pattern_containment(spark, d):
    x = _patterns(spark, d)
    return T.coverage(x, x, "seq_id")


@query(f"WITH {_PAT}, f AS (SELECT DISTINCT seq_id, p, len FROM pt), x AS (SELECT a.seq_id, a.p, a.len, b.p AS q, b.len AS qlen, least(a.p + a.len, b.p + b.len) - greatest(a.p, b.p) AS n FROM f a JOIN f b ON a.seq_id = b.seq_id AND (a.p <> b.p OR a.len <> b.len)) SELECT seq_id, p, len, q, qlen, n AS overlap, round(n / greatest(len, qlen), 6) AS share, n = qlen AS contained FROM x WHERE n > 0")
def first_overlaps(spark, d):
    return T.first_overlaps(_patterns(spark, d), "seq_id").withColumn("share", F.round("share", 6))


@query(f"WITH {_PAT}, {_MEET} SELECT DISTINCT seq_id, p, len, q, qlen, bs - s AS at FROM mt WHERE n >= 0.8 * qlen")
def internal_positions(spark, d):
    return T.internal_positions(_patterns(spark, d), "seq_id", 0.8)


@query(f"WITH {_PAT}, {_MEET} SELECT DISTINCT seq_id, p, len, q, qlen, CASE WHEN bs >= s THEN bs - s ELSE 0 END AS at, CASE WHEN bs >= s THEN 0 ELSE qlen - n END AS skip, n FROM mt")
def partial_appearances(spark, d):
    return T.partial_appearances(_patterns(spark, d), "seq_id")


@query(f"""WITH {_PAT}, cu AS (SELECT DISTINCT seq_id, pos FROM seq WHERE pos % 7 = 0), ax AS (SELECT DISTINCT oc.seq_id, p, len, pos - s AS cut FROM oc JOIN cu ON cu.seq_id = oc.seq_id AND pos > s AND pos < e UNION SELECT seq_id, p, len, 0 FROM pt),
pc AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY seq_id, p, len ORDER BY cut), len) AS nx FROM ax) SELECT DISTINCT pc.seq_id, (pc.p + cut)::INT AS p, (nx - cut)::INT AS len, array_to_string(t, ',') AS t FROM pc JOIN pt ON pt.seq_id = pc.seq_id AND pt.p = pc.p AND pt.len = pc.len""")
def divided_patterns(spark, d):
    cuts = A.sequences(spark, d).where("pos % 7 = 0").select("seq_id", "pos")
    return _joined(T.divided(_patterns(spark, d), cuts, "seq_id")).withColumn("p", F.col("p").cast("int"))


@query(f"""WITH {_PAT}, ea AS (SELECT seq_id, p, len, unnest(t) AS t FROM pt), fq AS (SELECT seq_id, t, count(*) AS fr FROM ea GROUP BY ALL), ar AS (SELECT *, sum(w) OVER (PARTITION BY seq_id, p, len ORDER BY t) AS area FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY seq_id, p, len ORDER BY t) > 3)::INT, 0) AS w FROM ea)),
be AS (SELECT ar.seq_id, p, len, area, arg_min(ar.t, (-fr, ar.t)) AS t FROM ar JOIN fq ON fq.seq_id = ar.seq_id AND fq.t = ar.t GROUP BY ALL) SELECT seq_id, p, len, string_agg(t, ',' ORDER BY t) AS t FROM be GROUP BY ALL HAVING count(*) > 1""")
def sparse_patterns(spark, d):
    return _joined(T.sparse(_patterns(spark, d), "seq_id", 3))


@query(f"""WITH {_PAT}, ow AS (SELECT seq_id, p, len, unnest(t) AS t FROM pt), al AS (SELECT * FROM ow UNION SELECT b.seq_id, b.p, b.len, a.t FROM ow a JOIN pt b ON a.seq_id = b.seq_id AND a.p <= b.p AND b.p + b.len <= a.p + a.len) SELECT seq_id, p, len, string_agg(t, ',' ORDER BY t) AS t FROM al GROUP BY ALL""")
def integrate_patterns(spark, d):
    return _joined(T.integrated(_patterns(spark, d), "seq_id"))


@query("""WITH a AS (SELECT * FROM run WHERE len >= 3), r AS (SELECT * FROM run WHERE len >= 5), x AS (SELECT a.seq_id, a.i0, a.j0, a.len, min(abs((a.j0 - a.i0) - (r.j0 - r.i0))) AS dist FROM a JOIN r ON r.seq_id = a.seq_id AND a.i0 < r.i0 + r.len AND r.i0 < a.i0 + a.len WHERE (a.j0 - a.i0) <> (r.j0 - r.i0) GROUP BY ALL)
SELECT a.seq_id, a.i0, a.j0, a.len, dist FROM a LEFT JOIN x ON x.seq_id = a.seq_id AND x.i0 = a.i0 AND x.j0 = a.j0 AND x.len = a.len WHERE dist IS NULL OR dist >= 4""")
def remove_close_occs(spark, d):
    s = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 3")
    return T.far_from(s, s.where("len >= 5"), "seq_id", 4)


@query()
def hierarchical_patterns(spark, d):
    segs = M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 4")

    def f(rows):
        return T.hierarchical_patterns(rows, max(j + m for _, j, m in rows), 3)

    return K.per_rows(segs, "seq_id", ["i0", "j0", "len"], f, "i0 int, j0 int, len int")
