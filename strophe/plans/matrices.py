"""Similarity matrices, alignment and boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matrices as M
from ..operators import statistics as S
from ..operators import tiles as T
from ..sources import adapters as A
from .registry import query
from .statistics import _PAIRS

_N = "n AS (SELECT seq_id, count(*)::INT AS n FROM seq GROUP BY 1)"
_TIMES = '"start"'


@query("SELECT label, i, j, round(v, 6) + 0.0 AS v FROM ssm WHERE i < j")
def ssm_cosine(spark, d):
    return M.ssm(A.features(spark, d), "label", upper=True).where("i < j").withColumn("v", F.round("v", 6) + 0.0)


@query("SELECT seq_id, i, j FROM cell")
def equality_matrix(spark, d):
    return M.equality_cells(A.sequences(spark, d))


@query("WITH z AS (SELECT label, max(i) + 1 AS n FROM ssm GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY label, i ORDER BY v DESC, j) AS k FROM ssm) SELECT k.label, i, j FROM k JOIN z ON z.label = k.label WHERE k <= 2 * ceil(sqrt(n * 0.5 - 1)) AND j > i")
def knn_threshold(spark, d):
    f = A.features(spark, d)
    return M.nearest_cells(f, f, ["label"], 0.5).where("j > i")


@query("""WITH s AS (SELECT label, i, j, round(coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0), 9) AS v FROM ssm WINDOW w AS (PARTITION BY label, j)), c AS (SELECT label, round(quantile_cont(v, 0.9), 9) AS cut FROM s GROUP BY 1)
SELECT s.label, i, j FROM s JOIN c ON c.label = s.label WHERE v >= cut AND j > i""")
def percentile_threshold(spark, d):
    f = A.features(spark, d)
    return T.above_percentile(f, f, ["label"], 90).where("j > i")


@query("""SELECT label, i, j FROM (SELECT label, i, j, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ssm WINDOW w AS (PARTITION BY label, i ORDER BY j)) WHERE a < v AND b < v AND v >= 0.25 AND j > i""")
def peak_threshold(spark, d):
    f = A.features(spark, d)
    return T.peaks(f, f, ["label"], 0.25).where("j > i")


@query("""WITH pk AS (SELECT label, i, j, v FROM (SELECT label, i, j, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ssm WINDOW w AS (PARTITION BY label, i ORDER BY j)) WHERE a < v AND b < v AND v >= 0.1),
o AS (SELECT label, i, list(j ORDER BY v DESC, j DESC) AS js FROM pk GROUP BY ALL)
SELECT label, i, unnest(list_reduce(list_prepend([]::INT[], list_transform(js, lambda j: [j::INT])), lambda kept, x: CASE WHEN list_bool_and(list_transform(kept, lambda k: abs(k - x[1]) >= 5)) IS NOT false THEN list_concat(kept, x) ELSE kept END)) AS j FROM o""")
def peaks_apart(spark, d):
    f = A.features(spark, d)
    return T.peaks(f, f, ["label"], 0.1, 5)


def _smooth(cells: str, keys: str, lo: str, hi: str, size: str, r: int) -> str:
    k = keys.replace(",", " || ',' || ")
    on = lambda a, b: " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in keys.split(","))
    med = lambda v: f"CASE WHEN count(*) OVER f = {2 * r + 1} AND sum({v}) OVER f > {r} THEN 1 WHEN count(*) OVER f = {2 * r + 1} THEN 0 ELSE {v} END"
    win = f"WINDOW f AS (PARTITION BY {keys}, d ORDER BY i ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    del k
    return f"""raw AS ({cells}), dl AS (SELECT DISTINCT {keys}, j - i AS d FROM raw), sp AS (SELECT {', '.join('dl.' + c.strip() for c in keys.split(','))}, dl.d, unnest(range({lo}, {hi})) AS i FROM dl JOIN {size} ON {on('dl', 'n')}),
sv AS (SELECT sp.*, (raw.i IS NOT NULL)::INT AS raw FROM sp LEFT JOIN raw ON {on('raw', 'sp')} AND raw.i = sp.i AND raw.j - raw.i = sp.d), s1 AS (SELECT *, greatest({med('raw')}, raw) AS once FROM sv {win}), s2 AS (SELECT {keys}, d, i, raw, {med('once')} AS v FROM s1 {win}), sm AS (SELECT * FROM s2 WHERE v = 1)"""


def _segments(keys: str, least: int, ratio: float) -> str:
    return f"""rn AS (SELECT *, i - row_number() OVER (PARTITION BY {keys}, d ORDER BY i) AS g FROM sm), sg AS (SELECT {keys}, d, min(i) FILTER (raw = 1) AS i0, max(i) FILTER (raw = 1) AS i1, sum(raw) AS hits FROM rn GROUP BY {keys}, d, g),
segs AS (SELECT {keys}, i0::INT AS i0, (i0 + d)::INT AS j0, (i1 - i0 + 1)::INT AS len FROM sg WHERE hits > 1 AND i1 - i0 + 1 >= {least} AND hits >= round((1 - {ratio}) * (i1 - i0 + 1), 9))"""


_SELF = f"{_N}, {_smooth('SELECT * FROM cell', 'seq_id', 'greatest(0, -d)', 'n - d', 'n', 2)}, {_segments('seq_id', 5, 0.4)}, al AS (SELECT * FROM segs WHERE j0 - i0 >= 5)"


@query(f"WITH {_N}, {_smooth('SELECT * FROM cell', 'seq_id', 'greatest(0, -d)', 'n - d', 'n', 2)} SELECT seq_id, i::INT AS i, (i + d)::INT AS j, raw FROM sm")
def diag_smooth(spark, d):
    s = A.sequences(spark, d)
    n = M.lengths(s).select("seq_id", F.col("n").alias("ni"), F.col("n").alias("nj"))
    return M.smoothed(M.equality_cells(s), n, ["seq_id"], 2).select("seq_id", F.col("i").cast("int").alias("i"), (F.col("i") + F.col("d")).cast("int").alias("j"), "raw")


@query("SELECT seq_id, i0, j0, len FROM run")
def diag_segments(spark, d):
    return M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"])


@query("SELECT seq_id, i0, j0, len FROM run WHERE len >= 3")
def symbol_runs(spark, d):
    return M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]).where("len >= 3")


@query(f"WITH {_SELF} SELECT * FROM al")
def self_align(spark, d):
    return M.self_align(A.sequences(spark, d), 5, 1, 2, 0.4)


_MUTUAL = f"{_PAIRS.format(11)}, z AS (SELECT seq_id, count(*)::INT AS n FROM seq GROUP BY 1), n AS (SELECT a, b, x.n AS ni, y.n AS nj FROM pairs JOIN z x ON x.seq_id = a JOIN z y ON y.seq_id = b), {_smooth('SELECT a, b, x.pos AS i, y.pos AS j FROM pairs JOIN seq x ON x.seq_id = a JOIN seq y ON y.seq_id = b AND x.sym = y.sym', 'a, b', 'greatest(0, -d)', 'least(ni, nj - d)', 'n', 2)}, {_segments('a, b', 6, 0.4)}"


@query(f"WITH {_MUTUAL} SELECT * FROM segs")
def mutual_align(spark, d):
    s = A.sequences(spark, d)
    return M.mutual_align(s, S.pairings(s), 6, 2, 0.4)


@query("SELECT seq_id, j, count(*) AS n FROM (SELECT seq_id, unnest(CASE WHEN len > 1 THEN [j0, j0 + len - 1] ELSE [j0] END) AS j FROM run) GROUP BY ALL")
def endpoint_hist(spark, d):
    return M.endpoint_hist(M.diag_segments(M.equality_cells(A.sequences(spark, d)), ["seq_id"]), ["seq_id"])


_RATE, _TOTAL = M.checkerboard(5, 0.5)
_CURVE = f"""z AS (SELECT label, max(i) + 1 AS n FROM ssm GROUP BY 1), nv AS (SELECT s.label, p.pos, sum(sign(i - pos) * sign(j - pos) * exp(-{_RATE} * ((i - pos) ** 2 + (j - pos) ** 2)) / {_TOTAL} * v) AS novelty
FROM (SELECT label, unnest(range(0, n)) AS pos FROM z) p JOIN ssm s ON s.label = p.label AND abs(i - pos) <= 5 AND abs(j - pos) <= 5 GROUP BY ALL)"""


@query(f"WITH {_CURVE} SELECT label, pos::INT AS pos, round(novelty, 6) + 0.0 AS novelty FROM nv")
def novelty_curve(spark, d):
    return M.novelty_curve(M.ssm(A.features(spark, d), "label", within=10), ["label"], 5).withColumn("novelty", F.round("novelty", 6) + 0.0)


_GAUSS = sum(__import__("math").exp(-0.5 * (k / 1.0) ** 2) for k in range(-4, 5))


@query(f"""WITH {_CURVE}, g AS (SELECT a.label, a.pos, sum(b.novelty * exp(-0.5 * k ** 2) / {_GAUSS}) AS s FROM (SELECT nv.label, pos, n, unnest(range(-4, 5)) AS k FROM nv JOIN z ON z.label = nv.label) a
JOIN nv b ON b.label = a.label AND b.pos = CASE WHEN ((pos + k) % (2 * n) + 2 * n) % (2 * n) < n THEN ((a.pos + k) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((a.pos + k) % (2 * n) + 2 * n) % (2 * n) END GROUP BY ALL),
m AS (SELECT a.label, a.pos, list_sort(list(b.s))[5] AS med FROM (SELECT g.label, pos, n, unnest(range(-4, 4)) AS k FROM g JOIN z ON z.label = g.label) a
JOIN g b ON b.label = a.label AND b.pos = CASE WHEN ((a.pos + k) % (2 * n) + 2 * n) % (2 * n) < n THEN ((a.pos + k) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((a.pos + k) % (2 * n) + 2 * n) % (2 * n) END GROUP BY a.label, a.pos),
o AS (SELECT label, avg(novelty) * 0.05 AS o FROM nv GROUP BY 1), x AS (SELECT g.label, g.pos, s, med + o AS t, lag(s) OVER w AS a, lead(s) OVER w AS b FROM g JOIN m ON m.label = g.label AND m.pos = g.pos JOIN o ON o.label = g.label WINDOW w AS (PARTITION BY g.label ORDER BY g.pos))
SELECT label, pos::INT AS pos FROM x WHERE a < s AND s > b AND s > t""".replace("CASE WHEN ((pos", "CASE WHEN ((a.pos"))
def novelty_peaks(spark, d):
    curve = M.novelty_curve(M.ssm(A.features(spark, d), "label", within=10), ["label"], 5)
    return M.novelty_peaks(curve, ["label"], 8, 0.05, 1.0)


def _pruned(rows: str) -> str:
    return f"""bd AS ({rows}), gr AS (SELECT *, sum(w) OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) > 1)::INT, 0) AS w FROM bd)),
gs AS (SELECT seq_id, g, min(pos) AS a, max(pos) AS b FROM gr GROUP BY ALL), pr AS (SELECT seq_id, CASE WHEN g = max(g) OVER (PARTITION BY seq_id) THEN a ELSE b END AS pos FROM gs)"""


@query(f"""WITH {_N}, ce AS (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM run WHERE len >= 4) UNION SELECT seq_id, pos, pos FROM seq),
ls AS (SELECT n.seq_id, x.i, n.n, coalesce(max(j), any_value(n.n) - 1) AS last FROM n JOIN (SELECT seq_id, unnest(range(0, n)) AS i FROM n) x ON x.seq_id = n.seq_id LEFT JOIN ce ON ce.seq_id = x.seq_id AND ce.i = x.i GROUP BY n.seq_id, x.i, n.n), mx AS (SELECT *, max(last) OVER (PARTITION BY seq_id ORDER BY i) AS most FROM ls),
{_pruned('SELECT seq_id, i AS pos FROM mx WHERE most = i AND last = i')} SELECT pr.seq_id, (pos + 1)::INT AS pos FROM pr JOIN n ON n.seq_id = pr.seq_id WHERE pos + 1 < n""")
def binary_boundaries(spark, d):
    s = A.sequences(spark, d)
    cells = M.segment_cells(M.diag_segments(M.equality_cells(s), ["seq_id"]).where("len >= 4"), ["seq_id"])
    cells = cells.unionByName(s.select("seq_id", F.col("pos").alias("i"), F.col("pos").alias("j")))
    return M.binary_boundaries(cells, M.lengths(s), ["seq_id"]).withColumn("pos", F.col("pos").cast("int"))


@query(f"""WITH {_N}, onw AS (SELECT DISTINCT a.seq_id, a.i FROM cell a JOIN cell b ON a.seq_id = b.seq_id AND a.i = b.i + 1 AND a.j = b.j + 1), {_pruned('SELECT x.seq_id, x.i AS pos FROM (SELECT seq_id, unnest(range(1, n)) AS i FROM n) x ANTI JOIN onw ON onw.seq_id = x.seq_id AND onw.i = x.i')}
SELECT seq_id, (pos + 1)::INT AS pos FROM pr""")
def discontinuity_boundaries(spark, d):
    s = A.sequences(spark, d)
    return M.discontinuity_boundaries(M.equality_cells(s), M.lengths(s), ["seq_id"]).withColumn("pos", F.col("pos").cast("int"))


@query(f"""WITH {_N}, si AS (SELECT seq_id, (2 ** unnest(range(2, floor(log2(n))::INT + 1)))::INT AS k FROM n), bx AS (SELECT c.seq_id, k, i // k AS bi, j // k AS bj, count(*) AS s FROM cell c JOIN si ON si.seq_id = c.seq_id GROUP BY ALL),
nb AS (SELECT seq_id, k, count(*) AS b FROM bx WHERE s < k * k GROUP BY ALL) SELECT seq_id, round(-regr_slope(ln(b), ln(k)), 6) AS dimension FROM nb GROUP BY seq_id""")
def fractal_dimension(spark, d):
    s = A.sequences(spark, d)
    return M.fractal_dimension(M.equality_cells(s), M.lengths(s), ["seq_id"]).withColumn("dimension", F.round("dimension", 6))


def _rating(segs: str, length: str) -> str:
    return f"""WITH {_N}, sg AS ({segs}), rw AS (SELECT seq_id, i, count(*) AS c FROM (SELECT DISTINCT seq_id, i0 + k AS i, j0 + k AS j FROM (SELECT *, unnest(range(0, len)) AS k FROM sg)) GROUP BY ALL),
rs AS (SELECT seq_id, count(*) AS filled, sum(c) AS s, sum(c * c) AS ss FROM rw GROUP BY 1), le AS (SELECT seq_id, {length}(len) AS length FROM sg GROUP BY 1)
SELECT n.seq_id, round(coalesce(filled / n * ln(length) / nullif(sqrt(greatest(0, ss / n - (s / n) ** 2)) / (s / n), 0), 0), 6) AS rating FROM n LEFT JOIN rs ON rs.seq_id = n.seq_id LEFT JOIN le ON le.seq_id = n.seq_id"""


@query(_rating("SELECT * FROM run WHERE len > 2", "avg"))
def matrix_rating_s(spark, d):
    s = A.sequences(spark, d)
    return M.matrix_rating(M.equality_cells(s), M.lengths(s), ["seq_id"], False).withColumn("rating", F.round("rating", 6))


@query(_rating("SELECT * FROM run", "max"))
def matrix_rating_b(spark, d):
    s = A.sequences(spark, d)
    return M.matrix_rating(M.equality_cells(s), M.lengths(s), ["seq_id"], True).withColumn("rating", F.round("rating", 6))
