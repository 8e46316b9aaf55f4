"""The registry of queries, and SQL for the canonical tables they start from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: DuckDB SQL of the canonical tables, by name; each may use those before it.
TABLES = {
    "seq": """SELECT user_id AS seq_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS sym, event_type AS sym_name, epoch(ts) AS t FROM events""",
    "seq_role": """SELECT conv_id AS seq_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1)::INT AS pos, (dense_rank() OVER (ORDER BY role) - 1)::INT AS sym FROM conversations""",
    "seq_orders": """SELECT o_custkey AS seq_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_orderpriority) - 1)::INT AS pos, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INT AS sym FROM orders""",
    "feat": """SELECT vec_id, embedding::DOUBLE[] AS vec, label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS pos FROM embeddings""",
    "grid": """SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY t, pos) - 1)::INT AS pos, t FROM seq WHERE sym_name = 'view'""",
    "onsets": """SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY t, pos) - 1)::INT AS pos, t FROM seq WHERE sym_name = 'click'""",
    "iv": """SELECT seq_id, pos, t AS "start", lead(t, 1, 'inf'::DOUBLE) OVER (PARTITION BY seq_id ORDER BY pos) AS "end" FROM grid""",
    "hier": """SELECT item, level, (row_number() OVER w - 1)::INT AS seg, "start", coalesce(lead("start") OVER w, last + 1) AS "end", label FROM (
  SELECT item, level, k, min(t0) AS "start", max(t1) AS last, arg_min(sym_name, (-n, sym_name)) AS label FROM (
    SELECT seq_id AS item, level, k, sym_name, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM (
      SELECT *, 0 AS level, floor((t - 4 * 86400) / (7 * 86400))::BIGINT AS k FROM seq UNION ALL SELECT *, 1, floor(t / 86400)::BIGINT FROM seq
      UNION ALL SELECT seq_id, pos, sym, sym_name, t, 2, sum(new) OVER (PARTITION BY seq_id ORDER BY t, pos) FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY seq_id ORDER BY t, pos) > 21600)::INT, 0) AS new FROM seq)
    ) GROUP BY ALL) GROUP BY item, level, k) WINDOW w AS (PARTITION BY item, level ORDER BY "start")""",
    "lab": """SELECT item, level, pos, coalesce(code, -1)::INT AS label FROM (
  SELECT g.seq_id AS item, l.level, g.pos, (SELECT arg_max(h.label, h."start") FROM hier h WHERE h.item = g.seq_id AND h.level = l.level AND h."start" <= g.t) AS name FROM grid g CROSS JOIN (SELECT unnest([0, 1, 2]) AS level) l
) LEFT JOIN (SELECT sym_name, min(sym) AS code FROM seq GROUP BY 1) ON sym_name = name""",
    "result": """SELECT item, param1, param2, ref, method, p, r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS l FROM (
  SELECT l_suppkey AS item, floor(l_quantity / 20)::INT AS param1, l_linenumber % 2 AS param2, l_linestatus AS ref, l_returnflag AS method, round(avg(l_discount) * 8, 6) AS p, round(avg(l_tax) * 10, 6) AS r FROM lineitem GROUP BY ALL)""",
    "dated": """SELECT c_mktsegment AS grp, o_orderkey AS version, o_orderdate::DATE AS date, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cell": """SELECT a.seq_id, a.pos AS i, b.pos AS j FROM seq a JOIN seq b ON a.seq_id = b.seq_id AND a.sym = b.sym AND a.pos < b.pos""",
    "run": """SELECT seq_id, min(i) AS i0, min(j) AS j0, count(*)::INT AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY seq_id, j - i ORDER BY i) AS g FROM cell) GROUP BY seq_id, j - i, g""",
    "ssm": """SELECT a.label, a.pos AS i, b.pos AS j, list_cosine_similarity(a.vec, b.vec) AS v FROM feat a JOIN feat b ON a.label = b.label""",
}


def _needed(sql: str) -> list[str]:
    out: list[str] = []
    for name in reversed(TABLES):
        if re.search(rf"\b{name}\b", sql) or any(re.search(rf"\b{name}\b", TABLES[o]) for o in out):
            out.append(name)
    return out[::-1]


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL that may use the canonical tables."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            with_ = ", ".join(f"{n} AS ({TABLES[n]})" for n in _needed(sql))
            own = sql.strip()
            if own.upper().startswith("WITH RECURSIVE "):
                head, own = "WITH RECURSIVE ", own[15:]
            elif own.upper().startswith("WITH "):
                head, own = "WITH ", own[5:]
            else:
                head, own = "WITH ", None
            SQL[f.__name__] = (f"{head}{with_}{', ' if with_ else ''}{own}" if own else f"WITH {with_} {sql}" if with_ else sql).strip()
        return f

    return keep
