"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import licenses as lic

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lines = f"regexp_replace(replace({lower}, chr(10), chr(10) || chr(10)), {_quoted(lic.COPYRIGHT_LINE)}, chr(10), 'g')"
    out = f"""' ' || replace(trim(regexp_replace({lines}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ', '  ') || ' '"""
    for a, b in lic.EQUIVALENT:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({out}, '  ', ' '))"


def licenses(docs: str = "documents") -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in lic.KNOWN)
    given = ", ".join(f"({_quoted(name)}, {_quoted(digest)})" for name, digest in lic.DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(name) AS license FROM (SELECT sha256({_canonical('body')}) AS digest, name FROM (VALUES {known}) AS k(name, body) UNION ALL SELECT digest, name FROM (VALUES {given}) AS g(name, digest)) GROUP BY 1
), d AS (SELECT doc_id, {_canonical("coalesce(text, '')")} AS canon FROM {docs})
SELECT doc_id, length(canon) AS n_canonical, sha256(canon) AS digest, license FROM d LEFT JOIN known ON known.digest = sha256(canon)
"""


def mixing(docs: str = "documents", share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 17) -> str:
    case = " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM {docs}
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s
), w AS (SELECT *, CASE place % {len(weights)} {case} END AS weight, source_size * {max_epochs}::DOUBLE AS cap FROM p
), r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * {share}::DOUBLE AS budget FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (SELECT ratio AS free_ratio, place AS free_place, level AS free_level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN free_ratio IS NULL OR (ratio, place) < (free_ratio, free_place) THEN cap ELSE free_level * weight END AS target
  FROM l LEFT JOIN f ON true
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0) AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, floor(target - whole * source_size) - ahead)))::BIGINT AS taken FROM x
"""


def warc(pages: str = "pages") -> str:
    """Base32 by groups of five hex digits, that is 20 bits or four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31) + 1, 1)"
    four = " || ".join(letter.format(k) for k in (15, 10, 5, 0))
    groups = " || ".join(four.replace("v >>", f"('0x' || substr(h, {5 * g + 1}, 5))::INT >>") for g in range(8))
    return f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM {pages}
), f AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, {groups} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified FROM f
"""


def nearest(vectors: str = "embeddings", every: int = 20, k: int = 20) -> str:
    """The exact answer, by comparing all; the operator may miss some of it on tables of over a thousand vectors."""
    product = "list_inner_product(q.v, e.v)"
    return f"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM {vectors}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), r AS (
  SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {product} DESC, e.vec_id)::INT AS rank, e.vec_id, {product} AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0
)
SELECT * FROM r WHERE rank <= {k}
"""


def _finite(v: str) -> str:
    return f"{v} IS NOT NULL AND coalesce(list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND isfinite(x))), true)"


def highest(vectors: str = "embeddings", every: int = 50, k: int = 5, factor: int = 256) -> str:
    score = "list_inner_product(q.v, e.v)"
    return f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS v FROM {vectors} WHERE vec_id IS NOT NULL AND {_finite('embedding')}
), r AS (
  SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, e.vec_id)::INT AS rank, e.vec_id, {score}::BIGINT AS score
  FROM e AS q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % {every} = 0
)
SELECT * FROM r WHERE rank <= {k}
"""


def codes(vectors: str = "embeddings", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round is one more table: parts with their nearest entries, then the entries' means."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    out = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM {vectors} WHERE {_finite('embedding')}
), w AS (SELECT max(len(v)) // {parts} AS w FROM e
), v AS MATERIALIZED (SELECT id, vec_id, label, p, list_slice(v, p * w + 1, p * w + w) AS x FROM e, w, range({parts}) AS r(p)
), c0 AS MATERIALIZED (SELECT p, id - 1 AS k, x FROM v WHERE id <= {entries})"""
    for r in range(rounds + 1):
        out += f""", a{r} AS MATERIALIZED (
  SELECT id, v.p, min({{'d': {square}, 'k': c.k}}) AS best FROM v JOIN c{r} AS c ON v.p = c.p GROUP BY ALL
)"""
        if r < rounds:
            out += f""", s{r} AS (
  SELECT p, k, j, floor(sum(y)::DOUBLE / count(*))::BIGINT AS y FROM (SELECT v.p, best.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM v JOIN a{r} AS a ON v.id = a.id AND v.p = a.p) GROUP BY ALL
), c{r + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN (SELECT p, k, list(y ORDER BY j) AS x FROM s{r} GROUP BY ALL) AS m USING (p, k)
)"""
    return (
        out
        + f""", g AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM (SELECT p, k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM c{rounds})
), f AS (SELECT id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN f USING (id), g
"""
    )


def repair(conversations: str = "conversations") -> str:
    """Row by row, the best (cost, audit) for each state that a conversation can be in: 0 nothing said, 1 system, 2 user, 3 assistant. Between rows at most two inserts can help; with more a state comes back."""
    ways = []  # state before, inserted, edit, initial it needs, state after, cost, audit, roles that come in, whether the row's own role stays
    after, spoken = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}
    for state in range(4):
        now, come = state, []
        for n in range(3):
            if n:
                now = after[now]
                come = [*come, f"{spoken[now]}:"]
            lead = "".join(c + "\n" for c in come)
            ways.append((state, "I" * n + "D", "", now, 3 + 2 * n, lead, ""))
            ways.append((state, "I" * n + "R", "", after[now], 2 + 2 * n, lead, spoken[after[now]]))
            for initial, to in ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})[now].items():
                ways.append((state, "I" * n + "K", initial, to, 2 * n, lead, ""))
            ways.append((state, "I" * n, "", now, 2 * n, lead, ""))
    values = ", ".join(f"({a}, '{edit}', '{i}', {b}, {cost}, {_quoted(lead)}, '{role}')" for a, edit, i, b, cost, lead, role in ways)
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM {conversations}
), hashed AS MATERIALIZED (SELECT *, {crc} % 20 AS n FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE WHEN n = 3 THEN 2 ELSE 1 END) WHERE n <> 0
), placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS initial FROM hurt
), marked AS (
  SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS seen, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair FROM placed
), r AS MATERIALIZED (SELECT *, blank OR seen AS must, cut AND NOT blank AND NOT seen AS charged FROM marked
), way(state, edits, needs, next, cost, lead, speaks) AS (VALUES {values}
), step AS (
  SELECT conv, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS best FROM r GROUP BY conv
  UNION ALL
  SELECT s.conv, s.i + 1, w.next, min({{'cost': s.best.cost + w.cost + CASE WHEN r.charged AND NOT w.edits LIKE '%D' THEN 1 ELSE 0 END, 'audit': s.best.audit || w.edits,
    'said': s.best.said || w.lead || CASE WHEN w.edits LIKE '%D' THEN '' WHEN w.speaks = '' THEN r.role || ':' || r.text || chr(10) ELSE w.speaks || ':' || r.text || chr(10) END}})
  FROM step AS s JOIN r ON r.conv = s.conv AND r.i = s.i + 1 JOIN way AS w ON w.state = s.state
  WHERE w.edits LIKE '%D' OR (NOT r.must AND (w.edits LIKE '%R' OR (w.edits LIKE '%K' AND w.needs = r.initial)))
  GROUP BY s.conv, s.i, w.next
), ended AS (
  SELECT conv, min({{'cost': s.best.cost + w.cost, 'audit': s.best.audit || w.edits, 'said': s.best.said || w.lead}}) AS best
  FROM step AS s JOIN (SELECT conv, max(i) AS i FROM r GROUP BY conv) USING (conv, i) JOIN way AS w ON w.state = s.state AND w.next IN (0, 3) AND NOT regexp_matches(w.edits, '[KRD]') GROUP BY conv
), counted AS (
  SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank, count(*) FILTER (seen AND NOT blank)::BIGINT AS duplicate,
    count(*) FILTER (charged)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM r GROUP BY conv_id, conv
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.said, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {conversations}) AS k LEFT JOIN counted AS c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended USING (conv)
"""
