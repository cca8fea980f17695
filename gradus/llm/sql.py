"""DuckDB SQL for the numbered operators that SQL can express, by another way than theirs."""

from __future__ import annotations

from .common import LOWER, UPPER
from .secrets import BASE, RULES

ORACLES: dict[str, str] = {}

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# The level of the rest is found by trying each source's own full level.
ORACLES["op2_mixing"] = f"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('mix' || coalesce(CAST(documents.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)
  / CASE WHEN q IS NULL THEN 1e0 WHEN q > 0 THEN 2e0 ELSE 0.5e0 END AS key FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3e0, 1e0, 2e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
tried AS (SELECT a.source, 2e0 * a.source_size / a.w AS full_at, sum(least(2e0 * b.source_size, 2e0 * a.source_size / a.w * b.w)) AS f FROM s a, s b GROUP BY ALL),
closed AS (SELECT coalesce(max(full_at), -1) AS upto FROM tried WHERE f <= (SELECT 1.5e0 * sum(source_size) FROM s)),
level AS (SELECT (1.5e0 * sum(source_size) - coalesce(sum(2e0 * source_size) FILTER (2e0 * source_size / w <= upto), 0)) / sum(w) FILTER (2e0 * source_size / w > upto) AS l FROM s, closed GROUP BY upto),
g AS (SELECT source, source_size, least(2e0 * source_size, coalesce(l * w, 2e0 * source_size)) AS target FROM s, level),
o AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs,
  sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(epochs * size + least(greatest(round(target - epochs * source_size) - before, 0), size) AS BIGINT) AS taken FROM o"""

ORACLES["op3_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WORDS}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON d.doc_id = a"""

ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, n, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m.keep <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.keep <> p.page_id THEN m.keep END AS refers_to
FROM p LEFT JOIN m ON p.d = m.d AND p.n = m.n"""

# Every run of words as long as some window is looked up.
ORACLES["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
g AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, s, n, item FROM g JOIN win USING (g, n)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""


def _secrets() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for rank, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"SELECT r, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs, string_split_regex(t, {p}) AS ps, {r.least} AS least_n FROM d WHERE regexp_matches(t, {p})")
    upto = lambda c, j: f"coalesce(list_sum(list_transform({c}[1:{j}], lambda x: length(x))), 0)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
m AS ({' UNION ALL '.join(parts)}),
f AS (SELECT r, rank, kind, CAST({upto('ps', 'j')} + {upto('ms', 'j - 1')} AS BIGINT) AS s, length(ms[j]) AS n FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM m) WHERE length(gs[j]) >= least_n),
a AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans,
  string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (kind IN ({base})) AS base FROM f GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""


ORACLES["op10_secret_scan"] = _secrets()

ORACLES["op11_line_dedup"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, p, l[p] AS line, translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM d)),
k AS (SELECT key, max(doc_id) AS last FROM x WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT x.*, k.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM x LEFT JOIN k USING (key)) GROUP BY r"""

# Documents meet orders one by one.
ORACLES["op12_filter_audit"] = rf"""
WITH s AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM t GROUP BY t),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS bad FROM t JOIN e USING (t) LEFT JOIN s ON t.doc_id = s.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
r AS (SELECT part, good, toxic, filter_order, list_transform([1, 2, 3, 4, 5], lambda i: bad[instr('ABCDE', filter_order[i])]) AS b FROM f, o),
g AS (SELECT part, filter_order, step, filter_order[step] AS filter, count(*) FILTER (NOT list_contains(b[1:step], true)) AS kept, count(*) FILTER (here) AS removed,
  count(*) FILTER (b[step] AND NOT here) AS redundant, count(*) FILTER (b[step] AND len(list_filter(b, lambda x: x)) = 1) AS unique_fails, count(*) FILTER (here AND good) AS good_lost, count(*) FILTER (here AND toxic) AS toxic_lost
  FROM (SELECT *, b[step] AND NOT list_contains(b[1:step - 1], true) AS here FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM r)) GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""


def _clusters(k: int = 40, rounds: int = 5) -> str:
    """Every distance in every round; components and centroids as rows."""
    steps = [f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM v),
c0 AS (SELECT c, unnest(range(64)) AS i, unnest(x) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM v) WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (SELECT r, c, CAST(sum((p.x - q.x) * (p.x - q.x)) AS BIGINT) AS d FROM p JOIN c{n} q USING (i) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (r) GROUP BY ALL),
c{n + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN s{n} USING (c, i))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) w ON w.c = m.c"""


ORACLES["op13_clustering"] = _clusters()
