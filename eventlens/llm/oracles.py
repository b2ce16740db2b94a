"""SQL for DuckDB that gives the results of the corpus queries that SQL can express.

Rates and links are spelled out in full here: no prefixes, trees or bounds.
"""

from __future__ import annotations

from eventlens.llm import licenses

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _prior(table: str, mean: str) -> str:
    """Strength of a prior from the scatter of a level."""
    moments = f"SUM(n * ((bad * 1.0::DOUBLE / n - {mean}) ** 2) / ({mean} * (1 - {mean})) - 1) / NULLIF(SUM(n - 1), 0)"
    rho = f"LEAST(GREATEST(COALESCE((SELECT {moments} FROM {table} WHERE n > 0), 0.001), 0.001), 0.5)"
    return f"(SELECT 1 / ({rho})::DOUBLE - 1)"


#: The hosts of the tables have no ports, and registered domains of two labels.
URL_REPUTATION = rf"""
WITH split AS (
  SELECT page_id, translate(COALESCE(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {LOWER}) AS host,
         COALESCE(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         TRY_CAST(regexp_extract(url, '://[^/?#]*/[^?#]*?(\d{{1,18}})[^0-9?#]*(?:[?#]|$)', 1) AS BIGINT) AS number FROM pages),
outcome AS (SELECT host, CASE WHEN len(list_intersect(string_split_regex(host, '[.-]'), ['ads', 'adult', 'bets', 'betting', 'casino', 'escort', 'loans', 'payday',
                   'pharmacy', 'pills', 'poker', 'porn', 'slots', 'tracker', 'viagra', 'xxx'])) > 0 THEN 1 ELSE l.bad END AS bad
            FROM split LEFT JOIN (SELECT doc_id, 1 - MAX(quality) AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1) l ON l.doc_id = number),
h AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, string_split(host, '.')[-1] AS suffix,
             COUNT(bad) AS n, COALESCE(SUM(bad), 0)::BIGINT AS bad FROM outcome GROUP BY 1),
d AS (SELECT domain, suffix, SUM(n)::BIGINT AS n, SUM(bad)::BIGINT AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, SUM(n)::BIGINT AS n, SUM(bad)::BIGINT AS bad, (SELECT (SUM(bad) + 1) / (SUM(n) + 2)::DOUBLE FROM h) AS m FROM h GROUP BY 1),
d1 AS (SELECT d.*, (s.bad - d.bad + k * s.m) / (s.n - d.n + k) AS m FROM d JOIN s USING (suffix), (SELECT {_prior('s', 'm')} AS k)),
h1 AS (SELECT h.*, (d1.bad - h.bad + k * d1.m) / (d1.n - h.n + k) AS m FROM h JOIN d1 USING (domain), (SELECT {_prior('d1', 'm')} AS k)),
post AS (SELECT host, h1.bad + k * m AS a, n - h1.bad + k * (1 - m) AS b FROM h1, (SELECT {_prior('h1', 'm')} AS k)),
judged AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM post),
verdicts AS (SELECT host, ROUND(bound, 6) AS bad_bound, bound / (1 - bound) > 2 * (SELECT ANY_VALUE(m / (1 - m)) FROM s) AS bad FROM judged),
rules(v, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
        FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, fit.rule, COALESCE(fit.verdict, CASE WHEN v.bad THEN 'block' ELSE 'allow' END) AS verdict, v.bad_bound
FROM split p LEFT JOIN fit USING (page_id, host, path) LEFT JOIN verdicts v ON v.host = p.host"""

_TEMPLATES = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in licenses.TEMPLATES)
_PLACES = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in licenses.PHRASES)
_BASE = ", ".join(
    "CASE WHEN len(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + f")) > 0 THEN '{label}' END"
    for p, label in licenses.PHRASES
)
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LICENSES = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS k, translate(COALESCE(text, ''), {LOWER}) AS text FROM documents),
w AS (SELECT doc_id, k, text, list_filter(string_split_regex(text, '{_NOT_WORD}'), lambda x: x <> '') AS w FROM t),
b AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: {_PLACES}) AS places, list_filter([{_BASE}], lambda x: x IS NOT NULL) AS base FROM w),
blocks AS (SELECT k, unnest(string_split_regex(regexp_replace(text, '([.!?;])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+')) AS block FROM t),
paragraphs AS (SELECT k, unnest(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '[\r\n]([ \t\f\v]*[\r\n])+')) AS paragraph FROM t),
spread AS (SELECT k, label, words, list_filter(string_split_regex(paragraph, '{_NOT_WORD}'), lambda x: x <> '') AS w, len(list_distinct(words)) AS m, floor(len(words) / 0.8)::BIGINT AS wide
           FROM paragraphs, (VALUES {_TEMPLATES}) x(label, words)),
windows AS (SELECT k, label, list_max(list_transform(range(1, len(w) + 1), lambda i: len(list_intersect(words, w[i:i + wide - 1])))) * 1.0::DOUBLE / m AS share
            FROM spread WHERE len(list_intersect(words, w)) >= 0.8 * m - 1e-9),
met AS (SELECT * FROM windows UNION ALL SELECT k, label, len(list_intersect(words, string_split_regex(block, '{_NOT_WORD}'))) * 1.0::DOUBLE / len(list_distinct(words)) AS share
        FROM blocks, (VALUES {_TEMPLATES}) x(label, words)),
found AS (SELECT k, list(DISTINCT label) AS labels, MAX(share) AS score FROM met WHERE share >= 0.8 - 1e-9 GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(places) AS n_base, places[1] - 1 AS first_word, places[-1] - 1 AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, COALESCE(labels, [])))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE COALESCE(score, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN found USING (k)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), {LOWER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, COUNT(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common)),
ends AS MATERIALIZED (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT u, v FROM ends UNION SELECT r.u, e.v FROM reach r JOIN ends e ON r.v = e.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, LEAST(doc_id, COALESCE(m, doc_id)) AS component_id, doc_id <= COALESCE(m, doc_id) AS kept
FROM sets LEFT JOIN (SELECT u, MIN(v) AS m FROM reach GROUP BY 1) ON u = doc_id"""

#: Every shortest stretch of lines with 25 words, from each line on and up to each line, compared as text.
LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, k, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
p AS (SELECT *, row_number() OVER o AS pos, SUM(w) OVER o AS e FROM n WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
d AS (SELECT doc_id, list(t ORDER BY pos) AS ts, list(e ORDER BY pos) AS es, list(e - w ORDER BY pos) AS bs FROM p GROUP BY 1),
windows AS (
  SELECT doc_id, ts, pos AS lo, len(list_filter(es, lambda x: x < bs[pos] + 25)) + 1 AS hi FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM d)
  UNION SELECT doc_id, ts, len(list_filter(bs, lambda x: x <= es[pos] - 25)), pos FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS pos FROM d)),
places AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY array_to_string(ts[lo:hi], chr(10)) ORDER BY doc_id, lo) AS place FROM windows WHERE lo > 0 AND hi <= len(ts)),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM places WHERE place > 1),
left_ AS (SELECT p.doc_id, COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL), '') AS text, COUNT(g.pos) AS n FROM p LEFT JOIN gone g USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, CASE WHEN x.n > 0 THEN x.text ELSE d.text END AS text, COALESCE(x.n, 0)::INTEGER AS n_deleted FROM documents d LEFT JOIN left_ x USING (doc_id)"""

ORACLES = {"op5_url_reputation": URL_REPUTATION, "op6_line_dedup": LINE_DEDUP, "op7_licenses": LICENSES, "op9_near_dedup": NEAR_DEDUP}
