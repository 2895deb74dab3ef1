"""SQL twins of the opN queries that SQL can express whole, for DuckDB over the same tables."""

_WORDS = r"'[^ \t\n\v\f\r]+'"
_TERMS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLES = {
    "op6_substrings": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM w),
win AS (SELECT doc_id, i, list_aggregate(ws[i + 1 : i + 20], 'string_agg', ' ') AS seq FROM p WHERE i + 20 <= len(ws)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM again),
kept AS (SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.ws[p.i + 1], ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS text FROM p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i + 1 : i + 5], 'string_agg', ' ') AS sh FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p, q FROM c JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * common >= 80 * (a.n + b.n - common)),
r(id, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, e.q FROM r JOIN e ON e.p = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.least, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT id, min(node) AS least FROM r GROUP BY id) m ON m.id = w.doc_id
""",
    "op11_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, {_TERMS})) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM g JOIN vocabulary k USING (lang) JOIN v USING (lang) LEFT JOIN totals s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_filter_audit": rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
f AS (SELECT doc_id, part,
  (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
prefixes AS (SELECT '' AS prefix, 0 AS mask, 0 AS bit, 0 AS step UNION ALL SELECT prefix || letter, mask | letters.bit, letters.bit, step + 1 FROM prefixes JOIN letters ON mask & letters.bit = 0),
steps AS (SELECT o.prefix AS filter_order, p.step, p.mask, p.bit FROM prefixes o JOIN prefixes p ON o.step = 5 AND p.step > 0 AND starts_with(o.prefix, p.prefix)),
counted AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (fails & mask = 0), 0) AS kept, coalesce(sum(n) FILTER (fails & mask = bit), 0) AS removed,
  coalesce(sum(n) FILTER (fails & bit > 0 AND fails & (mask - bit) > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (fails & mask = bit), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails & mask = bit), 0) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
""",
}
