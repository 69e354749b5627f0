"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WARC = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (
  SELECT *, octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first AS again
  FROM (SELECT *, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
)
"""

_REPUTATION = r"""
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    try_cast(regexp_extract(url, '^[^:]*://[^/?#]*/[a-z]+/([0-9]+)', 1) AS bigint) AS doc_id
  FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), outcome AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), named AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(host, '.') AS l FROM cut LEFT JOIN outcome USING (doc_id) GROUP BY host
), cuts AS (
  SELECT *, CASE WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS deep FROM named
), hosts AS (
  SELECT host, n, bad, array_to_string(l[-deep:], '.') AS suffix, array_to_string(l[-(deep + 1):], '.') AS domain FROM cuts
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL
), s0 AS (
  SELECT *, (SELECT (coalesce(sum(bad), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1.0e0) FROM suffixes) AS m FROM suffixes
), s1 AS (
  SELECT *, (bad + k * m) / (n + k) AS share FROM s0, (SELECT {strength} AS k FROM s0)
), d0 AS (
  SELECT d.*, s1.share AS m FROM domains d JOIN s1 USING (suffix)
), d1 AS (
  SELECT *, (bad + k * m) / (n + k) AS share FROM d0, (SELECT {strength} AS k FROM d0)
), h0 AS (
  SELECT h.*, d1.share AS m FROM hosts h JOIN d1 USING (domain)
), h1 AS (
  SELECT *, (bad + k * m) / (n + k) AS share FROM h0, (SELECT {strength} AS k FROM h0)
), verdicts AS (
  SELECT host, CASE WHEN share - 1.645 * sqrt(share * (1 - share) / (k + n + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM h1
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fitting AS (
  SELECT page_id, host, path, own, action, rhost || rpath AS rule
  FROM cut JOIN verdicts USING (host) LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, own) AS verdict FROM fitting
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
""".replace(
    "{strength}",
    "1 / greatest(0.001, least(0.9, coalesce((sum(CASE WHEN n > 0 THEN (bad / n - m) ** 2 * n / (m * (1 - m)) END) - count(CASE WHEN n > 0 THEN 1 END)) "
    "/ sum(CASE WHEN n > 1 THEN n - 1 END), 0.1))) - 1",
)

_COMPONENTS = """
, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a)
"""

_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM texts
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS common
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.doc_id, y.doc_id
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 90 * (na + nb - common)),
nodes AS (SELECT doc_id AS id FROM documents)
{components}
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id
FROM sets s JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON s.doc_id = c.id
""".replace("{components}", _COMPONENTS)

_LEAKS = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, t)),
struck AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN struck USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id AS id, label, embedding::double[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.93
), nodes AS (SELECT vec_id AS id FROM embeddings)
{components},
counts AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a)
SELECT c.id AS vec_id, coalesce(n, 0) AS n_links, c.component_id, c.id = c.component_id AS kept
FROM (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c LEFT JOIN counts USING (id)
""".replace("{components}", _COMPONENTS)

_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p, 1 + (1000000000::hugeint * (k.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM grid WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM found)
SELECT lang, source, part, item, value::bigint AS value, k::integer AS rank FROM ranked WHERE part = 'pair' OR k <= 200
"""

ORACLES: dict[str, str] = {
    "op2_warc_revisits": _WARC,
    "op3_host_reputation": _REPUTATION,
    "op7_ngram_join": _JOIN,
    "op9_decontaminate": _LEAKS,
    "op10_embedding_dedup": _EMBEDDINGS,
    "op12_divergence_cube": _DIVERGENCE,
}
