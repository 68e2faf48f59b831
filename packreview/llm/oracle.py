"""SQL for DuckDB of the queries that it can express on whole tables: secrets, vectors, near-duplicates, decontamination,
divergence of sources, spelling variants."""

from __future__ import annotations

from packreview.llm import secrets

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(order: int, rule: secrets.Rule) -> str:
    """The rule's matches as (doc_id, ord, kind, s, e): a match begins after the gaps and matches before it."""
    pattern = rule.pattern.replace("'", "''")
    group = f"length(regexp_extract_all(t, '{pattern}', {rule.group})[i]) >= {rule.least}" if rule.least else "true"
    chars = lambda xs, n: f"coalesce(list_sum(list_transform({xs}[1:{n}], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {order} AS ord, '{rule.name}' AS kind, s, s + length(hits[i]) AS e FROM (
  SELECT *, {chars('gaps', 'i')} + {chars('hits', 'i - 1')} AS s FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d))) WHERE {group}"""


_SPAN = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord)"
_BASE = ", ".join(f"'{k}'" for k in secrets.BASE)
OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_rule(i, r) for i, r in enumerate(secrets.RULES))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
  coalesce({_SPAN} FILTER (kind IN ({_BASE})), '') AS base, {_SPAN} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN g ON g.doc_id = d.doc_id"""

#: Components of links l(a, b) given both ways: the smallest id that a chain of links reaches.
_REACH = """reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
comp AS (SELECT a AS id, least(a, min(b)) AS component FROM reach GROUP BY a)"""

OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
{_REACH}
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id, e.vec_id = coalesce(component, e.vec_id) AS kept FROM embeddings e
 LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = e.vec_id LEFT JOIN comp ON comp.id = e.vec_id"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
  WHEN len(w) > 0 THEN ['one ' || array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_REACH}
SELECT n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id, n.doc_id = coalesce(component, n.doc_id) AS kept FROM n LEFT JOIN comp ON comp.id = n.doc_id"""

_WORDS = f"regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (
  SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
place AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
o AS (SELECT doc_id, i, place.k AS k, item_id FROM place JOIN win ON win.k = place.k AND win.g = place.g),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
 FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_OP12_P = "1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v)"
_OP12_F = "((g.p - h.p) * (g.p - h.p)) // h.p"
OP12 = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_FOLD} AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
  (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang, source FROM d) g),
p AS (SELECT grp.lang, grp.source, k.term, coalesce(n, 0) AS n, {_OP12_P} AS p FROM grp JOIN kept k USING (lang) LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = k.term),
q AS (SELECT lang, term, {_OP12_P} AS p FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM grp GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (SELECT g.lang, g.source AS s, h.source AS o, sum({_OP12_F}) AS f FROM p g JOIN p h ON h.lang = g.lang AND h.term = g.term AND h.source <> g.source GROUP BY ALL) x ON x.lang = a.lang AND x.s = a.source AND x.o = b.source),
terms AS (SELECT g.lang, g.source, g.term AS item, {_OP12_F} AS value FROM p g JOIN q h ON h.lang = g.lang AND h.term = g.term WHERE g.n > 0 AND g.p > h.p)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
 FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms) QUALIFY part = 'pair' OR rank <= 200"""

#: CRC-32 by the reflected polynomial EDB88320, over the UTF-8 bytes of characters under U+0100.
_CRC_BYTES = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
OP13 = f"""WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT key, run, count(*) AS c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run FROM (
  SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, c, {_CRC_BYTES} AS h FROM o, crc_table),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM place),
less AS (SELECT DISTINCT word, n, head || tail AS other FROM cut),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON b.i = a.i AND b.head = a.head AND b.tail = a.tail AND b.word <> a.word
 UNION ALL SELECT less.word, less.n, w.word, w.n FROM less JOIN w ON w.word = less.other
 UNION ALL SELECT w.word, w.n, less.word, less.n FROM less JOIN w ON w.word = less.other),
best AS (SELECT word, n, count(*) AS k, arg_max(other, (m, -place)) AS other, max(m) AS m FROM (SELECT *, row_number() OVER (ORDER BY other) AS place FROM near) GROUP BY word, n),
form AS (SELECT word, k, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM best),
chain(word, reached, step) AS (SELECT word, form, 1 FROM form WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN form f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT w.word, form, coalesce(root, w.word) AS root, n, coalesce(k, 0) AS n_near, form_n FROM w LEFT JOIN form ON form.word = w.word
 LEFT JOIN (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word) r ON r.word = w.word"""

ORACLE = {"op3_secrets": OP3, "op4_vectors": OP4, "op9_minhash": OP9, "op10_decontamination": OP10, "op12_divergence": OP12, "op13_spelling": OP13}
