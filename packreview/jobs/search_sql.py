"""SQL for DuckDB of the searches in operators.retrieval, as chains of common table expressions, to check them by."""

from __future__ import annotations

#: CRC-32 of a word of ASCII letters and digits, by the reflected polynomial EDB88320 and a table worked out in place.
_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(token, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def inputs(queries: str, chunks: str) -> str:
    """queries: SQL of (corpus, query_id, text); chunks: of (corpus, chunk_id, pos, text)."""
    return f"""qs AS (SELECT * FROM ({queries}) WHERE trim(coalesce(text, '')) <> ''),
ch AS (SELECT * FROM ({chunks})),
qt AS (SELECT corpus, query_id, token, count(*) AS qtf FROM (SELECT corpus, query_id, unnest({_TOKENS}) AS token FROM qs) GROUP BY ALL),
ct AS (SELECT corpus, chunk_id, {_TOKENS} AS t FROM ch),
cw AS (SELECT corpus, chunk_id, unnest(t) AS token FROM ct),
every AS (SELECT corpus, query_id, chunk_id, pos FROM qs JOIN ch USING (corpus))"""


def hashed() -> str:
    """qv, cv: the hash embeddings of queries and chunks, (corpus, id, dim, w) of length 1."""
    norm = "sum(w * w) OVER (PARTITION BY corpus, {0})"
    vector = lambda name, key, rows, n: f"""{name} AS (SELECT corpus, {key}, dim, w / sqrt({norm.format(key)}) AS w FROM (
  SELECT corpus, {key}, dim, CAST(sum(sign * {n}) AS DOUBLE) AS w FROM {rows} JOIN dims USING (token) GROUP BY ALL HAVING w <> 0))"""  # noqa: E731
    return f"""{_TABLE},
dims AS (SELECT token, crc % 384 AS dim, CASE WHEN (crc & 256) <> 0 THEN 1 ELSE -1 END AS sign FROM (
  SELECT token, {_CRC} AS crc FROM (SELECT token FROM qt UNION SELECT token FROM cw), crc_table)),
{vector('qv', 'query_id', 'qt', 'qtf')},
{vector('cv', 'chunk_id', 'cw', '1')}"""


def _padded(name: str, scores: str, k: int) -> str:
    order = "round(coalesce(s.score, 0.0), 9) DESC, pos, e.chunk_id"
    return f"""{name} AS (SELECT * FROM (SELECT e.corpus, e.query_id, e.chunk_id, coalesce(s.score, 0.0) AS score,
  CAST(row_number() OVER (PARTITION BY e.corpus, e.query_id ORDER BY {order}) AS INT) AS rank
  FROM every e LEFT JOIN {scores} s ON s.corpus = e.corpus AND s.query_id = e.query_id AND s.chunk_id = e.chunk_id) WHERE rank <= {k})"""


def vector(k: int) -> str:
    return f"""vs AS (SELECT corpus, query_id, chunk_id, sum(c.w * q.w) AS score FROM cv c JOIN qv q USING (corpus, dim) GROUP BY ALL),
{_padded('vr', 'vs', k)}"""


def bm25(k: int) -> str:
    return f"""cl AS (SELECT corpus, chunk_id, CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END AS t FROM ct),
post AS (SELECT corpus, chunk_id, dl, token, count(*) AS tf FROM (SELECT corpus, chunk_id, len(t) AS dl, unnest(t) AS token FROM cl) GROUP BY ALL),
corp AS (SELECT corpus, count(*) AS n, avg(len(t)) AS avgdl FROM cl GROUP BY corpus),
rawidf AS (SELECT corpus, token, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN corp USING (corpus) GROUP BY ALL),
idf AS (SELECT corpus, token, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY corpus) ELSE raw END AS idf FROM rawidf),
bs AS (SELECT corpus, query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN qt USING (corpus, token) JOIN idf USING (corpus, token) JOIN corp USING (corpus) GROUP BY ALL),
{_padded('br', 'bs', k)}"""


def fused(k: int) -> str:
    """fr: reciprocal rank fusion of vr and br."""
    return f"""fr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY corpus, query_id ORDER BY round(score, 9) DESC, rv NULLS LAST, rb) AS INT) AS rank
  FROM (SELECT *, coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rb), 0) AS score FROM (
    SELECT corpus, query_id, chunk_id, min(rv) AS rv, min(rb) AS rb FROM (SELECT corpus, query_id, chunk_id, rank AS rv, NULL AS rb FROM vr
    UNION ALL SELECT corpus, query_id, chunk_id, NULL, rank FROM br) GROUP BY ALL))) WHERE rank <= {k})"""


_GRAMS = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"
_FOLD = "trim(regexp_replace(lower({0}), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def reranked(pool: str, k: int, text: str = "substr(text, 1, 2000)") -> str:
    """rr: the pool by trigram Jaccard of query and chunk. text: what of a chunk counts."""
    both = "len(list_intersect(p, g))"
    return f"""gq AS (SELECT corpus, query_id, {_GRAMS.format('x')} AS p FROM (SELECT corpus, query_id, {_FOLD.format('text')} AS x FROM qs)),
gc AS (SELECT corpus, chunk_id, {_GRAMS.format('x')} AS g FROM (SELECT corpus, chunk_id, {_FOLD.format(text)} AS x FROM ch)),
rs AS (SELECT o.corpus, o.query_id, o.chunk_id, o.rank AS pool, CASE WHEN len(p) = 0 OR len(g) = 0 THEN 0.0 ELSE {both} / CAST(len(p) + len(g) - {both} AS DOUBLE) END AS score
  FROM {pool} o JOIN gq USING (corpus, query_id) JOIN gc USING (corpus, chunk_id)),
rr AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY corpus, query_id ORDER BY round(score, 9) DESC, pool) AS INT) AS rank FROM rs) WHERE rank <= {k})"""


def hybrid(queries: str, chunks: str, k: int) -> str:
    """Ends in fr."""
    return ",\n".join([inputs(queries, chunks), hashed(), vector(k), bm25(k), fused(k)])


def hybrid_rerank(queries: str, chunks: str, k: int) -> str:
    """Ends in rr."""
    pool = max(k, 30)
    return ",\n".join([inputs(queries, chunks), hashed(), vector(pool), bm25(pool), fused(pool), reranked("fr", k)])
