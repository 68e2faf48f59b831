"""Registered queries of the review operators over the given tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.functions import text as T
from packreview.jobs import chunk_sql
from packreview.jobs import review as R
from packreview.operators import chunking, decide, evaluate, extract, retrieval, verify
from packreview.sources import packs, scratch
from packreview.sources.scratch import materialise

# Procurement text derived from the customer and supplier tables; the same statements run in Spark and in DuckDB.
TENDER = """
SELECT CAST(c_nationkey AS INT) AS case_id, 't-' || CAST(c_custkey AS STRING) AS chunk_id, c_custkey AS pos,
  CAST(c_custkey % 20 + 1 AS INT) AS page,
  CASE c_custkey % 8
   WHEN 0 THEN '1.' || CAST(c_custkey % 9 AS STRING) || ' The bidder shall have average annual financial turnover of at least Rs. ' || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) * 1000 + 10000 AS STRING) || ' during the last three financial years.'
   WHEN 1 THEN 'A bank solvency certificate of not less than ' || CAST(c_custkey % 90 + 1 AS STRING) || ' lakh must be submitted by the bidder.'
   WHEN 2 THEN 'The bidder shall have a valid GST registration certificate for lot ' || CAST(c_custkey % 5 AS STRING) || '.'
   WHEN 3 THEN 'The bidder should have completed ' || CAST(c_custkey % 3 + 1 AS STRING) || ' similar civil works each of value not less than Rs. ' || CAST(c_custkey * 1000 + 10000 AS STRING) || '.'
   WHEN 4 THEN 'Earnest Money Deposit of Rs. ' || CAST(c_custkey + 10000 AS STRING) || ' shall be submitted with the bid.'
   WHEN 5 THEN 'Pre-bid meeting will be held on ' || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') || '-Oct-2026 at 11:00 hours.'
   WHEN 6 THEN 'Liquidated damages at ' || CAST(c_custkey % 10 + 1 AS STRING) || ' percent per week shall be levied for delay.'
   ELSE 'The bidder shall not have been blacklisted by any government department.' END AS text
FROM {customer}"""
COMPANY = """
SELECT CAST(s_nationkey AS INT) AS case_id, 'c-' || CAST(s_suppkey AS STRING) || '-' || CAST(k AS STRING) AS chunk_id, s_suppkey * 6 + k AS pos,
  CASE k
   WHEN 0 THEN 'Average annual financial turnover of the firm for three years is Rs. ' || CAST(CAST(floor(abs(s_acctbal)) AS BIGINT) * 1000 + 10000 AS STRING) || '.'
   WHEN 1 THEN 'Bank solvency certificate of the firm for an amount of Rs. ' || CAST((s_suppkey % 60 + 1) * 100000 AS STRING) || '.'
   WHEN 2 THEN 'Goods and Services Tax registration certificate of the firm. Status: Active.'
   WHEN 3 THEN 'Value of the similar civil work on completion: Rs. ' || CAST(s_suppkey * 20000 + 10000 AS STRING) || '.'
   WHEN 4 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'The firm was blacklisted by one department in 2020.' ELSE 'The firm has never been blacklisted by any government department.' END
   ELSE 'Demand draft for the earnest money deposit was remitted with the bid.' END AS text
FROM {supplier} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) ks
WHERE (s_suppkey + k) % 3 <> 0"""
_TENDER, _COMPANY = TENDER.replace("{customer}", "customer"), COMPANY.replace("{supplier}", "supplier")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return scratch.dealt_out(s.read.parquet(f"{d}/{name}.parquet"))


def tender(s: SparkSession, d: str) -> DataFrame:
    return s.sql(TENDER, customer=table(s, d, "customer"))


def company(s: SparkSession, d: str) -> DataFrame:
    return s.sql(COMPANY, supplier=table(s, d, "supplier"))


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '\\b{w}\\b')" if w in T.SHORT_CUES else f"contains({column}, '{w}')" for w in words) + ")"


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_DATE = r"regexp_matches(text, '(?i)\b([0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{1,2}[\s-](jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s-][0-9]{2,4})\b')"
_SIMILAR = r"regexp_matches(low, 'similar(\s+[a-z]+){0,4}\s+works?\b')"
_DEAD = f"({_DATE} AND {_contains('low', T.DEADLINE_CUES)})"
_PURE = f"({_DEAD} AND NOT {_contains('low', T.STRONG_WORDS)})"
_MODAL = r"regexp_matches(text, '(?i)\b(shall|must|should|required|requirement)\b')"
_KIND = f"""CASE WHEN {_contains('low', ('turnover', 'solvency', 'net worth', 'earnest money', 'bid security'))} OR regexp_matches(low, '\\bemd\\b') THEN 'financial'
 WHEN {_SIMILAR} OR {_contains('low', ('manpower', 'psara', 'iso', 'work experience', 'successfully completed', 'satisfactorily completed'))} THEN 'technical'
 WHEN {_contains('low', ('gst', 'pan card', 'permanent account', 'undertaking', 'shall submit', 'must submit', 'msme', 'udyam'))} OR regexp_matches(low, '\\bpan\\b') THEN 'document' ELSE 'eligibility' END"""


def _hits(policy: str) -> str:
    return " + ".join(f"CAST({_any('low', [c])} AS INT)" for c in T.CUES[policy])


def _cue(policy: str) -> str:
    return f"({_SIMILAR} OR {_any('low', T.CUES[policy])})"


@query(
    "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)"
)
def txt1_tokens(s, d):
    t = T.tokenize(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS norm_md5 FROM documents")
def txt2_whitespace_norm(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(T.whitespace_norm(F.col("text"))).alias("norm_md5"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n+')) AS p FROM documents),
q AS (SELECT doc_id, regexp_replace(p, '(^|[\s(])((?i:rs|mr|mrs|ms|dr|no|cl|fig|vol|vs|etc))\.', '\1\2' || chr(2), 'g') AS p FROM p),
r AS (SELECT doc_id, unnest(string_split(regexp_replace(p, '\.\s+([A-Z0-9("''])', '.' || chr(1) || '\1', 'g'), chr(1))) AS x FROM q),
t AS (SELECT doc_id, trim(replace(x, chr(2), '.'), ' ' || chr(9) || chr(13)) AS x FROM r)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM t WHERE length(x) >= 20 GROUP BY doc_id""")
def txt3_sentences(s, d):
    rows = table(s, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("x")).alias("n_chars"))


_AMOUNTS = r"""list_concat(list_transform(regexp_extract_all(text, '(?i)(?:₹|rs\.?|inr)\s*([0-9]{1,3}(?:,[0-9]{2,3})+|[0-9]{4,})', 1), lambda x: CAST(replace(x, ',', '') AS BIGINT)),
 list_transform(regexp_extract_all(text, '(?i)([0-9]+(?:\.[0-9]+)?)\s*(?:lakh|lakhs)\b', 1), lambda x: CAST(round(CAST(x AS DOUBLE) * 100000) AS BIGINT)))"""


@query(f"SELECT chunk_id, array_to_string({_AMOUNTS}, ',') AS amounts FROM ({_TENDER} UNION ALL SELECT case_id, chunk_id, pos, 1, text FROM ({_COMPANY}))")
def txt4_amounts(s, d):
    both = tender(s, d).select("chunk_id", "text").unionByName(company(s, d).select("chunk_id", "text"))
    return both.select("chunk_id", F.array_join(F.transform(T.amounts_in(F.col("text")), lambda a: a.cast("string")), ",").alias("amounts"))


@query(f"""SELECT chunk_id, {_DATE} AS has_date, {_MODAL} AS modal, {_cue('v1')} AS cue_v1, {_cue('v2')} AS cue_v2, {_hits('v1')} AS hits_v1, {_KIND} AS kind, {_PURE} AS pure_deadline,
 CASE WHEN {_contains('low', ('pre-bid', 'prebid'))} THEN 'pre-bid meeting' WHEN contains(low, 'opening') THEN 'bid opening' WHEN contains(low, 'clarification') THEN 'clarification window'
 WHEN {_contains('low', ('submission', 'due date', 'last date'))} THEN 'bid submission' ELSE 'dated event' END AS label,
 CASE WHEN {_contains('low', ('liquidated', 'forfeit', 'penalty'))} THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, lower(text) AS low FROM ({_TENDER}))""")
def txt8_line_flags(s, d):
    t, low = F.col("text"), F.lower("text")
    return tender(s, d).select(
        "chunk_id", T.has_date(t).alias("has_date"), T.has_modal(t).alias("modal"), T.has_cue(low, "v1").alias("cue_v1"), T.has_cue(low, "v2").alias("cue_v2"), T.cue_hits(low, "v1").alias("hits_v1"),
        T.kind(low).alias("kind"), T.is_pure_deadline(t).alias("pure_deadline"), T.deadline_label(low).alias("label"), T.risk_severity(low).alias("severity"),
    )


_TRI = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) ELSE [] END"


@query(f"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[\\s\\p{{Z}}]+', ' ', 'g')) AS x, trim(regexp_replace(lower(substr(text, 1, 2000)), '[\\s\\p{{Z}}]+', ' ', 'g')) AS y FROM conversations WHERE text IS NOT NULL),
g AS (SELECT a.conv_id, a.turn, {_TRI.format('a.x')} AS p, {_TRI.format('b.y')} AS q FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(p, q)) / CAST(len(p) + len(q) - len(list_intersect(p, q)) AS DOUBLE), 6) END AS score FROM g""")
def txt7_trigram_jaccard(s, d):
    t = table(s, d, "conversations").where("text is not null")
    a = t.select("conv_id", "turn", T.trigrams(F.col("text")).alias("p"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), T.trigrams(F.substring("text", 1, 2000)).alias("q"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("p"), F.col("q")), 6).alias("score"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS n_blocks,
 length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_alnum, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 40 AS needs_ocr FROM documents""")
def chk2_page_quality(s, d):
    p = chunking.page_quality(table(s, d, "documents"))
    return p.select("doc_id", F.size(chunking.blocks(F.col("text"))).cast("long").alias("n_blocks"), F.col("n_alnum").cast("long"), "needs_ocr")


@query(chunk_sql.chunks("SELECT doc_id, source, text FROM documents"))
def chk6_chunks(s, d):
    return chunking.chunk_texts(_as_pages(table(s, d, "documents")))


# Shorter lines, half of them in capitals, so that headings, sections and carried lines are many.
_SHORT_LINES = "SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE {0} END AS text FROM {documents}"
_CUT = "replace(replace(text, ', ', {n}), '. ', '. ' || {n} || CAST(doc_id % 9 AS {s}) || '.2) ')"


@query(chunk_sql.chunks(_SHORT_LINES.format(_CUT.format(n="chr(10)", s="VARCHAR"), documents="documents")))
def chk5_short_lines(s, d):
    text = s.sql(_SHORT_LINES.format(_CUT.format(n="char(10)", s="STRING"), documents="{documents}"), documents=table(s, d, "documents"))
    return chunking.chunk_texts(_as_pages(text))


def _as_pages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("ordinal"), F.lit(0).alias("case_id"), F.lit("tender").alias("role"), F.col("source").alias("filename"), "text")


def _ext1(policy: str, source: str = _TENDER) -> str:
    modal = f"AND {_MODAL}" if policy == "v2" else ""
    return f"""
WITH x AS (SELECT *, lower(text) AS low FROM ({source})),
k AS (SELECT *, {_hits(policy)} AS hits, {_KIND} AS kind, row_number() OVER (PARTITION BY case_id, substr(low, 1, 220) ORDER BY pos) AS n FROM x
      WHERE length(text) >= 40 AND {_cue(policy)} AND NOT {_PURE} {modal})
SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY hits DESC, page, text, pos) AS INT) AS ord, kind, text, chunk_id, page,
  nullif(regexp_extract(text, '^([0-9]+(\\.[0-9]+)*)\\s', 1), '') AS clause FROM k WHERE n = 1"""


@query(_ext1("v1"))
def ext1_requirements_v1(s, d):
    return extract.requirements(tender(s, d), "v1").select("case_id", "ord", "kind", "text", "chunk_id", "page", "clause")


@query(_ext1("v2"))
def ext1_requirements_v2(s, d):
    return extract.requirements(tender(s, d), "v2").select("case_id", "ord", "kind", "text", "chunk_id", "page", "clause")


def _first_n(where: str, extra: str, n: int) -> str:
    return f"""
WITH x AS (SELECT *, lower(text) AS low FROM ({_TENDER})),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id, substr(low, 1, 220) ORDER BY pos) AS n FROM x WHERE {where}),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) AS INT) AS ord FROM k WHERE n = 1)
SELECT case_id, ord, chunk_id, {extra} FROM o WHERE ord <= {n}"""


@query(_first_n(f"{_contains('low', T.RISK_CUES)} AND NOT {_PURE}", "CASE WHEN contains(low, 'liquidated') THEN 'high' ELSE 'medium' END AS severity", extract.MAX_RISKS))
def ext2_risks(s, d):
    return extract.risks(tender(s, d)).select("case_id", "ord", "chunk_id", "severity")


@query(_first_n(_DEAD, "'pre-bid meeting' AS event", extract.MAX_DEADLINES))
def ext3_deadlines(s, d):
    return extract.deadlines(tender(s, d)).select("case_id", "ord", "chunk_id", "event")


@query(r"""WITH RECURSIVE k AS (SELECT *, left(trim(regexp_replace(lower(text), '[\t-\r \x{85}\p{Z}]+', ' ', 'g')), 240) AS key FROM conversations),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM k WHERE key <> ''),
step(conv_id, n, kept, stays) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM q
 UNION ALL SELECT conv_id, n, CASE WHEN fresh THEN list_append(kept, key) ELSE kept END, fresh FROM (
  SELECT s.conv_id, q.n, kept, key, len(list_filter(kept, lambda x: contains(x, key) OR contains(key, x))) = 0 AS fresh FROM step s JOIN q ON q.conv_id = s.conv_id AND q.n = s.n + 1))
SELECT q.conv_id AS case_id, turn AS ord, text AS quote FROM step s JOIN q ON q.conv_id = s.conv_id AND q.n = s.n WHERE stays""")
def ext4_dedupe(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("ord"), F.col("text").alias("quote"))
    return extract.dedupe_containment(rows)


# Every line speaks of money; one in seven names an estimate, in one of four wordings, alone or between other sentences.
_COST = """SELECT case_id, chunk_id, pos, page, CASE
   WHEN pos % 7 = 0 THEN 'Estimated cost of lot ' || CAST(pos AS STRING) || ' is Rs. ' || CAST(pos * 1000 + 10000 AS STRING) || ' as per the notice.'
   WHEN pos % 7 = 2 AND pos % 2 = 0 THEN 'The fee is Rs. ' || CAST(pos * 9000 + 10000 AS STRING) || ' per lot. The tender value is Rs. ' || CAST(pos * 100 + 10000 AS STRING) || ' for this lot.'
   WHEN pos % 7 = 4 AND pos % 3 = 0 THEN 'ECPT Rs. ' || CAST(pos + 20000 AS STRING)
   ELSE 'The fee of lot ' || CAST(pos AS STRING) || ' is Rs. ' || CAST(pos * 8000 + 10000 AS STRING) || ' and is not refunded.' END AS text FROM {t}"""


@query(f"""SELECT case_id, max(CASE WHEN pos % 7 = 0 THEN pos * 1000 + 10000 WHEN pos % 7 = 2 AND pos % 2 = 0 THEN pos * 100 + 10000 WHEN pos % 7 = 4 AND pos % 3 = 0 THEN pos + 20000 END) AS cost
 FROM ({_TENDER}) GROUP BY case_id HAVING cost IS NOT NULL""")
def ext5_estimated_cost(s, d):
    return extract.estimated_cost(s.sql(_COST, t=tender(s, d)))


@query()
def ext8_span_menu(s, d):
    return extract.span_menu(tender(s, d), limit=1_000_000, per_chunk=4)


def _corpus(docs: DataFrame) -> DataFrame:
    return docs.select(F.lit("all").alias("corpus"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text")


def _bench(s, d) -> DataFrame:
    return table(s, d, "benchmark").select(F.lit("all").alias("corpus"), F.col("item_id").alias("query_id"), "text")


_BM25 = """
WITH tok AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN ['empty'] ELSE t END AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)),
post AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY ALL),
corp AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corp GROUP BY token),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


@query(_BM25 + " SELECT token, df, round(idf, 6) AS idf FROM idf")
def ret3_bm25_stats(s, d):
    terms = retrieval.bm25_stats(_corpus(table(s, d, "documents"))).terms
    return terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(_BM25 + """, q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN q USING (token) JOIN idf USING (token), corp GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM sc)
SELECT item_id AS query_id, doc_id AS chunk_id, rank, round(score, 6) AS score FROM rk WHERE rank <= 10""")
def ret4_bm25_top10(s, d):
    top = retrieval.bm25_top(_bench(s, d), _corpus(table(s, d, "documents")), 10)
    return top.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank FROM p)
SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def ret2_dense_top10(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    return retrieval.dense_top(q, v, 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query()
def ret1_hash_embedding(s, d):
    return retrieval.hash_embedding(_corpus(table(s, d, "documents")), "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("dims"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


def _case_queries(s, d) -> DataFrame:
    asked = extract.requirements(tender(s, d)).select(F.col("case_id").cast("string").alias("corpus"), F.col("ord").alias("query_id"), "text")
    return materialise(asked, "queries", plain=True)  # both searches and the reranking read them


def _case_chunks(s, d) -> DataFrame:
    return company(s, d).select(F.col("case_id").cast("string").alias("corpus"), "chunk_id", "pos", "text")


@query()
def ret7_hybrid(s, d):
    return retrieval.search(_case_queries(s, d), _case_chunks(s, d), 8, "hybrid", True).withColumn("score", F.round("score", 6))


@query()
def ret7_hybrid_rerank(s, d):
    return retrieval.search(_case_queries(s, d), _case_chunks(s, d), 8, "hybrid_rerank", True).withColumn("score", F.round("score", 6))


@query("""
WITH rel AS (SELECT a.vec_id AS q, b.vec_id AS i FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0 AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
n AS (SELECT q, count(*) AS n FROM rel GROUP BY q),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS q, e.vec_id AS i, list_cosine_similarity(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, i) AS rank FROM p),
h AS (SELECT n.q, n.n, count(rel.i) FILTER (r.rank <= 5) AS h5, count(rel.i) FILTER (r.rank <= 10) AS h10, min(CASE WHEN rel.i IS NOT NULL AND r.rank <= 10 THEN r.rank END) AS f FROM n JOIN r ON r.q = n.q LEFT JOIN rel ON rel.q = r.q AND rel.i = r.i GROUP BY ALL)
SELECT 'vector' AS mode, count(*) AS queries, round(avg(h5 / n), 6) AS recall5, round(avg(h10 / n), 6) AS recall10, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM h""")
def evl2_retrieval_scores(s, d):
    v = table(s, d, "embeddings").where("embedding is not null").select("vec_id", "label")
    size = v.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))  # relevant: the same label
    n = v.where("vec_id % 50 = 0").join(size, "label").select(F.lit(0).alias("case_id"), F.col("vec_id").alias("query_id"), "n")
    hits = ret2_dense_top10(s, d).join(v.select(F.col("vec_id").alias("id"), F.col("label").alias("of")), "id")
    hits = hits.join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    hits = hits.select(
        F.lit("vector").alias("mode"), F.lit(0).alias("case_id"), "query_id", F.col("id").alias("chunk_id"), "rank",
        (F.col("of") == F.col("wanted")).alias("good"),
    )
    out = evaluate.scores_of_hits(hits, n)
    return out.select("mode", "queries", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "mrr")])


_REQ = f"(SELECT case_id, text, lower(text) AS low FROM ({_TENDER}) WHERE pos % 8 IN (0, 1, 2, 3, 4, 7) GROUP BY ALL)"
_RULE = """CASE WHEN contains(low, 'turnover') THEN 'turnover' WHEN contains(low, 'solvency') THEN 'solvency' WHEN contains(low, 'similar') THEN 'similar' WHEN contains(low, 'gst') THEN 'gst'
 WHEN contains(low, 'blacklist') THEN 'blacklist' ELSE 'emd' END"""


@query(f"SELECT rule, count(*) AS n FROM (SELECT {_RULE} AS rule FROM {_REQ}) GROUP BY rule")
def dec2_rules(s, d):
    return extract.requirements(tender(s, d)).groupBy(decide.rule_of(F.col("text")).alias("rule")).agg(F.count("*").alias("n"))


def _searched(s, d) -> DataFrame:
    """The matrix where each requirement's evidence is what a search for it finds among all company chunks of its case."""
    req = materialise(extract.requirements(tender(s, d)).withColumn("req_id", F.col("ord")), "requirements", plain=True)
    return decide.matrix(req, R.evidence_hits(req, company(s, d)))


@query()
def dec9_matrix_searched(s, d):
    """With DEC1's quote: the sentence that the decision rests on."""
    return _searched(s, d).select("case_id", "req_id", "text", "decision", "obligation", "rationale", "evidence_chunk_id", "evidence_quote", "evidence_page", "evidence_clause")


@query()
def dec10_go_no_go_searched(s, d):
    return decide.go_no_go(table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("case_id")), _searched(s, d))


@query()
def dec11_counts_searched(s, d):
    return decide.decision_counts(_searched(s, d))


@query("""SELECT lang, CASE max(r) WHEN 3 THEN 'not_met' WHEN 2 THEN 'missing' WHEN 1 THEN 'unclear' ELSE 'met' END AS worst FROM (SELECT lang, CASE WHEN toxic = 1 AND quality = 0 THEN 3 WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END AS r
 FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL) GROUP BY lang""")
def dec12_worst(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null")
    decision = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "not_met").when(F.col("toxic") == 1, "missing").when(F.col("quality") == 0, "unclear").otherwise("met")
    return decide.worst(rows.withColumn("decision", decision), "lang")


def _half_claims(s, d) -> DataFrame:
    wrong = F.concat(F.lit("t-"), F.col("pos") + F.when(F.col("pos") % 2 == 0, 0).otherwise(1))
    return tender(s, d).select("case_id", F.lit("risk").alias("stage"), F.substring("text", 1, 45).alias("quote"), wrong.alias("chunk_id"))


@query(f"""WITH t AS (SELECT * FROM ({_TENDER})), c AS (SELECT case_id, substr(text, 1, 45) AS quote, 't-' || CAST(pos + pos % 2 AS STRING) AS chunk_id FROM t)
SELECT c.case_id, 'risk' AS stage, c.quote, c.chunk_id FROM c LEFT JOIN t ON t.case_id = c.case_id AND t.chunk_id = c.chunk_id WHERE t.text IS NULL OR NOT contains(t.text, c.quote)""")
def ver2_unsupported(s, d):
    return verify.unsupported(_half_claims(s, d), tender(s, d))


@query(f"""WITH t AS (SELECT * FROM ({_TENDER})), c AS (SELECT case_id, substr(text, 1, 45) AS quote, 't-' || CAST(pos + pos % 2 AS STRING) AS chunk_id FROM t),
x AS (SELECT c.case_id, coalesce(contains(t.text, c.quote), false) AS ok FROM c LEFT JOIN t ON t.case_id = c.case_id AND t.chunk_id = c.chunk_id)
SELECT case_id, count(*) AS total, count(*) FILTER (ok) AS supported, count(*) FILTER (ok) / count(*) AS rate FROM x GROUP BY ROLLUP (case_id)""")
def ver5_faithfulness(s, d):
    return verify.faithfulness(_half_claims(s, d), tender(s, d))


def _review(s, d) -> dict[str, DataFrame]:
    cases = table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("case_id"), F.col("n_name").alias("title"))
    return R.review(cases, tender(s, d), company(s, d))


@query()
def let1_letter_queries(s, d):
    return _review(s, d)["letter"]


@query()
def let2_letters(s, d):
    return _review(s, d)["letters"]


@query()
def snk2_reports(s, d):
    r = _review(s, d)
    summary = r["go_no_go"].join(r["counts"].select("case_id", "summary"), "case_id", "left")
    verified = packs.verification(r["claims"], r["failures"])
    return packs.reports(r["go_no_go"], r["matrix"].drop("pos"), r["risks"], r["deadlines"], r["letter"], summary, verified)


@query("SELECT CAST(quality AS VARCHAR) || '->' || CAST(toxic AS VARCHAR) AS pair, count(*) AS n FROM labels GROUP BY 1")
def evl6_confusion(s, d):
    rows = table(s, d, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted"), F.lit(True).alias("cited"))
    return evaluate.eligibility_scores(rows)[1]


@query("""WITH x AS (SELECT lang, sum(quality) AS gold, sum(toxic) AS predicted, sum(quality * toxic) AS matched FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, CAST(gold AS BIGINT) AS gold, CAST(predicted AS BIGINT) AS predicted, CAST(matched AS BIGINT) AS matched, round(matched / nullif(predicted, 0), 6) AS precision, round(matched / nullif(gold, 0), 6) AS recall FROM x""")
def evl4_micro(s, d):
    rows = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    out = evaluate.micro(rows.select("lang", F.col("quality").alias("gold"), F.col("toxic").alias("predicted"), (F.col("quality") * F.col("toxic")).alias("matched")), "lang")
    return out.select("lang", "gold", "predicted", "matched", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""WITH x AS (SELECT event_type AS kind, event_id % 2 = 0 AS identical, (event_id * 7) % 11 AS c, (event_id * 5) % 13 AS e, (event_id * 3) % 7 AS n FROM events),
l AS (SELECT kind, identical, CASE WHEN c >= e AND c >= n THEN 'c' WHEN e >= n THEN 'e' ELSE 'n' END AS l FROM x)
SELECT kind, count(*) AS n, count(*) FILTER (l = 'e') AS entailment, count(*) FILTER (l = 'c') AS contradiction, count(*) FILTER (l = 'n') AS neutral, count(*) FILTER (identical) AS identical,
 count(*) FILTER (NOT identical) AS other_n, count(*) FILTER (l = 'e' AND NOT identical) AS other_entailment FROM l GROUP BY ROLLUP (kind)""")
def evl8_entailment(s, d):
    e = F.col("event_id")
    x = table(s, d, "events").select(F.col("event_type").alias("kind"), (e % 2 == 0).alias("identical"), ((e * 7) % 11).alias("contradiction"), ((e * 5) % 13).alias("entailment"), ((e * 3) % 7).alias("neutral"))
    return evaluate.entailment_summary(x).drop("headline_rate")


@query("""SELECT o_custkey AS case_id, o_orderkey AS run_id, o_orderdate AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def qry1_latest_run(s, d):
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return R.latest_run(runs)


@query("SELECT o_orderkey AS case_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def qry2_recent_cases(s, d):
    return R.recent_cases(table(s, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("created_at")))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS case_id, o_orderkey AS run_id, count(l_orderkey) AS n_notes FROM customer LEFT JOIN (SELECT * FROM r WHERE n = 1) ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def qry3_case_view(s, d):
    cases = table(s, d, "customer").select(F.col("c_custkey").alias("case_id"))
    runs = table(s, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    notes = table(s, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("channel"), F.col("l_linestatus").alias("status"))
    view = R.case_view(cases, runs, notes)
    return view.select("case_id", "run_id", F.coalesce(F.size("notifications"), F.lit(0)).cast("long").alias("n_notes"))
