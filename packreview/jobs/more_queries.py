"""Queries on the remaining operators, over text and rows that the given tables yield, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.functions import text as T
from packreview.jobs import queries as Q
from packreview.jobs import review as R
from packreview.jobs import rule_queries as N
from packreview.jobs import search_sql as S
from packreview.operators import chunking, decide, evaluate, extract, retrieval, verify
from packreview.sources.scratch import materialise

# -- text functions ----------------------------------------------------------------------------------------------------

_VALUES = """
SELECT c_custkey AS k,
  'The average turnover shall be at least ' || CAST(c_custkey % 150 AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ' percent' ELSE '%' END || ' of the cost of the work.' AS share,
  CASE c_custkey % 4 WHEN 0 THEN 'Guards at site: minimum of ' || CAST(c_custkey % 900 + 10 AS STRING) || ' persons.' WHEN 1 THEN 'Manpower on roll is ' || CAST(c_custkey % 9000 AS STRING) || ' today.'
    WHEN 2 THEN 'There are ' || CAST(c_custkey % 900 + 10 AS STRING) || ' security guards in all.' ELSE 'There is nobody.' END AS crew,
  CASE c_custkey % 3 WHEN 0 THEN 'Rs. ' || CAST(c_custkey + 1000 AS STRING) || ' and INR ' || CAST(c_custkey * 7 + 1000 AS STRING) ELSE 'no sum is named' END AS sums,
  CASE c_custkey % 4 WHEN 0 THEN 'Synthetic sample page.' WHEN 1 THEN 'Fictional page ' || CAST(c_custkey AS STRING) || '.' WHEN 2 THEN 'Page of the firm' ELSE 'UDIN is to be added' END AS banner,
  CASE c_custkey % 4 WHEN 0 THEN '/srv/in/ann  ex (' || CAST(c_custkey AS STRING) || ').pdf' WHEN 1 THEN '..' WHEN 2 THEN 'C:\\\\in\\\\_a b.txt' ELSE 'plain-' || CAST(c_custkey AS STRING) || '.txt' END AS name,
  c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) || ' ' ELSE c_name || '.' END AS b
FROM {customer}"""
_V = _VALUES.replace("{customer}", "customer").replace("\\\\", "\\")


@Q.query(f"""SELECT k, CASE WHEN k % 150 BETWEEN 1 AND 100 THEN CAST(k % 150 AS DOUBLE) END AS pct, CASE k % 4 WHEN 0 THEN k % 900 + 10 WHEN 1 THEN k % 9000 WHEN 2 THEN k % 900 + 10 END AS crew,
 CASE WHEN k % 3 = 0 THEN ' [amounts: ' || (k + 1000) || ' INR, ' || (k * 7 + 1000) || ' INR]' ELSE '' END AS hint, k % 4 = 0 OR k % 4 = 3 AS is_banner,
 CASE k % 4 WHEN 0 THEN 'ann_ex_' || k || '_.pdf' WHEN 1 THEN 'document' WHEN 2 THEN 'a_b.txt' ELSE 'plain-' || k || '.txt' END AS file_name, k % 2 = 0 AS same,
 contains(lower(share), 'turnover') AND contains(lower(share), lower('Percent of')) AS both FROM ({_V})""")
def txt14_values(s, d):
    """TXT14, 15, 18, 19 and 20."""
    v = s.sql(_VALUES, customer=Q.table(s, d, "customer"))
    c = F.col
    return v.select(
        "k", T.percent_near(c("share"), F.lit("turnover")).alias("pct"), T.headcount(c("crew")).cast("long").alias("crew"), T.amount_hint(c("sums")).alias("hint"),
        T.is_banner(c("banner")).alias("is_banner"), T.safe_file_name(c("name")).alias("file_name"), T.norm_eq(c("a"), c("b")).alias("same"),
        T.contains_all(c("share"), F.array(F.lit("TURNOVER"), F.lit("percent OF"))).alias("both"),
    )


_LINES = r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(x) WHEN doc_id % 3 = 1 THEN 'Part ' || x ELSE x END AS line FROM (
 SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\n+')), ' ' || chr(9) || chr(13)) AS x FROM documents) WHERE length(x) > 0"""
_LETTERS = r"length(regexp_replace(line, '[^\p{L}]', '', 'g'))"


@Q.query(rf"""SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(line) BETWEEN 4 AND 90 AND NOT regexp_matches(line, '(?i)\b(shall|must|should|rs\.?|inr|rupees?|lakh|lakhs|crore|crores)\b|₹')
  AND (regexp_matches(line, '(?i)^(section|annexure|appendix|schedule|chapter|part|clause)\b') OR (NOT regexp_matches(line, '^[(:/]') AND NOT regexp_matches(line, '[0-9]') AND {_LETTERS} > 0
  AND 4 * length(regexp_replace(line, '[^\p{{Lu}}]', '', 'g')) > 3 * {_LETTERS} AND len(regexp_split_to_array(trim(regexp_replace(line, '[\s\p{{Z}}]+', ' ', 'g')), ' ')) <= 12))) AS n_headings
 FROM ({_LINES}) GROUP BY doc_id""")
def chk3_headings(s, d):
    lines = Q.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n+")).alias("x"))
    lines = lines.withColumn("x", F.regexp_replace("x", r"^[ \t\r\n]+|[ \t\r\n]+$", "")).where("x <> ''")
    line = F.when(F.col("doc_id") % 3 == 0, T.upper_each(F.col("x"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Part "), "x")).otherwise(F.col("x"))
    lines = lines.withColumn("heading", T.is_heading(line))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("heading").alias("n_headings"))


@Q.query(r"""SELECT source AS document_id, count(*) AS page_count, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) < 40) AS ocr_page_count FROM documents GROUP BY source""")
def chk2_document_quality(s, d):
    return chunking.document_quality(Q.table(s, d, "documents").withColumn("document_id", F.col("source")))


# -- retrieval ---------------------------------------------------------------------------------------------------------


@Q.query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS q, e.vec_id AS i, list_cosine_similarity(q.v, e.v) AS s1, list_cosine_similarity(q.v[1:32], e.v[1:32]) AS s2 FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY round(s1, 9) DESC, i) AS r1, row_number() OVER (PARTITION BY q ORDER BY round(s2, 9) DESC, i) AS r2 FROM p),
f AS (SELECT q, i, CASE WHEN r1 <= 10 THEN r1 END AS rv, CASE WHEN r2 <= 10 THEN r2 END AS rb FROM r WHERE r1 <= 10 OR r2 <= 10),
x AS (SELECT *, coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rb), 0) AS score FROM f)
SELECT q AS query_id, i AS chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, rv NULLS LAST, rb) AS rank FROM x) WHERE rank <= 10""")
def ret5_fusion(s, d):
    v = Q.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    half = v.withColumn("vector", F.slice("vector", 1, 32))

    def ranked(x: DataFrame) -> DataFrame:
        q = x.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
        return retrieval.dense_top(q, x, 10).select(F.lit("all").alias("corpus"), "query_id", F.col("id").alias("chunk_id"), "rank")

    return retrieval.rrf(ranked(v), ranked(half), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_DOCS, _ITEMS = "SELECT 'all' AS corpus, doc_id AS chunk_id, doc_id AS pos, text FROM documents", "SELECT 'all' AS corpus, item_id AS query_id, text FROM benchmark"


@Q.query("WITH " + ",\n".join([S.inputs(_ITEMS, _DOCS), S.bm25(30), S.reranked("br", 10, "text")]) + " SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM rr WHERE score > 0")
def ret6_rerank(s, d):
    """The 30 best by BM25 of each benchmark item among all documents, by trigram Jaccard; RET8's caller-made scorer does the same."""
    docs, items = Q._corpus(Q.table(s, d, "documents")), Q._bench(s, d)
    pool = retrieval.bm25_top(items, docs, 30, pad=True)
    out = retrieval.rerank(pool, items, docs, 10, scorer=lambda q, t: T.trigram_jaccard(q, t))
    return out.where("score > 0").select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


# -- extraction --------------------------------------------------------------------------------------------------------

_SECTIONS = """SELECT case_id, chunk_id, pos, page, text, CASE pos % 11 WHEN 0 THEN 'Eligibility' WHEN 1 THEN 'Earnest money' WHEN 2 THEN 'Scope of supply' WHEN 3 THEN 'Documents to be sent'
  WHEN 4 THEN ' ' WHEN 5 THEN NULL ELSE 'Part ' || CAST(pos % 11 AS STRING) END AS section FROM {t}"""
_SEC = _SECTIONS.replace("{t}", f"({Q._TENDER})")
_HITS_SQL = f"hits AS (SELECT case_id, chunk_id, query_id, rank FROM (SELECT *, pos % 9 AS query_id, CAST(row_number() OVER (PARTITION BY case_id, pos % 9 ORDER BY pos DESC) AS INT) AS rank FROM ({_SEC})) WHERE rank <= 4)"


def _sectioned(s, d) -> tuple[DataFrame, DataFrame]:
    chunks = s.sql(_SECTIONS, t=Q.tender(s, d))
    rows = chunks.withColumn("query_id", F.col("pos") % 9)
    rank = F.row_number().over(Window.partitionBy("case_id", "query_id").orderBy(F.desc("pos")))
    hits = rows.withColumn("rank", rank).where("rank <= 4").select("case_id", "chunk_id", "query_id", "rank")
    return chunks, hits


@Q.query(f"""WITH c AS ({_SEC}), {_HITS_SQL},
o AS (SELECT case_id, chunk_id, query_id * 1000 + rank AS o FROM hits UNION ALL SELECT case_id, chunk_id, 1000000000 + pos FROM c
  WHERE regexp_matches(lower(coalesce(section, '') || ' ' || substr(text, 1, 120)), 'eligibility|qualification|earnest'))
SELECT case_id, chunk_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY o, chunk_id) AS INT) AS ord FROM (SELECT case_id, chunk_id, min(o) AS o FROM o GROUP BY ALL)""")
def ext6_candidates(s, d):
    chunks, hits = _sectioned(s, d)
    return extract.candidate_chunks(hits, chunks)


@Q.query(f"""WITH c AS (SELECT *, CASE WHEN trim(coalesce(section, '')) = '' THEN 'page-' || page ELSE trim(section) END AS key, regexp_matches(text, '(?i)\\b(shall|should|must|required|bidder|emd|earnest)\\b') AS duty FROM ({_SEC})),
{_HITS_SQL},
seed AS (SELECT case_id, chunk_id, n FROM (SELECT case_id, chunk_id, row_number() OVER (PARTITION BY case_id ORDER BY o) AS n FROM (
  SELECT case_id, chunk_id, min(query_id * 1000 + rank) AS o FROM hits WHERE query_id < 6 AND rank <= 3 GROUP BY ALL)) WHERE n <= 8),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY pos) AS place FROM c),
sc AS (SELECT case_id, key, max(CASE WHEN place = 1 THEN len(regexp_extract_all(key || ' ' || substr(text, 1, 240), '(?i)eligib|qualif|earnest|\\bemd\\b|turnover|solvency|criteria|experience|blacklist|document')) END)
  + max(CAST(duty AS INT)) AS score, min(pos) AS first FROM p WHERE place <= 3 GROUP BY ALL),
rest AS (SELECT *, row_number() OVER (PARTITION BY case_id, key ORDER BY pos) AS nr FROM (SELECT p.*, score, first FROM p JOIN sc USING (case_id, key) ANTI JOIN seed USING (case_id, chunk_id)) WHERE score > 0 AND (duty OR score >= 2)),
u AS (SELECT case_id, chunk_id, 0 AS a, 0 AS b, 0 AS c, n AS d FROM seed UNION ALL SELECT case_id, chunk_id, 1, -score, first, pos FROM rest WHERE nr <= 3)
SELECT case_id, chunk_id, CAST(ord AS INT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY a, b, c, d) AS ord FROM u) WHERE ord <= 24""")
def ext7_section_sample(s, d):
    chunks, hits = _sectioned(s, d)
    return extract.section_sample(hits, chunks)


@Q.query(f"""WITH t AS (SELECT * FROM ({Q._TENDER})), c AS (SELECT case_id, pos AS claim_id, substr(text, 3, 55) AS quote, 't-' || CAST(pos + pos % 3 AS STRING) AS chunk_id FROM t),
h AS (SELECT c.*, t.chunk_id AS found, t.pos, row_number() OVER (PARTITION BY c.case_id, c.claim_id ORDER BY CASE WHEN t.chunk_id = c.chunk_id THEN 0 ELSE 1 END, t.pos) AS n
  FROM c JOIN t ON t.case_id = c.case_id AND contains(t.text, c.quote) WHERE length(trim(regexp_replace(c.quote, '\\s+', ' ', 'g'))) >= 20)
SELECT c.case_id, c.claim_id, h.found AS found_chunk FROM c LEFT JOIN h ON h.case_id = c.case_id AND h.claim_id = c.claim_id AND h.n = 1""")
def ext9_chunk_of_quote(s, d):
    wrong = F.concat(F.lit("t-"), (F.col("pos") + F.col("pos") % 3).cast("string"))
    t = Q.tender(s, d)
    claims = t.select("case_id", F.col("pos").alias("claim_id"), F.substring("text", 3, 55).alias("quote"), wrong.alias("chunk_id"))
    return extract.chunk_of_quote(claims, t.select("case_id", "chunk_id", "text", "pos")).select("case_id", "claim_id", "found_chunk")


# -- verification ------------------------------------------------------------------------------------------------------

_STAGED = f"""SELECT case_id, CASE pos % 4 WHEN 0 THEN 'drafter' WHEN 1 THEN 'risk' WHEN 2 THEN 'eligibility' ELSE 'extractor' END AS stage, substr(text, 1, 45) AS quote, 't-' || CAST(pos + CASE WHEN pos % 37 = 0 THEN 1 ELSE 0 END AS STRING) AS chunk_id
 FROM ({Q._TENDER}) WHERE case_id % 5 <> 0 OR pos % 37 <> 0"""


@Q.query(f"""WITH t AS (SELECT * FROM ({Q._TENDER})), c AS ({_STAGED}),
f AS (SELECT c.case_id, CASE stage WHEN 'extractor' THEN 1 WHEN 'eligibility' THEN 2 WHEN 'risk' THEN 3 ELSE 4 END AS o, stage FROM c LEFT JOIN t ON t.case_id = c.case_id AND t.chunk_id = c.chunk_id WHERE t.text IS NULL OR NOT contains(t.text, c.quote))
SELECT case_id, arg_min(stage, o) AS stage FROM f GROUP BY case_id""")
def ver3_first_stage(s, d):
    staged = _STAGED.replace(f"({Q._TENDER})", "{t}")
    return verify.first_stage(verify.unsupported(s.sql(staged, t=Q.tender(s, d)), Q.tender(s, d)))


def _rule_matrix(s, d) -> tuple[DataFrame, DataFrame]:
    tender, company = N._rules(s, d)
    req = materialise(extract.requirements(tender).withColumn("req_id", F.col("ord")), "requirements", plain=True)
    hits = R.evidence_hits(req, company, mode="bm25")
    return req, materialise(decide.matrix(req, hits, extract.estimated_cost(tender)), "matrix", plain=True)


_OPEN = f"""lq AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE decision WHEN 'not_met' THEN 0 WHEN 'unclear' THEN 1 WHEN 'missing' THEN 2 ELSE 9 END, req_id) AS INT) AS n, text AS quote, chunk_id, {N._ASK} AS question FROM left_in WHERE decision <> 'met')"""


@Q.query(f"""{N._RULE_MATRIX}, left_in AS (SELECT * FROM m WHERE req_id % 3 <> 0), {_OPEN} SELECT case_id, n, quote, chunk_id, question FROM lq WHERE n <= 6""")
def ver4_strip(s, d):
    """The letter drawn anew after every third requirement's tender quote was found unsupported."""
    req, matrix = _rule_matrix(s, d)
    bad = matrix.where("req_id % 3 = 0").select("case_id", F.lit("eligibility").alias("stage"), "quote", "chunk_id")
    none = extract.deadlines(N._rules(s, d)[0])
    clean = verify.strip_unsupported(req, matrix, extract.risks(N._rules(s, d)[0]), none, bad)
    return clean["letter"].select("case_id", "n", "quote", "chunk_id", "question")


@Q.query(f"""{N._RULE_MATRIX}, rk AS ({Q._first_n(f"{Q._contains('low', T.RISK_CUES)} AND NOT {Q._PURE}", "text", extract.MAX_RISKS)}), dl AS ({Q._first_n(Q._DEAD, "text", extract.MAX_DEADLINES)}),
c AS (SELECT case_id, 'extractor' AS stage FROM m UNION ALL SELECT case_id, 'eligibility' FROM m UNION ALL SELECT case_id, 'eligibility' FROM m WHERE evidence_chunk_id IS NOT NULL
 UNION ALL SELECT case_id, 'risk' FROM rk UNION ALL SELECT case_id, 'risk' FROM dl UNION ALL SELECT case_id, 'drafter' FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id) AS n FROM m WHERE decision <> 'met') WHERE n <= 6
 UNION ALL SELECT case_id, 'drafter' FROM dl WHERE ord <= 2)
SELECT case_id, stage, count(*) AS n FROM c GROUP BY ALL""")
def ver1_claims(s, d):
    req, matrix = _rule_matrix(s, d)
    dates = materialise(extract.deadlines(Q.tender(s, d)), "deadlines")
    cl = verify.claims(req, matrix, extract.risks(Q.tender(s, d)), dates, verify.letter_queries(matrix, dates))
    return cl.groupBy("case_id", "stage").agg(F.count("*").alias("n"))


# -- evaluation --------------------------------------------------------------------------------------------------------

_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PHRASES = f"SELECT item_id AS query_id, substr(text, 5, 40) AS p1, translate(substr(text, 60, 30), '{_SMALL}', '{_LARGE}') AS p2 FROM benchmark WHERE text IS NOT NULL"


def _phrases(s, d) -> DataFrame:
    both = F.array(F.substring("text", 5, 40), F.translate(F.substring("text", 60, 30), _SMALL, _LARGE))
    return Q.table(s, d, "benchmark").where("text is not null").select(F.lit(0).alias("case_id"), F.col("item_id").alias("query_id"), both.alias("phrases"))


def _texts(s, d) -> DataFrame:
    docs = Q.table(s, d, "documents").where("text is not null")
    return docs.select(F.lit(0).alias("case_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("pos"), "text")


@Q.query(f"""WITH q AS ({_PHRASES}), h AS (SELECT query_id, doc_id FROM q JOIN documents ON contains(lower(text), lower(p1)) AND contains(lower(text), lower(p2)))
SELECT q.query_id, h.doc_id AS chunk_id FROM q LEFT JOIN h USING (query_id)""")
def evl1_relevant(s, d):
    found, none = evaluate.relevant(_phrases(s, d), _texts(s, d))
    return found.select("query_id", "chunk_id").unionByName(none.select("query_id", F.lit(None).cast("long").alias("chunk_id")))


@Q.query(f"""WITH q AS (SELECT * FROM ({_PHRASES}) UNION ALL SELECT -query_id - 1, 'never in any text', p2 FROM ({_PHRASES})),
h AS (SELECT DISTINCT query_id FROM q JOIN documents ON contains(lower(text), lower(p1)) AND contains(lower(text), lower(p2))),
l AS (SELECT query_id AS gold_id FROM q UNION ALL SELECT 1000000 + query_id FROM q WHERE query_id >= 0)
SELECT 'no chunk' AS problem, query_id AS gold_id FROM q WHERE query_id NOT IN (SELECT query_id FROM h) UNION ALL SELECT 'no gold row', gold_id FROM l WHERE gold_id NOT IN (SELECT query_id FROM q)""")
def evl9_label_check(s, d):
    gold = _phrases(s, d).withColumnRenamed("query_id", "gold_id")
    never = F.array(F.lit("never in any text"), F.get("phrases", F.lit(1)))
    both = gold.unionByName(gold.select("case_id", (-F.col("gold_id") - 1).alias("gold_id"), never.alias("phrases")))
    labels = both.select("case_id", "gold_id").unionByName(gold.select("case_id", (F.col("gold_id") + 1_000_000).alias("gold_id")))
    absent, orphans = evaluate.label_check(both, labels, _texts(s, d))
    return absent.select(F.lit("no chunk").alias("problem"), "gold_id").unionByName(orphans.select(F.lit("no gold row").alias("problem"), "gold_id"))


@Q.query(f"""WITH p AS ({Q._ext1('v1')}), g AS (SELECT case_id, count(*) AS gold, count(*) FILTER (pos % 8 IN (0, 3)) AS matched FROM ({Q._TENDER}) WHERE pos % 8 IN (0, 3, 6) GROUP BY case_id)
SELECT g.case_id, g.gold, coalesce(n, 0) AS predicted, g.matched FROM g LEFT JOIN (SELECT case_id, count(*) AS n FROM p GROUP BY case_id) x ON x.case_id = g.case_id""")
def evl3_match_gold(s, d):
    """Gold rows name their line's amount (0, 3: one prediction each) or a line that is no requirement (6)."""
    t = Q.tender(s, d).where("pos % 8 in (0, 3, 6)")
    gold = t.select("case_id", F.col("pos").alias("gold_ord"), F.array(F.substring("text", 1, 90), F.lit("the")).alias("phrases"))
    gold = gold.withColumn("phrases", F.transform("phrases", F.upper))
    return evaluate.match_gold(extract.requirements(Q.tender(s, d)).select("case_id", "ord", "text", "quote"), gold)


@Q.query(f"""WITH RECURSIVE p AS ({Q._ext1('v1')}), g AS (SELECT case_id, pos AS gold_ord, CASE pos % 3 WHEN 0 THEN 'turnover' WHEN 1 THEN 'rs. ' || pos % 5 ELSE 'certificate' END AS phrase FROM ({Q._TENDER}) WHERE pos % 8 IN (0, 3, 6)),
e AS (SELECT p.case_id, p.ord, list(gold_ord ORDER BY gold_ord) AS wants FROM p JOIN g ON g.case_id = p.case_id AND contains(lower(p.text || ' ' || p.text), phrase) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ord) AS n FROM e),
step(case_id, n, used) AS (SELECT DISTINCT case_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM g
 UNION ALL SELECT case_id, n, CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END FROM (
  SELECT s.case_id, o.n, used, list_filter(wants, lambda x: NOT list_contains(used, x)) AS free FROM step s JOIN o ON o.case_id = s.case_id AND o.n = s.n + 1))
SELECT g.case_id, count(*) AS gold, (SELECT count(*) FROM p WHERE p.case_id = g.case_id) AS predicted, CAST((SELECT max(len(used)) FROM step s WHERE s.case_id = g.case_id) AS BIGINT) AS matched FROM g GROUP BY g.case_id""")
def evl3_contested(s, d):
    """Gold rows of a few words each, which many predictions hold: who takes which is decided by their order alone."""
    t = Q.tender(s, d).where("pos % 8 in (0, 3, 6)")
    phrase = F.when(F.col("pos") % 3 == 0, F.lit("turnover")).when(F.col("pos") % 3 == 1, F.concat(F.lit("Rs. "), (F.col("pos") % 5).cast("string"))).otherwise(F.lit("Certificate"))
    gold = t.select("case_id", F.col("pos").alias("gold_ord"), F.array(phrase).alias("phrases"))
    return evaluate.match_gold(extract.requirements(Q.tender(s, d)).select("case_id", "ord", "text", "quote"), gold)


@Q.query(f"SELECT case_id, pos AS gold_id, chunk_id, CASE WHEN pos % 2 = 0 THEN text ELSE 'Line ' || CAST(pos AS VARCHAR) || ' before. ' || text END AS span FROM ({Q._TENDER}) WHERE pos % 8 = 3")
def evl5_anchors(s, d):
    """Chunks of three lines each; the phrases stand in the middle line, or in the first two."""
    t = Q.tender(s, d)
    lines = F.concat_ws("\n", F.concat(F.lit("Line "), F.col("pos").cast("string"), F.lit(" before.")), "text", F.lit("A line after it."))
    chunks = t.select("case_id", "chunk_id", "pos", lines.alias("text"))
    first = F.when(F.col("pos") % 2 == 0, F.lit("similar")).otherwise(F.concat(F.lit("line "), F.col("pos").cast("string"), F.lit(" BEFORE")))
    amount = F.concat(F.lit("not less than rs. "), (F.col("pos") * 1000 + 10000).cast("string"), F.lit("."))
    gold = t.where("pos % 8 = 3").select("case_id", F.col("pos").alias("gold_id"), F.array(first, amount).alias("phrases"))
    return evaluate.anchors(gold, chunks)


@Q.query(f"""{N._RULE_MATRIX}, rk AS ({Q._first_n(f"{Q._contains('low', T.RISK_CUES)} AND NOT {Q._PURE}", "text", extract.MAX_RISKS)}), dl AS ({Q._first_n(Q._DEAD, "text", extract.MAX_DEADLINES)}),
c AS (SELECT 'tender_requirement' AS kind, true AS identical FROM m UNION ALL SELECT 'evidence_decision', false FROM m WHERE evidence_chunk_id IS NOT NULL UNION ALL SELECT 'risk', false FROM rk UNION ALL SELECT 'deadline', false FROM dl)
SELECT kind, identical, count(*) AS n FROM c GROUP BY ALL""")
def evl7_claim_pairs(s, d):
    _, matrix = _rule_matrix(s, d)
    pairs = evaluate.claim_pairs(matrix, extract.risks(Q.tender(s, d)), extract.deadlines(Q.tender(s, d)))
    return pairs.groupBy("kind", "identical").agg(F.count("*").alias("n"))


@Q.query(f"""WITH p AS (SELECT case_id, count(*) AS pages, count(*) FILTER (length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 40) AS ocr_pages FROM ({Q._TENDER}) GROUP BY case_id),
c AS (SELECT case_id, count(*) AS chunks FROM ({Q._COMPANY}) GROUP BY case_id), a AS (SELECT case_id, count(*) AS n FROM ({Q._ext1('v1')}) GROUP BY case_id), b AS (SELECT case_id, count(*) AS n FROM ({Q._ext1('v2')}) GROUP BY case_id),
r AS (SELECT CAST(o_custkey % 25 AS INT) AS case_id, CAST(sum(o_orderkey % 1000) AS BIGINT) AS latency_ms, count(*) AS tokens FROM orders GROUP BY ALL)
SELECT p.case_id, pages, ocr_pages, coalesce(chunks, 0) AS chunks, coalesce(a.n, 0) AS extracted_v1, coalesce(b.n, 0) AS extracted_v2, coalesce(latency_ms, 0) AS latency_ms, coalesce(tokens, 0) AS tokens
 FROM p LEFT JOIN c USING (case_id) LEFT JOIN a USING (case_id) LEFT JOIN b USING (case_id) LEFT JOIN r USING (case_id)""")
def evl10_pack_table(s, d):
    t = Q.tender(s, d)
    runs = Q.table(s, d, "orders").select((F.col("o_custkey") % 25).cast("int").alias("case_id"), (F.col("o_orderkey") % 1000).alias("latency_ms"), F.lit(1).alias("tokens"))
    return evaluate.pack_table(chunking.page_quality(t), Q.company(s, d), extract.requirements(t, "v1"), extract.requirements(t, "v2"), runs)


# -- reports -----------------------------------------------------------------------------------------------------------

_RISKS = Q._first_n(f"{Q._contains('low', T.RISK_CUES)} AND NOT {Q._PURE}", "text", extract.MAX_RISKS)
_REPORT = f"""{N._LETTER}, rk AS ({_RISKS}), dl AS ({Q._first_n(Q._DEAD, "text", extract.MAX_DEADLINES)}),
go AS ({N._GO}), cn AS ({N._COUNTS}), per AS (SELECT case_id, 'matrix' AS part FROM m UNION ALL SELECT case_id, 'risks' FROM rk UNION ALL SELECT case_id, 'deadlines' FROM dl
 UNION ALL SELECT case_id, 'letter' FROM lq WHERE n <= 8 UNION ALL SELECT case_id, 'evidence' FROM m WHERE evidence_chunk_id IS NOT NULL),
t AS (SELECT case_id, count(*) FILTER (part = 'matrix') AS matrix, count(*) FILTER (part = 'risks') AS risks, count(*) FILTER (part = 'deadlines') AS deadlines, count(*) FILTER (part = 'letter') AS letter,
 count(*) + count(*) FILTER (part = 'matrix') AS claims FROM per GROUP BY case_id)
SELECT go.case_id, go.go_no_go, cn.summary, coalesce(matrix, 0) AS matrix, coalesce(risks, 0) AS risks, coalesce(deadlines, 0) AS deadlines, coalesce(letter, 0) AS letter, coalesce(claims, 0) AS claims,
 CASE WHEN claims > 0 THEN 'true' END AS passed FROM go LEFT JOIN cn ON cn.case_id = go.case_id LEFT JOIN t ON t.case_id = go.case_id"""


@Q.query(_REPORT)
def snk2_report_parts(s, d):
    """What each case's report document holds, read back from its JSON."""
    part = lambda path: F.get_json_object("report_json", f"$.{path}")
    size = lambda path: F.coalesce(F.json_array_length(part(path)), F.lit(0)).cast("long")
    return Q.snk2_reports(s, d).select(
        "case_id", part("go_no_go").alias("go_no_go"), part("summary").alias("summary"), size("matrix").alias("matrix"), size("risks").alias("risks"),
        size("deadlines").alias("deadlines"), size("letter_quotes").alias("letter"), F.coalesce(part("verification.claims").cast("long"), F.lit(0)).alias("claims"),
        part("verification.passed").alias("passed"),
    )
