"""Queries on decisions whose evidence is searched for, with SQL of the whole way: extraction, search, decision, letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packreview.functions import text as T
from packreview.jobs import queries as Q
from packreview.jobs import review as R
from packreview.jobs import search_sql as S
from packreview.operators import decide, extract, retrieval, verify
from packreview.sources.scratch import materialise

# Text for the rules that the other derived text has no line of; the same statements run in Spark and in DuckDB.
RULES_TENDER = """
SELECT CAST(c_nationkey AS INT) AS case_id, 'r-' || CAST(c_custkey AS STRING) AS chunk_id, c_custkey AS pos,
  CAST(c_custkey % 20 + 1 AS INT) AS page,
  CASE c_custkey % 10
   WHEN 0 THEN 'The bidder shall have a net worth of at least Rs. ' || CAST(c_custkey * 1000 + 10000 AS STRING) || ' as per the audited balance sheet.'
   WHEN 1 THEN 'The bidder should not have incurred any loss in more than two years for lot ' || CAST(c_custkey AS STRING) || ' of the work.'
   WHEN 2 THEN 'The bidder must hold a valid PSARA licence for the state of lot ' || CAST(c_custkey AS STRING) || '.'
   WHEN 3 THEN 'A copy of the PAN card of the bidder shall be enclosed with offer ' || CAST(c_custkey AS STRING) || '.'
   WHEN 4 THEN 'The bidder must have manpower of at least ' || CAST(c_custkey % 900 + 10 AS STRING) || ' security guards on the rolls of the firm.'
   WHEN 5 THEN 'The bidder shall hold a valid ISO 9001 certificate for lot ' || CAST(c_custkey AS STRING) || '.'
   WHEN 6 THEN 'Only a Class-I local supplier shall be eligible for purchase under lot ' || CAST(c_custkey AS STRING) || '.'
   WHEN 7 THEN 'The bidder shall have an average annual turnover of at least ' || CAST(c_custkey % 140 + 5 AS STRING) || ' percent of the estimated value of the work.'
   WHEN 8 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'Estimated cost of the whole job is Rs. ' || CAST(c_custkey * 100 + 10000 AS STRING) || ' for lot ' || CAST(c_custkey AS STRING) || '.'
     ELSE 'The job is to be done at site ' || CAST(c_custkey AS STRING) || ' of the department.' END
   ELSE 'The bidder shall have successfully completed orders to the satisfaction of office ' || CAST(c_custkey AS STRING) || '.' END AS text
FROM {customer}"""
RULES_COMPANY = """
SELECT CAST(s_nationkey AS INT) AS case_id, 'e-' || CAST(s_suppkey AS STRING) || '-' || CAST(k AS STRING) AS chunk_id, s_suppkey * 8 + k AS pos,
  CASE k
   WHEN 0 THEN 'Net worth of the firm as per the audited balance sheet is Rs. ' || CAST(s_suppkey * 9000 + 10000 AS STRING) || '.'
   WHEN 1 THEN CASE WHEN s_suppkey % 4 = 0 THEN 'The firm incurred a loss in one of the last five years.' ELSE 'The firm has not incurred a loss in the last five years.' END
   WHEN 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'PSARA licence of the firm is valid to the year 2028.' ELSE 'Lease deed of the registered office number ' || CAST(s_suppkey AS STRING) || '.' END
   WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Permanent Account Number of the firm is issued and active.' ELSE 'Brochure of the firm in colour, edition ' || CAST(s_suppkey AS STRING) || '.' END
   WHEN 4 THEN 'Manpower on roll is ' || CAST(s_suppkey % 700 + 1 AS STRING) || ' as per the wage register.'
   WHEN 5 THEN CASE WHEN s_suppkey % 5 = 0 THEN 'ISO 9001 certificate of the firm issued in 2024.' ELSE 'Letter of thanks of a client, file ' || CAST(s_suppkey AS STRING) || '.' END
   WHEN 6 THEN CASE WHEN s_suppkey % 4 = 1 THEN 'Declaration of Class-I local content by the firm.' ELSE 'Photograph of the head office, print ' || CAST(s_suppkey AS STRING) || '.' END
   ELSE 'Average annual turnover of the firm is Rs. ' || CAST(s_suppkey * 700 + 10000 AS STRING) || ' as audited.' END AS text
FROM {supplier} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) ks
WHERE (s_suppkey + k) % 3 <> 1"""
_RT, _RC = RULES_TENDER.replace("{customer}", "customer"), RULES_COMPANY.replace("{supplier}", "supplier")


def _rules(s, d) -> tuple[DataFrame, DataFrame]:
    tender = s.sql(RULES_TENDER, customer=Q.table(s, d, "customer"))
    return tender, s.sql(RULES_COMPANY, supplier=Q.table(s, d, "supplier"))


_RULE_SQL = """CASE WHEN contains(low, 'turnover') THEN 'turnover' WHEN contains(low, 'solvency') THEN 'solvency' WHEN contains(low, 'net worth') THEN 'net worth'
 WHEN regexp_matches(low, 'similar(\\s+[a-z]+){0,4}\\s+works?\\b') THEN 'similar' WHEN contains(low, 'loss') AND contains(low, 'year') THEN 'loss' WHEN contains(low, 'psara') THEN 'psara'
 WHEN regexp_matches(low, '\\bgst\\b') THEN 'gst' WHEN regexp_matches(low, '\\bpan\\b') THEN 'pan' WHEN contains(low, 'blacklist') THEN 'blacklist' WHEN contains(low, 'manpower') THEN 'manpower'
 WHEN regexp_matches(low, '\\biso\\b') THEN 'iso' WHEN contains(low, 'class-i') THEN 'class-i' WHEN contains(low, 'earnest') THEN 'emd' END"""
_LABELS = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decide.LABELS.items()) + " END"
_MARKS = ", ".join(f"('{rule}', '{m}')" for rule, ms in decide.MARKERS.items() for m in ms)


def matrix_sql(tender: str, company: str, found: str, hits: str, cost: str) -> str:
    """CTEs that end in m: one row for each requirement. found: the search's CTEs; hits: the one with its result."""
    return f"""WITH req0 AS ({Q._ext1('v1', tender)}),
{found},
req AS (SELECT case_id, ord AS req_id, kind, text, chunk_id, page, clause, {_RULE_SQL} AS rule,
  CASE WHEN contains(low, ' lakh') THEN CAST(regexp_extract(low, '([0-9]+) lakh', 1) AS BIGINT) * 100000 ELSE CAST(nullif(regexp_extract(low, 'rs\\. ([0-9]+)', 1), '') AS BIGINT) END AS need0,
  CAST(nullif(regexp_extract(low, 'completed ([0-9]) similar', 1), '') AS INT) AS cnt, CAST(nullif(regexp_extract(low, 'at least ([0-9]{{2,5}}) security', 1), '') AS INT) AS asked,
  CAST(nullif(regexp_extract(low, '([0-9]+) percent', 1), '') AS BIGINT) AS pct0 FROM (SELECT *, lower(text) AS low FROM req0)),
cost AS ({cost}),
rc AS (SELECT req.*, cost.cost, CASE WHEN pct0 BETWEEN 1 AND 100 THEN pct0 END AS pct, CASE WHEN need0 IS NOT NULL THEN need0 WHEN pct0 BETWEEN 1 AND 100 AND coalesce(cost.cost, 0) <> 0
  THEN CAST(floor(cost.cost * CAST(pct0 AS DOUBLE) / 100) AS BIGINT) END AS need FROM req LEFT JOIN cost ON cost.case_id = req.case_id),
mk AS (SELECT * FROM (VALUES {_MARKS}) AS t(rule, marker)),
ev AS (SELECT CAST(case_id AS VARCHAR) AS corpus, chunk_id, text, lower(text) AS low, CAST(nullif(regexp_extract(text, 'Rs\\. ([0-9]+)', 1), '') AS BIGINT) AS amount,
  CAST(nullif(regexp_extract(text, 'roll is ([0-9]+)', 1), '') AS INT) AS seen FROM ({company})),
j AS (SELECT DISTINCT r.case_id, r.req_id, h.rank, e.chunk_id, e.amount, e.seen, e.low FROM rc r JOIN mk ON mk.rule = r.rule JOIN {hits} h ON h.corpus = CAST(r.case_id AS VARCHAR) AND h.query_id = r.req_id
  JOIN ev e ON e.corpus = h.corpus AND e.chunk_id = h.chunk_id AND contains(e.low, mk.marker)),
b AS (SELECT r.*, x.rank, x.echunk, x.amount, x.seen, x.elow, x.good, x.goodchunk, x.top, x.topchunk FROM rc r LEFT JOIN (
  SELECT j.case_id, j.req_id, min(j.rank) AS rank, arg_min(j.chunk_id, j.rank) AS echunk, arg_min(coalesce(j.amount, -1), j.rank) AS amount, arg_min(coalesce(j.seen, -1), j.rank) AS seen, arg_min(j.low, j.rank) AS elow,
   count(*) FILTER (j.amount >= r2.need AND contains(j.low, 'civil')) AS good, arg_min(j.chunk_id, j.rank) FILTER (j.amount >= r2.need AND contains(j.low, 'civil')) AS goodchunk,
   max(j.amount) FILTER (contains(j.low, 'civil')) AS top, arg_max(j.chunk_id, j.amount * 1000 - j.rank) FILTER (contains(j.low, 'civil')) AS topchunk
  FROM j JOIN rc r2 ON r2.case_id = j.case_id AND r2.req_id = j.req_id GROUP BY ALL) x ON x.case_id = r.case_id AND x.req_id = r.req_id),
o AS (SELECT *, {_LABELS} AS label, list_transform(list_value(1), lambda z: CASE
   WHEN rule IN ('turnover', 'solvency', 'net worth') THEN CASE
     WHEN need0 IS NULL AND pct IS NOT NULL AND coalesce(cost, 0) = 0 THEN ['unclear', upper(rule[1]) || rule[2:] || ' is a percentage of estimated cost, and no estimated cost was read from the tender.', NULL]
     WHEN need IS NULL THEN ['unclear', 'A ' || rule || ' clause was found but no rupee threshold was parsed.', echunk]
     WHEN rank IS NULL THEN ['missing', 'No uploaded document states ' || rule || '.', NULL]
     WHEN amount >= need THEN ['met', 'Cited ' || rule || ' of Rs. ' || format('{{:,}}', amount) || ' meets the threshold of Rs. ' || format('{{:,}}', need) || '.', echunk]
     ELSE ['not_met', 'Cited ' || rule || ' of Rs. ' || format('{{:,}}', amount) || ' is below the threshold of Rs. ' || format('{{:,}}', need) || '.', echunk] END
   WHEN rule = 'similar' THEN CASE
     WHEN top IS NULL THEN ['missing', 'No uploaded work completion or work order matches this similar-work clause.', NULL]
     WHEN good >= cnt THEN ['met', good || ' cited work(s) meet the alternative of ' || cnt || ' work(s) at Rs. ' || format('{{:,}}', need) || '.', goodchunk]
     ELSE ['not_met', 'The strongest cited similar work is Rs. ' || format('{{:,}}', top) || ', which does not meet any stated alternative.', topchunk] END
   WHEN rule IN ('loss', 'blacklist') THEN CASE
     WHEN rank IS NULL THEN ['missing', 'No uploaded document speaks to ' || {_LABELS} || '.', NULL]
     WHEN contains(elow, 'has not incurred') OR contains(elow, 'never been blacklisted') THEN ['met', 'The cited document supports the ' || {_LABELS} || ' requirement.', echunk]
     ELSE ['not_met', 'The cited document contradicts the ' || {_LABELS} || ' requirement.', echunk] END
   WHEN rule = 'manpower' THEN CASE
     WHEN rank IS NULL THEN ['missing', 'No uploaded document states manpower on roll.', NULL]
     WHEN seen >= asked THEN ['met', 'Cited manpower of ' || seen || ' meets the stated ' || asked || '.', echunk]
     ELSE ['not_met', 'Cited manpower of ' || seen || ' is below the stated ' || asked || '.', echunk] END
   WHEN rule = 'emd' THEN CASE WHEN contains(elow, 'demand draft') THEN ['met', 'A company document cites an earnest-money instrument.', echunk]
     ELSE ['missing', 'No earnest-money instrument was in the uploaded company documents. This is a submission item, not a capacity test.', NULL] END
   WHEN rule IS NULL THEN ['unclear', 'The sentence was extracted as a requirement, but no machine-readable check matched it.', NULL]
   WHEN rank IS NOT NULL THEN ['met', 'The uploaded documents include a ' || {_LABELS} || '.', echunk]
   ELSE [CASE WHEN rule = 'class-i' THEN 'unclear' ELSE 'missing' END, 'No uploaded document shows a ' || {_LABELS} || '.', NULL] END)[1] AS d FROM b),
m AS (SELECT case_id, req_id, kind, text, chunk_id, page, clause, d[1] AS decision, CASE WHEN rule = 'emd' THEN 'submission' ELSE 'qualification' END AS obligation, d[2] AS rationale, d[3] AS evidence_chunk_id FROM o)"""


def _corpora(tender: str, company: str) -> tuple[str, str]:
    return (
        "SELECT CAST(case_id AS VARCHAR) AS corpus, ord AS query_id, text FROM req0",
        f"SELECT CAST(case_id AS VARCHAR) AS corpus, chunk_id, pos, text FROM ({company})",
    )


_NO_COST = "SELECT -1 AS case_id, 0 AS cost"
_SEARCHED = matrix_sql(Q._TENDER, Q._COMPANY, S.hybrid_rerank(*_corpora(Q._TENDER, Q._COMPANY), 8), "rr", _NO_COST)
_COLUMNS = "case_id, req_id, text, decision, obligation, rationale, evidence_chunk_id"
_GO = """SELECT n.case_id, CASE WHEN bool_or(decision = 'not_met' OR (decision = 'missing' AND obligation = 'qualification')) THEN 'NO-GO'
 WHEN coalesce(bool_or(decision <> 'met'), true) THEN 'CONDITIONAL' ELSE 'GO' END AS go_no_go FROM (SELECT CAST(n_nationkey AS INT) AS case_id FROM nation) n LEFT JOIN m ON m.case_id = n.case_id GROUP BY n.case_id"""
_COUNTS = """SELECT *, CAST(n AS VARCHAR) || ' requirement(s): ' || met || ' met, ' || not_met || ' not met, ' || missing || ' missing, ' || unclear || ' unclear.' AS summary FROM (
 SELECT case_id, count(*) AS n, count(*) FILTER (decision = 'met') AS met, count(*) FILTER (decision = 'not_met') AS not_met, count(*) FILTER (decision = 'missing') AS missing, count(*) FILTER (decision = 'unclear') AS unclear FROM m GROUP BY case_id)"""
_QUOTE = "CASE WHEN contains(e.text, ' Status:') THEN left(e.text, position(' Status:' IN e.text) - 1) ELSE e.text END"
Q.ORACLE["dec9_matrix_searched"] = f"""{_SEARCHED} SELECT m.case_id, req_id, m.text, decision, obligation, rationale, evidence_chunk_id, {_QUOTE} AS evidence_quote, CAST(NULL AS INT) AS evidence_page, CAST(NULL AS VARCHAR) AS evidence_clause
 FROM m LEFT JOIN ({Q._COMPANY}) e ON e.case_id = m.case_id AND e.chunk_id = m.evidence_chunk_id"""
Q.ORACLE["dec10_go_no_go_searched"] = f"{_SEARCHED} {_GO}"
Q.ORACLE["dec11_counts_searched"] = f"{_SEARCHED} {_COUNTS}"

_RULE_COST = f"SELECT case_id, max(pos * 100 + 10000) AS cost FROM ({_RT}) WHERE contains(text, 'Estimated cost') GROUP BY case_id"
_RULE_MATRIX = matrix_sql(
    _RT, _RC, S.inputs(*_corpora(_RT, _RC)) + ",\n" + S.bm25(8), "br", _RULE_COST
)


@Q.query(f"{_RULE_MATRIX} SELECT {_COLUMNS} FROM m")
def dec9_rules(s, d):
    """Net worth, loss, PSARA, PAN, manpower, ISO, Class-I and shares of the estimated cost, on evidence ranked by BM25."""
    tender, company = _rules(s, d)
    req = materialise(extract.requirements(tender).withColumn("req_id", F.col("ord")), "requirements", plain=True)
    hits = R.evidence_hits(req, company, mode="bm25")
    out = decide.matrix(req, hits, extract.estimated_cost(tender))
    return out.select("case_id", "req_id", "text", "decision", "obligation", "rationale", "evidence_chunk_id")


_CASE_SEARCH = f"WITH req0 AS ({Q._ext1('v1')}),\n"
_PICK = " SELECT corpus, query_id, chunk_id, rank, round(score, 6) AS score FROM "
Q.ORACLE["ret7_hybrid"] = _CASE_SEARCH + S.hybrid(*_corpora(Q._TENDER, Q._COMPANY), 8) + _PICK + "fr"
Q.ORACLE["ret7_hybrid_rerank"] = _CASE_SEARCH + S.hybrid_rerank(*_corpora(Q._TENDER, Q._COMPANY), 8) + _PICK + "rr"
Q.ORACLE["ret1_hash_embedding"] = (
    "WITH " + S.inputs("SELECT 'all' AS corpus, 0 AS query_id, '' AS text", "SELECT 'all' AS corpus, doc_id AS chunk_id, doc_id AS pos, text FROM documents") + ",\n" + S.hashed()
    + " SELECT chunk_id, count(*) AS dims, round(sum(w * w), 6) AS norm FROM cv GROUP BY chunk_id"
)


@Q.query(_CASE_SEARCH + S.inputs(*_corpora(Q._TENDER, Q._COMPANY)) + ",\n" + S.hashed() + ",\n" + S.vector(8) + _PICK + "vr")
def ret2_hash_top8(s, d):
    return retrieval.search(Q._case_queries(s, d), Q._case_chunks(s, d), 8, "vector", True).withColumn("score", F.round("score", 6))


@Q.query(_CASE_SEARCH + S.inputs(*_corpora(Q._TENDER, Q._COMPANY)) + ",\n" + S.bm25(8) + _PICK + "br")
def ret7_bm25_padded(s, d):
    return retrieval.search(Q._case_queries(s, d), Q._case_chunks(s, d), 8, "bm25", True).withColumn("score", F.round("score", 6))


# The review's letter: every open row's question in order, then the first two dates.
_DATES = f"""dates AS (SELECT case_id, ord, text, chunk_id, page FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id, substr(low, 1, 220) ORDER BY pos) AS n FROM (SELECT *, lower(text) AS low FROM ({Q._TENDER})) WHERE {Q._DEAD}) WHERE n = 1) WHERE ord <= 2)"""
_ASK = f"""CASE WHEN decision = 'missing' AND obligation = 'submission' THEN '{verify.QUESTIONS['submission']}' WHEN decision = 'missing' THEN '{verify.QUESTIONS['missing']}'
 WHEN decision = 'not_met' THEN '{verify.QUESTIONS['not_met']}' ELSE '{verify.QUESTIONS['other']}' END"""
_LETTER = f"""{_SEARCHED}, {_DATES},
open AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE decision WHEN 'not_met' THEN 0 WHEN 'unclear' THEN 1 WHEN 'missing' THEN 2 ELSE 9 END, req_id) AS n FROM m WHERE decision <> 'met'),
lq AS (SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY n) AS INT) AS n, quote, chunk_id, clause, page, 'tender' AS filename, question FROM (
  SELECT case_id, n, text AS quote, chunk_id, clause, page, {_ASK} AS question FROM open WHERE n <= 6
  UNION ALL SELECT case_id, ord + 6, text, chunk_id, NULL, page, '{verify.QUESTIONS['date']}' FROM dates))"""
Q.ORACLE["let1_letter_queries"] = f"{_LETTER} SELECT * FROM lq WHERE n <= 8"
_HEAD = "'To\nThe Tender Inviting Authority\n\nSubject: Pre-bid queries regarding ' || n_name || '\n\nSir or Madam,\n\nWe intend to participate in the subject tender. Please clarify the points below. Each point quotes the tender text it refers to.\n\n'"
_ITEM = """n || '. Clause ' || coalesce(clause, '—') || ', page ' || page || ' (' || filename || ').\n   Tender text: "' || quote || '"\n   Query: ' || question || '\n'"""
Q.ORACLE["let2_letters"] = f"""{_LETTER}, body AS (SELECT case_id, string_agg({_ITEM}, chr(10) ORDER BY n) AS body FROM lq WHERE n <= 8 GROUP BY case_id)
SELECT CAST(n_nationkey AS INT) AS case_id, {_HEAD} || coalesce(body, 'We have no clarification on the clauses extracted from the tender pack.\n')
 || '\n{verify.DISCLAIMER}\n\nYours faithfully,\n[Authorised signatory]\n[Company name]' AS letter FROM nation LEFT JOIN body ON case_id = n_nationkey"""
Q.ORACLE["ext8_span_menu"] = f"""SELECT case_id, 'S' || n AS span_id, CAST(n AS INT) AS n, chunk_id, page, text FROM (
 SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS n FROM ({Q._TENDER}) WHERE length(text) >= 40)"""
