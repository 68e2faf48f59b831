import pytest
from pyspark.sql import functions as F

from packreview.functions import text as T
from packreview.operators import decide, extract

CHUNK = "case_id int, chunk_id string, pos long, page int, clause string, section string, filename string, text string"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("turnover of Rs. 22,60,000 a year", [2260000]), ("₹ 1,20,00,000", [12000000]), ("not less than 20 Lakhs", [2000000]), ("One crore only", [10000000]), ("Rupees 3,52,160", []),
        ("Rs. 1000 lakh", [1000, 100000000]), ("twenty five lakh", [500000]), (None, []), ("hrs 1000", [1000]), ("Rs. 5,000 lakh", [5000]), ("Rs. 1,234 lakh", [1234, 23400000]),
    ],
)
def test_amounts(spark, text, want):
    assert one(spark, text, T.amounts_in) == want


def test_alternatives(spark):
    text = "3 (three) similar completed works each of not less than Rs. 9,04,000 or two similar works of value at least 12 lakh or 1 similar work not less than Rs. 18,08,000"
    assert [(a.count, a.amount) if not callable(a.count) else (a["count"], a["amount"]) for a in one(spark, text, T.alternatives)] == [(3, 904000), (2, 1200000), (1, 1808000)]


def test_sentences_keep_abbreviations(spark):
    got = one(spark, "Turnover of Rs. 50,00,000 is needed. The bidder shall apply.\nToo short.\n\nSee No. 5 of the annexed schedule. And Mr. Rao signs the agreement.", T.sentences)
    assert got == ["Turnover of Rs. 50,00,000 is needed.", "The bidder shall apply.", "See No. 5 of the annexed schedule.", "And Mr. Rao signs the agreement."]


def test_small_text_functions(spark):
    row = spark.createDataFrame([("2.1 Bidder shall  pay 5% of cost by 15-Oct-2026, not less than 30 guards",)], "t string").select(
        T.clause_number(F.col("t")).alias("clause"), T.whitespace_norm(F.col("t")).alias("norm"), T.has_date(F.col("t")).alias("date"), T.percent_near(F.col("t"), F.lit("cost")).alias("pct"), T.headcount(F.col("t")).alias("head"),
        T.quote_supported(F.lit("Bidder shall pay 5% of cost"), F.col("t")).alias("ok"), T.quote_supported(F.lit("pay 5%"), F.col("t")).alias("short"), T.safe_file_name(F.lit("a/b/../x y?.pdf")).alias("file"),
        T.is_heading(F.lit("SECTION A")).alias("h1"), T.is_heading(F.lit("BIDDER SHOULD HAVE TURNOVER")).alias("h2"), T.is_heading(F.lit("ELIGIBILITY")).alias("h3"), T.trigram_jaccard(F.lit("abcd"), F.lit("abce")).alias("j"),
        T.amount_hint(F.lit("Rs. 5000 and Rs. 6000")).alias("hint"), T.is_banner(F.lit("Synthetic sample")).alias("banner"), T.domain_ok(F.lit("civil works"), F.lit("security guards")).alias("dom"),
    ).first()
    assert (row.clause, row.date, row.pct, row.head, row.ok, row.short, row.file) == ("2.1", True, 5.0, 30, True, False, "x_y_.pdf")
    assert row.norm.startswith("2.1 Bidder shall pay") and (row.h1, row.h2, row.h3) == (True, False, True) and abs(row.j - 1 / 3) < 1e-9
    assert row.hint == " [amounts: 5000 INR, 6000 INR]" and row.banner and not row.dom


def need(spark, text):
    return spark.createDataFrame([(1, 1, text)], "case_id int, req_id int, text string")


def hits(spark, *texts):
    return spark.createDataFrame([(1, 1, i + 1, f"c{i}", t, 1, None, "f.txt") for i, t in enumerate(texts)], "case_id int, req_id int, rank int, chunk_id string, text string, page int, clause string, filename string")


@pytest.mark.parametrize(
    ("text", "evidence", "decision", "obligation"),
    [
        ("Average annual turnover of at least Rs. 50,00,000", ["The annual turnover of the firm is Rs. 1,20,00,000."], "met", "qualification"),
        ("Average annual turnover of at least Rs. 50,00,000", ["The annual turnover of the firm is Rs. 40,00,000."], "not_met", "qualification"),
        ("Average annual turnover of at least Rs. 50,00,000", ["Nothing of the kind is in this file."], "missing", "qualification"),
        ("Turnover of 30 percent of estimated cost is needed", ["The annual turnover of the firm is Rs. 40,00,000."], "unclear", "qualification"),
        ("The bidder must have completed one similar civil work of not less than Rs. 20,00,000", ["Work order for civil construction valued at Rs. 45,00,000."], "met", "qualification"),
        ("two similar works each of at least Rs. 20,00,000", ["Work order valued at Rs. 45,00,000 in all.", "Work order valued at Rs. 15,00,000 in all."], "not_met", "qualification"),
        ("The bidder shall not have been blacklisted", ["The firm has never been blacklisted by anyone."], "met", "qualification"),
        ("The bidder shall not have been blacklisted", ["The firm was blacklisted by one department."], "not_met", "qualification"),
        ("At least 50 manpower on roll", ["Manpower on roll is 30 as of today."], "not_met", "qualification"),
        ("EMD of Rs. 1,00,000 to be paid", ["Nothing of the kind is in this file."], "missing", "submission"),
        ("EMD of Rs. 1,00,000 to be paid", ["A demand draft for the EMD was remitted."], "met", "submission"),
        ("Make in India declaration", ["Nothing of the kind is in this file."], "unclear", "qualification"),
        ("The bidder shall hold a valid GST registration", [], "missing", "qualification"),
        ("Something else is asked of the bidder", ["Anything at all may be in here."], "unclear", "qualification"),
    ],
)
def test_decisions(spark, text, evidence, decision, obligation):
    h = hits(spark, *evidence) if evidence else hits(spark, "x").where("false")
    row = decide.matrix(need(spark, text), h).first()
    assert (row.decision, row.obligation) == (decision, obligation), row.rationale
    assert (row.evidence_quote is not None) == (decision in ("met", "not_met"))


def test_money_text_and_cost(spark):
    cost = spark.createDataFrame([(1, 10_000_000)], "case_id int, cost long")
    row = decide.matrix(need(spark, "Turnover of 30 percent of estimated cost is needed"), hits(spark, "The annual turnover of the firm is Rs. 40,00,000."), cost).first()
    assert row.decision == "met" and row.rationale == "Cited turnover of Rs. 4,000,000 meets the threshold of Rs. 3,000,000."


def test_go_no_go(spark):
    cases = spark.createDataFrame([(i,) for i in range(5)], "case_id int")
    rows = spark.createDataFrame([(0, "met", "qualification"), (1, "missing", "submission"), (2, "missing", "qualification"), (3, "not_met", "submission")], "case_id int, decision string, obligation string")
    assert {r.case_id: r.go_no_go for r in decide.go_no_go(cases, rows).collect()} == {0: "GO", 1: "CONDITIONAL", 2: "NO-GO", 3: "NO-GO", 4: "CONDITIONAL"}


def test_dedupe_by_containment(spark):
    rows = spark.createDataFrame([(1, 1, "The bidder shall pay the fee in full"), (1, 2, "bidder  shall pay the fee"), (1, 3, "Another thing is asked"), (1, 4, "")], "case_id int, ord int, quote string")
    assert sorted(r.ord for r in extract.dedupe_containment(rows).collect()) == [1, 3]


def test_span_menu_and_quote_search(spark):
    text = "The bidder shall submit the earnest money deposit in time. This other sentence is long enough but asks nothing at all. Short one here, so to say."
    chunks = spark.createDataFrame([(1, "a", 1, 1, None, None, "f", text), (1, "b", 2, 2, None, None, "f", "Plain words that nobody would ever call a duty of anyone.")], CHUNK)
    menu = [(r.span_id, r.chunk_id) for r in extract.span_menu(chunks).orderBy("n").collect()]
    assert menu == [("S1", "a"), ("S2", "b")]
    claims = spark.createDataFrame([(1, 1, "asks nothing at all. Short one", "b"), (1, 2, "no such words in any of them", "a")], "case_id int, claim_id int, quote string, chunk_id string")
    assert {r.claim_id: r.found_chunk for r in extract.chunk_of_quote(claims, chunks).collect()} == {1: "a", 2: None}


def test_model_merges(spark):
    chunks = spark.createDataFrame([(1, "a", 1, 3, "2", None, "f", "The bidder shall submit the earnest money deposit in time.")], CHUNK)
    menu = extract.span_menu(chunks)
    items = spark.createDataFrame([(1, 1, "s-1", None, None, None, "pay"), (1, 2, "none", "submit the earnest money deposit", "zz", "financial", "x"), (1, 3, "S9", "not there at all, not at all", "a", None, "y")], "case_id int, item_id int, span_id string, quote string, chunk_id string, kind string, text string")
    got = {r.item_id: (r.kind, r.text, r.page) for r in decide.merge_model_requirements(items, menu, chunks).collect()}
    assert got == {1: ("eligibility", "The bidder shall submit the earnest money deposit in time.", 3), 2: ("financial", "submit the earnest money deposit", 3)}
    rows = spark.createDataFrame([("b", n, "met", "qualification", "rule", "q", "c", 1) for n in (1, 2)] + [("lost", 1, "met", "qualification", "rule", "q", "c", 1)], "batch_id string, n int, decision string, obligation string, rationale string, evidence_quote string, evidence_chunk_id string, evidence_page int")
    item = "struct<id:string,decision:string,obligation:string,evidence_span:string,rationale:string>"
    replies = spark.createDataFrame([("b", [("R1", "Not Met", None, "E1", "why"), ("zz", "odd", None, "E7", None)])], f"batch_id string, items array<{item}>")
    spans = spark.createDataFrame([("b", 1, "E1", "the span", "k", 4)], "batch_id string, n int, span_id string, text string, chunk_id string, page int")
    out = {(r.batch_id, r.n): r for r in decide.merge_model_decisions(rows, replies, spans).collect()}
    assert (out["b", 1].decision, out["b", 1].evidence_quote, out["b", 1].rule_decision) == ("not_met", "the span", "met")
    assert (out["b", 2].decision, out["b", 2].evidence_quote) == ("unclear", None) and out["lost", 1].decision == "met"
    assert {(r.batch_id, r.decision) for r in decide.merge_model_decisions(rows, replies, spans, fallback=False).where("batch_id = 'lost'").collect()} == {("lost", "unclear")}
