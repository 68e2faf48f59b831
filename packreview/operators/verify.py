"""Citation checks and the query letter. chunks: case_id, chunk_id, text, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.functions import text as T

STAGES = ("extractor", "eligibility", "risk", "drafter")
DISCLAIMER = "Draft for a human to review. This is not legal advice and it is not a bid recommendation from the tendering authority."
#: Fixed questions, by decision.
QUESTIONS = {
    "submission": "Please confirm the acceptable form, the validity required, and the authority in whose favour this is to be drawn.",
    "missing": "Please confirm whether this qualification is mandatory and which document will be accepted as evidence.",
    "not_met": "Please confirm whether an MSME or startup relaxation applies to this threshold, and which document should demonstrate it.",
    "other": "Please confirm the exact threshold, the financial years to be counted, and the document that will be accepted.",
    "date": "Please confirm that this date is unchanged by any corrigendum, and confirm the timezone.",
}


def claims(requirements: DataFrame, matrix: DataFrame, risks: DataFrame, deadlines: DataFrame, letter: DataFrame) -> DataFrame:
    """VER1: (case_id, stage, quote, chunk_id) of everything that cites a chunk."""
    cite = lambda df, stage, quote, chunk: df.select("case_id", F.lit(stage).alias("stage"), F.col(quote).alias("quote"), F.col(chunk).alias("chunk_id"))
    parts = [
        cite(requirements, "extractor", "quote", "chunk_id"), cite(matrix, "eligibility", "quote", "chunk_id"), cite(matrix.where("evidence_quote <> ''"), "eligibility", "evidence_quote", "evidence_chunk_id"),
        cite(risks, "risk", "quote", "chunk_id"), cite(deadlines, "risk", "quote", "chunk_id"), cite(letter, "drafter", "quote", "chunk_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checked(cl: DataFrame, chunks: DataFrame) -> DataFrame:
    """Claims with a quote, and whether the cited chunk supports it; a chunk that is not there does not."""
    source = chunks.select("case_id", "chunk_id", F.col("text").alias("__source"))
    # of derived text Spark knows no size; it would broadcast all chunks where they come from a small file
    joined = cl.where("quote <> ''").join(source.hint("merge"), ["case_id", "chunk_id"], "left")
    return joined.withColumn("supported", T.quote_supported(F.col("quote"), F.col("__source"))).drop("__source")


def unsupported(cl: DataFrame, chunks: DataFrame) -> DataFrame:
    """VER2."""
    return checked(cl, chunks).where("not supported").select("case_id", "stage", "quote", "chunk_id")


def first_stage(failures: DataFrame) -> DataFrame:
    """VER3: the first stage of each case that has a failure."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    return failures.groupBy("case_id").agg(F.min_by("stage", at).alias("stage"))


def _without(rows: DataFrame, failures: DataFrame, stage: str, quote: str, chunk: str) -> DataFrame:
    bad = failures.where(F.col("stage") == stage).select(F.col("case_id").alias("__case"), F.col("quote").alias("__quote"), F.col("chunk_id").alias("__chunk")).distinct()
    same = (F.col("case_id") == F.col("__case")) & F.col(quote).eqNullSafe(F.col("__quote")) & F.col(chunk).eqNullSafe(F.col("__chunk"))
    return rows.join(bad, same, "left_anti")


def strip_unsupported(requirements: DataFrame, matrix: DataFrame, risks: DataFrame, deadlines: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    """VER4: each table without unsupported rows (the matrix by either quote), and the letter's queries drawn anew from them."""
    m = _without(_without(matrix, failures, "eligibility", "quote", "chunk_id"), failures, "eligibility", "evidence_quote", "evidence_chunk_id")
    d = _without(deadlines, failures, "risk", "quote", "chunk_id")
    letter = _without(letter_queries(m, d), failures, "drafter", "quote", "chunk_id")
    return {"requirements": _without(requirements, failures, "extractor", "quote", "chunk_id"), "matrix": m, "risks": _without(risks, failures, "risk", "quote", "chunk_id"), "deadlines": d, "letter": letter}


def faithfulness(cl: DataFrame, chunks: DataFrame) -> DataFrame:
    """VER5: supported and total claims of each case and, with case_id null, of all; extractor claims do not count."""
    c = checked(cl.where("stage <> 'extractor'"), chunks)
    out = c.rollup("case_id").agg(F.count("*").alias("total"), F.count_if("supported").alias("supported"))
    return out.withColumn("rate", F.try_divide("supported", "total"))


def letter_queries(matrix: DataFrame, deadlines: DataFrame) -> DataFrame:
    """LET1: n, quote, citation and question of at most eight queries a case: six open rows, then the first two deadlines."""
    sort = F.when(F.col("decision") == "not_met", 0).when(F.col("decision") == "unclear", 1).when(F.col("decision") == "missing", 2).otherwise(9)
    rows = matrix.where("decision <> 'met' and quote <> '' and chunk_id <> ''").withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(sort, "ord"))).where("n <= 6")
    ask = (
        F.when((F.col("decision") == "missing") & (F.col("obligation") == "submission"), QUESTIONS["submission"]).when(F.col("decision") == "missing", QUESTIONS["missing"])
        .when(F.col("decision") == "not_met", QUESTIONS["not_met"]).otherwise(QUESTIONS["other"])
    )
    cols = ["case_id", "n", "quote", "chunk_id", "clause", "page", "filename"]
    dates = deadlines.where("ord <= 2 and quote <> '' and chunk_id <> ''").withColumn("n", F.col("ord") + 6)
    both = rows.select(*cols, ask.alias("question")).unionByName(dates.select(*cols, F.lit(QUESTIONS["date"]).alias("question")))
    both = both.withColumn("filename", F.coalesce("filename", F.lit("tender")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("n"))).where("n <= 8")


def letters(cases: DataFrame, queries: DataFrame) -> DataFrame:
    """LET2: (case_id, letter) for every case(case_id, title)."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    item = F.concat(F.col("n").cast("string"), F.lit(". Clause "), dash("clause"), F.lit(", page "), dash("page"), F.lit(" ("), F.col("filename"), F.lit(').\n   Tender text: "'), F.col("quote"), F.lit('"\n   Query: '), F.col("question"), F.lit("\n"))
    body = queries.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(
        F.lit("To\nThe Tender Inviting Authority\n\nSubject: Pre-bid queries regarding "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("the tender")),
        F.lit("\n\nSir or Madam,\n\nWe intend to participate in the subject tender. Please clarify the points below. Each point quotes the tender text it refers to.\n\n"),
    )
    none = F.lit("We have no clarification on the clauses extracted from the tender pack.\n")
    tail = F.lit(f"\n{DISCLAIMER}\n\nYours faithfully,\n[Authorised signatory]\n[Company name]")
    return cases.join(body, "case_id", "left").select("case_id", F.concat(head, F.coalesce("body", none), tail).alias("letter"))
