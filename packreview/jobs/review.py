"""Jobs over all cases: extract, match, decide, verify, report; and queries on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.operators import decide, extract, retrieval, verify
from packreview.sources.scratch import materialise

HITS = 8


def evidence_hits(requirements: DataFrame, company: DataFrame, k: int = HITS, mode: str = "hybrid_rerank", pad: bool = True) -> DataFrame:
    """Top company chunks of each requirement within its case. requirements: case_id, req_id, text; company: chunk rows by case."""
    queries = requirements.select(F.col("case_id").cast("string").alias("corpus"), F.col("req_id").alias("query_id"), "text")
    chunks = company.select(F.col("case_id").cast("string").alias("corpus"), "chunk_id", "pos", "text")
    hits = retrieval.search(queries, chunks, k, mode, pad).select("corpus", F.col("query_id").alias("req_id"), "rank", "chunk_id")
    cite = extract.with_optional(company).select(F.col("case_id").cast("string").alias("corpus"), "case_id", "chunk_id", "text", "page", "clause", "filename")
    # of derived text Spark knows no size; it would collect all chunks on the driver to broadcast them
    return hits.join(cite.hint("merge"), ["corpus", "chunk_id"]).select("case_id", "req_id", "rank", "chunk_id", "text", "page", "clause", "filename")


#: What the chunks that speak of risks and dates are searched by, and chunks of a case up to which all are read.
RISK_QUERIES = ("penalty liquidated damages earnest money forfeiture", "pre-bid meeting bid submission opening date")
SCAN_ALL, RISK_HITS = 80, 10


def fixed_hits(chunks: DataFrame, texts: tuple[str, ...], k: int) -> DataFrame:
    """(case_id, query_id, chunk_id, rank) of the same numbered queries in every case of chunks."""
    listed = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(t).alias("text")) for i, t in enumerate(texts)])
    corpora = chunks.select(F.col("case_id").cast("string").alias("corpus"), "chunk_id", "pos", "text")
    queries = corpora.select("corpus").distinct().select("corpus", F.explode(listed).alias("q")).select("corpus", "q.*")
    hits = retrieval.search(materialise(queries, "queries"), corpora, k, "hybrid_rerank", True)
    return hits.select(F.col("corpus").cast(chunks.schema["case_id"].dataType).alias("case_id"), "query_id", "chunk_id", "rank")


def risk_window(tender: DataFrame, scan_all: int = SCAN_ALL, k: int = RISK_HITS) -> DataFrame:
    """EXT6 in the job: the chunks that risks and deadlines are read from, in a case of up to scan_all chunks all of them, else
    those that the risk queries find or whose heading names the matter."""
    size = tender.groupBy("case_id").agg(F.count("*").alias("__size"))
    large = materialise(tender.join(size.where(F.col("__size") > scan_all), "case_id", "left_semi"), "large-cases")
    chosen = extract.candidate_chunks(fixed_hits(large, RISK_QUERIES, k), large).select("case_id", "chunk_id")
    small = tender.join(size.where(F.col("__size") <= scan_all), "case_id", "left_semi")
    return small.unionByName(large.join(chosen, ["case_id", "chunk_id"], "left_semi").select(*tender.columns))


def sampled_menu(tender: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """EXT8's span menu of each case, of all its chunks or of EXT7's section sample in its order."""
    if hits is None:
        return extract.span_menu(tender)
    sample = extract.section_sample(hits, tender)
    return extract.span_menu(tender.join(sample, ["case_id", "chunk_id"]).withColumn("pos", F.col("ord").cast("long")).drop("ord"))


def review(
    cases: DataFrame, tender: DataFrame, company: DataFrame, policy: str = "v1", mode: str = "hybrid_rerank", scan_all: int | None = None
) -> dict[str, DataFrame]:
    """requirements, matrix, risks, deadlines, letter, failures, go_no_go, counts and letters of every case(case_id, title).

    What is read several times below, risks, deadlines and failures too, is written once to the shared folder. With
    scan_all, risks and deadlines of larger cases come from their risk_window().
    """
    req = materialise(extract.requirements(tender, policy).withColumn("req_id", F.col("ord")), "requirements", plain=True)
    hits = materialise(evidence_hits(req, company, mode=mode), "hits", plain=True)
    matrix = materialise(decide.matrix(req, hits, extract.estimated_cost(tender)), "matrix", plain=True)
    window = tender if scan_all is None else materialise(risk_window(tender, scan_all), "window")
    risks, dates = materialise(extract.risks(window), "risks"), materialise(extract.deadlines(window), "deadlines")
    letter = verify.letter_queries(matrix, dates)
    both = tender.select("case_id", "chunk_id", "text").unionByName(company.select("case_id", "chunk_id", "text"))
    claims = verify.claims(req, matrix, risks, dates, letter)
    failures = materialise(verify.unsupported(claims, both), "failures", plain=True)
    clean = verify.strip_unsupported(req, matrix, risks, dates, failures)
    return clean | {
        "claims": claims, "failures": failures, "go_no_go": decide.go_no_go(cases, clean["matrix"]), "counts": decide.decision_counts(clean["matrix"]), "letters": verify.letters(cases, clean["letter"]),
    }


def latest_run(runs: DataFrame, case: str = "case_id", started: str = "started_at", run: str = "run_id") -> DataFrame:
    """QRY1: the last run of each case; of equal times the larger id."""
    order = Window.partitionBy(case).orderBy(F.col(started).desc(), F.col(run).desc())
    return runs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def recent_cases(cases: DataFrame, created: str = "created_at", tie: str = "case_id", n: int = 20) -> DataFrame:
    """QRY2."""
    return cases.orderBy(F.col(created).desc(), F.col(tie).desc()).limit(n)


def case_view(cases: DataFrame, runs: DataFrame, notes: DataFrame) -> DataFrame:
    """QRY3: each case with its latest run and the notifications of that run, in order. notes: run_id, created_at, channel, status."""
    per_run = notes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "channel", "status"))).alias("notifications"))
    return cases.join(latest_run(runs), "case_id", "left").join(per_run, "run_id", "left")
