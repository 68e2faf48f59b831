"""Readers and writers: text files, JSON packs, the label manifest, integrity checks, stored tables, reports."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACK = "id string, title string, source_url string, documents array<struct<filename:string, url:string, content_base64:string>>"
MANIFEST = (
    "tenders array<struct<id:string, title:string, portal:string, source_url:string, filename:string, sha256:string, license_note:string, exhaustive:boolean, "
    "requirements:array<struct<id:string, kind:string, match_all:array<string>>>, retrieval_queries:array<struct<id:string, query:string, match_all:array<string>>>, "
    "eligibility:array<struct<requirement_id:string, profile:string, expected:string>>>>"
)
REPLY = "requirements array<struct<span_id:string, quote:string, text:string, kind:string>>, risks array<struct<quote:string, severity:string>>, deadlines array<struct<quote:string, event:string>>, __bad string"


def text_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC1: (documents of one page, rejects with a reason); bad bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./\\]+)$", 1)
    rows = files.select("path", F.regexp_extract("path", r"([^/\\]+)$", 1).alias("filename"), suffix.alias("suffix"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    good = rows.where("suffix = '.txt'").select(F.sha2("path", 256).alias("document_id"), "path", "filename", F.lit(1).alias("page"), F.lit(False).alias("ocr"), "text")
    bad = rows.where("suffix <> '.txt'").select("path", F.concat(F.lit("unsupported file type: "), F.coalesce(F.nullif("suffix", F.lit("")), "filename")).alias("reason"))
    return good, bad


def json_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC2: (pack_id, title, source_url, n, filename, url, content) and rejects (pack_id, n, reason)."""
    packs = spark.read.schema(PACK).option("multiLine", "true").json(path)
    rows = packs.select(
        F.coalesce("id", F.sha2(F.to_json(F.struct("*")), 256)).alias("pack_id"), F.coalesce("title", "id").alias("title"), "source_url", F.posexplode_outer("documents").alias("n", "d")
    )
    content = F.try_to_binary("d.content_base64", F.lit("base64"))
    rows = rows.select("pack_id", "title", "source_url", "n", F.coalesce(F.nullif("d.filename", F.lit("")), F.lit("tender.pdf")).alias("filename"), F.col("d.url").alias("url"), content.alias("content"), F.col("d").isNull().alias("none"))
    reason = F.when(F.col("none"), "the pack has no document").when(F.col("content").isNull() & F.coalesce(F.col("url") == "", F.lit(True)), "the document has neither content nor url")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("none", "reason"), rows.where("reason is not null").select("pack_id", "n", "reason")


def manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC3: tenders, gold_requirements, gold_queries and gold_eligibility, flat."""
    t = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select(F.explode("tenders").alias("t")).select("t.*")
    case = F.col("id").alias("case_id")
    return {
        "tenders": t.select(case, "title", "portal", "source_url", "filename", "sha256", "license_note", F.coalesce("exhaustive", F.lit(False)).alias("exhaustive")),
        "gold_requirements": t.select(case, F.posexplode("requirements").alias("gold_ord", "r")).select("case_id", "gold_ord", F.col("r.id").alias("gold_id"), "r.kind", F.col("r.match_all").alias("phrases")),
        "gold_queries": t.select(case, F.explode("retrieval_queries").alias("q")).select("case_id", F.col("q.id").alias("query_id"), F.col("q.query").alias("text"), F.col("q.match_all").alias("phrases")),
        "gold_eligibility": t.select(case, F.explode("eligibility").alias("e")).select("case_id", F.col("e.requirement_id").alias("gold_id"), "e.profile", "e.expected"),
    }


def integrity(tenders: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC4: tenders(filename, sha256) without a file; those whose content has another digest. files: filename, content."""
    have = files.select("filename", F.sha2("content", 256).alias("actual"))
    return tenders.join(have, "filename", "left_anti"), tenders.where("sha256 <> ''").join(have, "filename").where("lower(sha256) <> actual")


def model_replies(rows: DataFrame, text: str = "reply", schema: str = REPLY) -> DataFrame:
    """TXT21: adds parsed (struct) and ok; broken replies are cut to {...}, else closed after their last whole item.

    Well-formed replies are parsed by from_json; only the others reach the helper.
    """
    opts = {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}

    @F.pandas_udf("string")
    def mended(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t or "{" not in t:
                return None
            t = t[t.index("{") :]
            try:
                value, _ = json.JSONDecoder().raw_decode(t)
                return json.dumps(value)
            except ValueError:
                pass
            stack, inside, skip, cuts = [], False, False, []
            for i, c in enumerate(t):
                if skip:
                    skip = False
                elif inside:
                    skip, inside = c == "\\", c != '"'
                elif c == '"':
                    inside = True
                elif c in "{[":
                    stack.append("}" if c == "{" else "]")
                elif c in "}]" and stack:
                    stack.pop()
                    cuts.append((i + 1, "".join(reversed(stack))))
            for end, closing in reversed(cuts):
                try:
                    return json.dumps(json.loads(t[:end] + closing))
                except ValueError:
                    continue
            return None

        return texts.map(one)

    first = rows.withColumn("__first", F.from_json(F.col(text), schema, opts))
    whole = F.col("__first").isNotNull() & F.col("__first.__bad").isNull() & F.col(text).isNotNull()
    first = first.withColumn("__ok", whole)
    good = first.where("__ok").withColumn("parsed", F.col("__first"))
    rest = first.where("not __ok").withColumn("parsed", F.from_json(mended(F.col(text)), schema, opts))
    return good.unionByName(rest).withColumn("ok", F.col("parsed").isNotNull()).drop("__first", "__ok")


def run_rows(matrix: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """SNK1: requirement and evidence-link rows of a run, with ids that a retried task makes again."""
    rid = F.sha2(F.concat_ws("|", F.lit(run_id), F.col("case_id").cast("string"), F.col("ord").cast("string"), "text"), 256)
    m = matrix.withColumn("requirement_id", rid).withColumn("run_id", F.lit(run_id))
    req = m.select(F.col("requirement_id").alias("id"), "run_id", "case_id", F.coalesce("kind", F.lit("eligibility")).alias("kind"), "text", "clause", "page", "quote", "chunk_id", "filename")
    link = m.select(
        F.sha2(F.concat_ws("|", "requirement_id", F.lit("link")), 256).alias("id"), "requirement_id", "run_id", "case_id", F.coalesce("decision", F.lit("unclear")).alias("decision"),
        F.coalesce("obligation", F.lit("qualification")).alias("obligation"), "rationale", "evidence_quote", "evidence_chunk_id", "evidence_filename", "evidence_page", "evidence_clause",
    )
    return req, link


def save(tables: dict[str, DataFrame], path: str, partition: dict[str, list[str]] | None = None) -> None:
    """Writes whole tables under path in place of what stood there."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        by = (partition or {}).get(name)
        (w.partitionBy(*by) if by else w).parquet(f"{path}/{name}")


def save_cases(tables: dict[str, DataFrame], cases: DataFrame, path: str) -> None:
    """SNK1 for the cases at hand: their rows replace those of earlier runs, and other cases' rows stay as they are.

    Tables are partitioned by case_id and only the partitions at hand are overwritten. Each case at hand gets a row of nulls
    besides its own, so that a case without rows replaces its old ones too; stored() leaves it out. A write that runs again
    leaves the same rows, as their ids are made from what they hold.
    """
    for name, df in tables.items():
        marks = cases.select("case_id").distinct().select("case_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != "case_id"])
        rows = df.select("case_id", *[c for c in df.columns if c != "case_id"]).unionByName(marks)
        rows.repartition("case_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(f"{path}/{name}")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table that save_cases() wrote."""
    return spark.read.parquet(f"{path}/{name}").where("id is not null")


def verification(claims: DataFrame, failures: DataFrame) -> DataFrame:
    """(case_id, verification): for each case how many claims there were, how many were unsupported, and these by stage."""
    n = claims.where("quote <> ''").groupBy("case_id").agg(F.count("*").alias("claims"))
    bad = F.array_sort(F.collect_list(F.struct("stage", "chunk_id", "quote")))
    bad = failures.groupBy("case_id").agg(F.count("*").alias("unsupported"), bad.alias("failures"))
    rows = n.join(bad, "case_id", "left")
    passed = F.coalesce(F.col("unsupported"), F.lit(0)) == 0
    return rows.select(
        "case_id", F.struct(passed.alias("passed"), "claims", F.coalesce("unsupported", F.lit(0)).alias("unsupported"), "failures").alias("verification")
    )


def reports(
    cases: DataFrame, matrix: DataFrame, risks: DataFrame, deadlines: DataFrame, letter: DataFrame, summary: DataFrame,
    verified: DataFrame | None = None,
) -> DataFrame:
    """SNK2: (case_id, report_json): one document a case. summary: columns by case; verified: verification()."""

    def listed(df: DataFrame, name: str, order: str = "ord") -> DataFrame:
        rest = [c for c in df.columns if c not in ("case_id", order)]
        return df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(name))

    out = cases.select("case_id")
    for df, name, order in ((matrix, "matrix", "ord"), (risks, "risks", "ord"), (deadlines, "deadlines", "ord"), (letter, "letter_quotes", "n")):
        out = out.join(listed(df, name, order), "case_id", "left")
    for df in (summary, verified):
        out = out if df is None else out.join(df, "case_id", "left")
    return out.select("case_id", F.to_json(F.struct(*[c for c in out.columns if c != "case_id"])).alias("report_json"))
