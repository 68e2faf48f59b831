"""Secret scans by an incremental blob ledger; DataFrame functions only.

A blob is a version's whole text under its SHA-256. The ledger holds, for each blob, the rule versions it has been
scanned with and what each found. A scan takes the blobs that lack some current rule version, once however many paths
and versions hold them, runs only those rules, and returns the rows to append to the ledger; findings are joined back
to every path by blob. A new rule or a raised version makes every blob unseen for that rule alone.

Positions: a text split at a rule's matches and the matches themselves, whose lengths add up to each match's start in
code points. The costly expressions run only where the rule's pattern occurs.

Edge cases: null text is the empty blob; it, empty and clean texts have no findings; repeated rows and equal texts get
the same findings; a blob that stands in the ledger more than once (two scans at a time, an append that ran again) has each
finding once; null ids pass through; an empty table gives an empty ledger; other columns are not looked at.
A text with very many findings costs in proportion to them; masking it, its length for each of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.llm.common import fresh_path, materialise, table


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose group `group` is shorter than `least` are dropped."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the order that ties of position take. hex and access state their least length in the pattern: their
#: alternatives are whole runs of one class, so the matches are the same and a text has far fewer of them.
RULES = (
    Rule("assign", 1, _ASSIGN, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,end:int>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Steps of a fold whose results are held apart, as an array that grows is copied at each step.
FOLD = 256


def folded(items: Column, begin: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Folds items with a state `at` and returns what the steps append: step(at, item) -> (next at, array to append)."""

    def inner(acc: Column, x: Column) -> Column:
        at, more = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["found"], more).alias("found"))

    def outer(acc: Column, i: Column) -> Column:
        got = F.aggregate(F.slice(items, i, FOLD), F.struct(acc["at"].alias("at"), none.alias("found")), inner)
        # a one-element array names the inner fold, so that it is evaluated once
        return F.transform(
            F.array(got), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["parts"], F.array(g["found"])).alias("parts"))
        )[0]

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        starts, F.struct(begin.alias("at"), F.slice(F.array(none), 1, 0).alias("parts")), outer, lambda acc: F.flatten(acc["parts"])
    )


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the rule's findings in text, in code points."""
    none = F.array().cast(f"array<{SPAN}>")
    cut = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("hit"),
    )
    # lengths alone go into the fold, which would otherwise carry the text along
    cut = F.transform(cut, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
        (F.length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) >= rule.least if rule.least else F.lit(True)).alias("ok"),
    ))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.coalesce(end, start), F.when(x["hit"].isNotNull() & x["ok"], F.array(span)).otherwise(none)

    return F.when(text.rlike(rule.pattern), folded(cut, F.lit(0), none, step)).otherwise(none)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, findings array<struct<rule,version,spans>>) of the blob and rule-version pairs not in `ledger`.

    versions(text, ...): any paths and historical versions. Append the result to the ledger. What the ledger lacks is
    found by hashes alone; only the texts of blobs that lack some rule version move, one copy of each.
    """
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    current = F.array(*[F.lit(f"{r.name}@{r.version}") for r in rules])
    if ledger is None:
        blobs = blobs.dropDuplicates(["blob"]).withColumn("todo", current)
    else:
        seen = ledger.select("blob", F.explode("findings").alias("f")).groupBy("blob").agg(
            F.collect_set(F.concat_ws("@", "f.rule", "f.version")).alias("seen")  # at most the rules there have been
        )
        none = F.array().cast("array<string>")
        lacks = blobs.select("blob").distinct().join(seen, "blob", "left")
        lacks = lacks.select("blob", F.array_except(current, F.coalesce("seen", none)).alias("todo")).where(F.size("todo") > 0)
        # written, so that Spark knows its size: few unseen blobs are broadcast and no other text moves
        blobs = blobs.join(materialise(lacks, "unseen"), "blob").dropDuplicates(["blob"])
    per_rule = [
        F.when(
            F.array_contains("todo", f"{r.name}@{r.version}"),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")),
        )
        for r in rules
    ]
    return blobs.select("blob", F.filter(F.array(*per_rule), lambda f: f.isNotNull()).alias("findings"))


LEDGER = "blob string, findings array<struct<rule:string,version:int,spans:array<struct<start:int,end:int>>>>"


class Ledger:
    """The stored ledger: a Parquet table under `path`, in any store that Spark reaches, to which scans append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """All rows so far, None before the first scan."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what the ledger lacks of versions(text, ...), appends it and returns the whole ledger."""
        scan_unseen(versions, self.rows(), rules).write.mode("append").parquet(self.path)
        return self.rows()


def findings_by_path(versions: DataFrame, ledger: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns `keep` of every row of versions with findings array<struct<start,ord,end,kind>> in order of start, then rule."""
    current = ledger.select("blob", F.explode("findings").alias("f"))
    names = [r.name for r in rules]
    ok = F.concat_ws("@", "f.rule", "f.version").isin([f"{r.name}@{r.version}" for r in rules])
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("f.rule")).cast("int")
    spans = current.where(ok & (F.size("f.spans") > 0)).select("blob", order.alias("ord"), F.col("f.rule").alias("kind"), F.explode("f.spans").alias("s"))
    by_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "ord", "s.end", "kind"))).alias("found"))
    rows = versions.select(*keep, blob_id(F.col("text")).alias("__blob"))
    out = rows.join(by_blob.withColumnRenamed("blob", "__blob"), "__blob", "left")
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    return out.select(*keep, F.coalesce("found", empty).alias("findings"))


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come twice, as in two crawls: the second scan finds every blob in the stored ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    ledger.scan(docs)
    found = findings_by_path(docs, ledger.scan(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("findings", lambda f: f["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def masked(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """text with each finding, or run of overlapping findings, replaced by `mark`."""
    none = F.array().cast("array<string>")

    def step(at: Column, f: Column) -> tuple[Column, Column]:
        gap = F.substring(text, at + 1, f["start"] - at)
        return F.greatest(f["end"], at), F.when(f["start"] >= at, F.array(gap, F.lit(mark))).otherwise(none)

    last = F.aggregate(findings, F.lit(0), lambda at, f: F.greatest(at, f["end"]))
    rest = F.substring(text, last + 1, F.length(text))
    return F.when(F.size(findings) > 0, F.concat(F.array_join(folded(findings, F.lit(0), none, step), ""), rest)).otherwise(text)
