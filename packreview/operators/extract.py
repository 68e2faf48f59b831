"""Requirements, risks and deadlines out of chunks. chunks: case_id, chunk_id, pos, page, clause, section, filename, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.functions import text as T
from packreview.operators.contain import pairs_to_compare
from packreview.sources.scratch import materialise

PLAN_QUERIES = (
    "eligibility criteria qualification turnover similar work experience",
    "earnest money deposit EMD bid security",
    "GST PAN registration documents to be submitted undertaking",
    "solvency net worth financial capacity audited turnover",
    "liquidated damages penalty forfeiture risk",
    "pre-bid meeting bid submission deadline opening date",
    "PSARA ISO licence manpower blacklisted local supplier",
)
MAX_RISKS, MAX_DEADLINES = 24, 16
_OPTIONAL = ("clause", "section", "filename", "page")


def with_optional(chunks: DataFrame) -> DataFrame:
    """Adds the citation columns that a chunk table lacks, as nulls."""
    for c in _OPTIONAL:
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("int" if c == "page" else "string"))
    return chunks


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """One row a sentence: the chunk's citation, sidx, quote, and the sentence's or the chunk's clause. No shuffle."""
    c = with_optional(chunks)
    s = c.select("case_id", "chunk_id", "pos", "page", F.col("clause").alias("__clause"), "section", "filename", F.posexplode(T.sentences(F.col("text"))).alias("sidx", "quote"))
    return s.withColumn("clause", F.coalesce(T.clause_number(F.col("quote")), "__clause")).drop("__clause").withColumn("lowered", F.lower("quote"))


def _first_of_key(rows: DataFrame) -> DataFrame:
    """First row of each sentence in a case, by chunk and sentence order; copies that differ in case or spaces are one."""
    keyed = rows.withColumn("__key", F.substring(T.whitespace_norm(F.col("lowered")), 1, 220))
    first = Window.partitionBy("case_id", "__key").orderBy("pos", "sidx")
    return keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__key")


def requirements(chunks: DataFrame, policy: str = "v1") -> DataFrame:
    """EXT1: case_id, ord (1-based, by cue hits, page, text), kind, text, quote and citation of each requirement."""
    s = chunk_sentences(chunks).where(F.length("quote") >= 40)
    if policy == "v2":
        s = s.where(T.has_modal(F.col("quote")))
    s = s.where(T.has_cue(F.col("lowered"), policy)).where(~T.is_pure_deadline(F.col("quote")))
    s = _first_of_key(s).withColumn("text", T.whitespace_norm(F.col("quote")))
    order = Window.partitionBy("case_id").orderBy(T.cue_hits(F.lower("text"), policy).desc(), F.coalesce("page", F.lit(0)), "text", "pos", "sidx")
    return s.select(
        "case_id", F.row_number().over(order).alias("ord"), T.kind(F.col("lowered")).alias("kind"), "text", "quote", "chunk_id", "page", "clause", "section", "filename", "pos",
    )


def _top(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("case_id").orderBy("pos", "sidx")
    return rows.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= n)


def risks(chunks: DataFrame, limit: int = MAX_RISKS) -> DataFrame:
    """EXT2: the first `limit` sentences of a case with a risk cue."""
    s = chunk_sentences(chunks).where(T.contains_any(F.col("lowered"), T.RISK_CUES)).where(~T.is_pure_deadline(F.col("quote")))
    s = _top(_first_of_key(s), limit)
    return s.select("case_id", "ord", "quote", "chunk_id", "page", "clause", "section", "filename", T.risk_severity(F.col("lowered")).alias("severity"))


def deadlines(chunks: DataFrame, limit: int = MAX_DEADLINES) -> DataFrame:
    """EXT3: the first `limit` dated sentences of a case with a deadline cue."""
    s = _top(_first_of_key(chunk_sentences(chunks).where(T.is_deadline(F.col("quote")))), limit)
    return s.select("case_id", "ord", "quote", "chunk_id", "page", "clause", "section", "filename", T.deadline_label(F.col("lowered")).alias("event"))


def dedupe_containment(rows: DataFrame, quote: str = "quote", order: str = "ord") -> DataFrame:
    """EXT4: in order, drops a quote whose key contains or is contained in one kept before.

    Equal keys go first, by window. Which keys contain which is found by words, and those pairs are settled in rounds: a
    quote without an unsettled earlier partner stays, its later partners go, and what only they stood against is free. Of
    equal `order` in a case, which row stays is undefined.
    """
    key = F.substring(T.whitespace_norm(F.lower(F.col(quote))), 1, 240)
    keyed = rows.withColumn("__key", key).where("__key <> ''")
    turn = F.row_number().over(Window.partitionBy("case_id", "__key").orderBy(order))
    once = materialise(keyed.withColumn("__n", turn).where("__n = 1").drop("__n"), "quotes")
    texts = once.select("case_id", F.col(order).alias("whole"), F.col("__key").alias("text"))
    part = once.select("case_id", F.col(order).alias("part"), "__key")
    pairs = pairs_to_compare(part, texts, "part", F.array("__key"), "whole").where("part <> whole")
    pairs = pairs.join(part, ["case_id", "part"]).join(texts, ["case_id", "whole"]).where(F.contains("text", "__key"))
    pairs = pairs.select("case_id", F.greatest("part", "whole").alias("late"), F.least("part", "whole").alias("early"))
    gone = covered(pairs).withColumnRenamed("late", order)
    return once.join(gone, ["case_id", order], "left_anti").select(*rows.columns)


def covered(pairs: DataFrame) -> DataFrame:
    """(case_id, late) of pairs(case_id, late, early) whose row has an early partner that is not itself covered.

    Each round settles every row whose early partners are settled, so there are as many rounds as the longest chain of
    partners that are covered and uncovered in turn; containment is transitive, so it is short.
    """
    gone, left = [], materialise(pairs.distinct(), "pairs")
    while not left.isEmpty():
        stay = left.select("case_id", "early").distinct().join(left.select("case_id", F.col("late").alias("early")), ["case_id", "early"], "left_anti")
        now = materialise(left.join(stay, ["case_id", "early"], "left_semi").select("case_id", "late").distinct(), "covered")
        gone.append(now)
        left = left.join(now, ["case_id", "late"], "left_anti").join(now.withColumnRenamed("late", "early"), ["case_id", "early"], "left_anti")
        left = materialise(left, "pairs")
    return reduce(DataFrame.unionByName, gone) if gone else pairs.select("case_id", "late").where("false")


def estimated_cost(chunks: DataFrame) -> DataFrame:
    """EXT5: (case_id, cost): largest amount in a sentence that names the estimate; whole chunks without sentences count."""
    s = T.sentences(F.col("text"))
    parts = chunks.select("case_id", F.explode(F.when(F.size(s) > 0, s).otherwise(F.array("text"))).alias("part"))
    named = parts.where(T.contains_any(F.lower("part"), ("estimated cost", "estimated value", "tender value", "ecpt")))
    return named.select("case_id", F.explode(T.amounts_in(F.col("part"))).alias("a")).groupBy("case_id").agg(F.max("a").alias("cost"))


def candidate_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """EXT6: distinct chunks in the order first met: hits(case_id, query_id, chunk_id, rank) of numbered queries, then by heading."""
    blob = F.lower(F.concat_ws(" ", F.coalesce("section", F.lit("")), F.substring("text", 1, 120)))
    by_head = with_optional(chunks).where(T.contains_any(blob, ("eligibility", "qualification", "earnest"))).select("case_id", "chunk_id", F.struct(F.lit(1).alias("a"), F.col("pos").cast("long").alias("b"), F.lit(0).alias("c")).alias("o"))
    by_hit = hits.select("case_id", "chunk_id", F.struct(F.lit(0).alias("a"), F.col("query_id").cast("long").alias("b"), F.col("rank").cast("int").alias("c")).alias("o"))
    first = by_hit.unionByName(by_head).groupBy("case_id", "chunk_id").agg(F.min("o").alias("o"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("case_id").orderBy("o", "chunk_id"))).drop("o")


def section_sample(hits: DataFrame, chunks: DataFrame, limit: int = 24, seeds: int = 8, per_section: int = 3) -> DataFrame:
    """EXT7: up to `seeds` chunks of the first six queries' top three, then at most three chunks of each section by score."""
    met = hits.where("query_id < 6 and rank <= 3").groupBy("case_id", "chunk_id").agg(F.min(F.struct("query_id", "rank")).alias("o"))
    seed = met.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("o"))).where(F.col("n") <= seeds).select("case_id", "chunk_id", "n")
    c = with_optional(chunks).withColumn("key", F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.concat(F.lit("page-"), F.col("page"))))
    c = c.withColumn("duty", F.col("text").rlike(T.OBLIGATION))
    place = Window.partitionBy("case_id", "key").orderBy("pos")
    c = c.withColumn("at", F.row_number().over(place))
    head = F.concat_ws(" ", "key", F.substring("text", 1, 240))
    hint = F.size(F.regexp_extract_all(head, F.lit(T.SECTION_HINT), F.lit(0)))
    score = c.where("at <= 3").groupBy("case_id", "key").agg(
        (F.max(F.when(F.col("at") == 1, hint)) + F.max(F.col("duty").cast("int"))).alias("score"), F.min("pos").alias("first"),
    )
    rest = c.join(score, ["case_id", "key"]).join(seed.select("case_id", "chunk_id"), ["case_id", "chunk_id"], "left_anti").where("score > 0 and (duty or score >= 2)")
    rest = rest.withColumn("at", F.row_number().over(place)).where(F.col("at") <= per_section)
    both = seed.select("case_id", "chunk_id", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.col("n").cast("long").alias("d")).alias("o")).unionByName(
        rest.select("case_id", "chunk_id", F.struct(F.lit(1).alias("a"), (-F.col("score")).alias("b"), F.col("first").cast("long").alias("c"), F.col("pos").cast("long").alias("d")).alias("o"))
    )
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("case_id").orderBy("o"))).where(F.col("ord") <= limit).drop("o")


def span_menu(chunks: DataFrame, prefix: str = "S", per_chunk: int = 4, limit: int = 24, drop_banners: bool = False, batch: str = "case_id") -> DataFrame:
    """EXT8: numbered spans of a batch: a chunk's obligation sentences, else all of them, 40 characters or more."""
    s = T.sentences(F.col("text"))
    duty = F.filter(s, lambda x: x.rlike(T.OBLIGATION))
    rows = with_optional(chunks).select(batch, "chunk_id", "pos", "page", F.posexplode(F.when(F.size(duty) > 0, duty).otherwise(s)).alias("sidx", "text"))
    rows = rows.where(F.length("text") >= 40)
    if drop_banners:
        rows = rows.where(~T.is_banner(F.col("text")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(batch, "chunk_id").orderBy("sidx"))).where(F.col("n") <= per_chunk)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(batch).orderBy("pos", "sidx"))).where(F.col("n") <= limit)
    return rows.select(batch, F.concat(F.lit(prefix), F.col("n")).alias("span_id"), "n", "chunk_id", "page", "text")


def chunk_of_quote(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """EXT9: claims(case_id, claim_id, quote, chunk_id) -> found_chunk: the cited chunk if it supports the quote, else the
    first that does.

    The cited chunk is an equi-join; of the others a miss meets those that share its quote's rarest word.
    """
    source = chunks.select("case_id", F.col("chunk_id").alias("found_chunk"), F.col("text").alias("source"), "pos")
    supports = T.quote_supported(F.col("quote"), F.col("source"))
    same = (claims.case_id == source.case_id) & (claims.chunk_id == source.found_chunk)
    cited = claims.join(source, same, "left").select(claims["*"], "found_chunk", supports.alias("ok"))
    hit = cited.where("ok").drop("ok")
    miss = cited.where("not ok").drop("ok", "found_chunk")
    # equal quotes are looked for once, among the first of equal texts
    quotes = miss.where(F.length(T.whitespace_norm(F.col("quote"))) >= 20).groupBy("case_id", "quote").agg(F.min("claim_id").alias("claim_id"))
    quotes = materialise(quotes, "quotes", plain=True)
    first = source.groupBy("case_id", "source").agg(F.min(F.struct("pos", "found_chunk")).alias("o"))
    first = materialise(first.select("case_id", "source", "o.pos", "o.found_chunk"), "texts", plain=True)
    texts = first.select("case_id", "found_chunk", F.col("source").alias("text"))
    some = pairs_to_compare(quotes, texts, "claim_id", F.array("quote"), "found_chunk")
    some = some.join(quotes, ["case_id", "claim_id"]).join(first, ["case_id", "found_chunk"]).where(supports)
    other = some.groupBy("case_id", "quote").agg(F.min_by("found_chunk", F.struct("pos", "found_chunk")).alias("found_chunk"))
    return hit.unionByName(miss.join(other, ["case_id", "quote"], "left").select(*hit.columns))
