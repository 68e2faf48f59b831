"""Decisions: each requirement against its ranked evidence hits, and what follows for the case.

requirements: case_id, req_id, text, ... hits: case_id, req_id, rank, chunk_id, text, page, clause, filename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packreview.functions import text as T
from packreview.sources.scratch import spread

# What speaks for the bidder and against it where a rule asks for a fact that may be denied; then for each
# rule its markers, in the order that rules are tried.
IN_FAVOUR = {
    "loss": ("not incurred a loss", "has not incurred", "no loss"),
    "blacklist": ("never been blacklisted", "not been blacklisted", "has not been blacklisted"),
}
AGAINST = {
    "loss": ("incurred a loss", "incurred loss"),
    "blacklist": ("has been blacklisted", "was blacklisted"),
}
MARKERS = {
    "turnover": ("turnover",),
    "solvency": ("solvency",),
    "net worth": ("net worth",),
    "similar": ("work", "completion", "order"),
    "loss": IN_FAVOUR["loss"] + AGAINST["loss"],
    "psara": ("psara", "private security agencies regulation"),
    "gst": ("gstin", "gst registration", "goods and services tax"),
    "pan": ("permanent account", "pan card", "pan:"),
    "blacklist": IN_FAVOUR["blacklist"] + AGAINST["blacklist"],
    "manpower": ("manpower", "on roll", "security guards", "personnel"),
    "iso": ("iso 9001", "iso9001", "iso certificate"),
    "class-i": ("class-i local", "class-i", "class i local supplier"),
    "emd": ("demand draft", "earnest money deposit", "emd", "bid security"),
}
LABELS = {
    "psara": "PSARA licence", "gst": "GST registration", "pan": "PAN", "iso": "ISO certificate",
    "class-i": "Class-I local supplier declaration", "loss": "loss history", "blacklist": "blacklisting declaration",
}
INSTRUMENTS = ("demand draft", "bank guarantee", "payment", "remitted", "transferred")
MONEY = ("turnover", "solvency", "net worth")
RANK = {"not_met": 3, "missing": 2, "unclear": 1, "met": 0}


def rule_of(text: Column) -> Column:
    """DEC2: the first rule that the requirement names; null when none does."""
    low = F.lower(text)
    has = lambda *w: T.contains_any(low, w)
    return (
        F.when(has("turnover"), "turnover").when(has("solvency"), "solvency").when(has("net worth"), "net worth").when(low.rlike(T.SIMILAR_WORK), "similar")
        .when(has("loss") & has("year"), "loss").when(has("psara", "private security agencies"), "psara").when(T.word(low, "gst"), "gst")
        .when(T.word(low, "pan") | has("permanent account"), "pan").when(has("blacklist"), "blacklist").when(has("manpower", "on roll", "security guards"), "manpower")
        .when(T.word(low, "iso"), "iso").when(has("local supplier", "make in india", "class-i", "class i"), "class-i")
        .when(has("earnest", "bid security") | T.word(low, "emd"), "emd")
    )


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), key)


def markers_of(rule: Column, markers: dict[str, tuple[str, ...]] = MARKERS) -> Column:
    return _lookup({k: F.array(*map(F.lit, v)) for k, v in markers.items()}, rule)


def sentence_with(text: Column, markers: Column) -> Column:
    """The first sentence with a marker, else the whole text if it has one and 900 characters at most, else null."""
    has = lambda s: T.let(F.lower(s), lambda low: F.exists(markers, lambda m: F.contains(low, m)))
    whole = T.strip(text)
    found = F.coalesce(F.get(F.filter(T.sentences(text), has), F.lit(0)), F.when((F.length(whole) <= 900) & has(whole), whole))
    return F.when(has(text), found)  # most hits hold no marker and need not be cut


def _evidence(requirements: DataFrame, hits: DataFrame) -> DataFrame:
    """DEC1 and DEC4's works, one aggregation by requirement: best (struct) and works (at most the hits of one query)."""
    r = requirements.select("case_id", "req_id", F.col("text").alias("need"), "rule", markers_of(F.col("rule")).alias("markers")).where("rule is not null")
    h = spread(r.join(hits, ["case_id", "req_id"]), "case_id", "req_id").withColumn("quote", sentence_with(F.col("text"), F.col("markers")))
    says = F.col("quote").isNotNull()  # no filter, which Spark would put before the rows are spread
    amount = T.let(T.amounts_in(F.col("quote")), lambda a: F.array_max(F.when(F.size(a) > 0, a).otherwise(T.amounts_in(F.col("text")))))
    h = h.withColumn("amount", F.when(F.col("rule").isin(*MONEY, "similar"), amount))  # no other rule asks for it
    amount = F.col("amount")
    cite = F.struct(F.col("rank").cast("int").alias("rank"), "quote", "amount", "chunk_id", "filename", "page", "clause", F.col("text").alias("whole"))
    work = says & (F.col("rule") == "similar") & amount.isNotNull() & T.domain_ok(F.col("need"), F.col("quote"))
    return h.groupBy("case_id", "req_id").agg(F.min_by(cite, F.when(says, F.col("rank"))).alias("best"), F.array_sort(F.collect_list(F.when(work, cite))).alias("works"))


def _grouped(x: Column) -> Column:
    return F.format_number(x, 0)


def matrix(requirements: DataFrame, hits: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """DEC3 to DEC9: one row for each requirement with decision, obligation, rationale and evidence_* columns.

    A requirement without hits keeps its row. cost(case_id, cost) is EXT5's estimate.
    """
    r = requirements.withColumn("rule", rule_of(F.col("text")))
    r = r.join(cost.select("case_id", "cost"), "case_id", "left") if cost is not None else r.withColumn("cost", F.lit(None).cast("bigint"))
    r = r.join(_evidence(r, hits), ["case_id", "req_id"], "left")
    rule, best, text = F.col("rule"), F.col("best"), F.col("text")
    quote = best["quote"]
    low_quote = F.lower(quote)
    # money: percent without a cost is settled before evidence is looked at, then no threshold, then missing, then compare
    # each pattern runs on the rows of its own rule alone
    money_rule, crew = rule.isin(*MONEY), rule == "manpower"
    r = r.withColumns({
        "__near": F.when(money_rule, T.threshold_near(text, rule)), "__percent": F.when(money_rule, T.percent_near(text, rule)),
        "__alts": F.when(rule == "similar", T.alternatives(text)), "__asked": F.when(crew, T.headcount(text)),
        "__seen": F.when(crew, F.coalesce(T.headcount(quote), T.headcount(best["whole"]))),
    })
    near, percent = F.col("__near"), F.col("__percent")
    by_cost = (F.col("cost") * percent / 100).cast("bigint")
    unpriced = near.isNull() & percent.isNotNull() & (F.coalesce("cost", F.lit(0)) == 0)
    need = F.coalesce(near, F.when(F.coalesce("cost", F.lit(0)) != 0, by_cost))
    title = F.initcap(rule)
    money = (
        F.when(unpriced, F.struct(F.lit("unclear").alias("d"), F.concat(title, F.lit(" is a percentage of estimated cost, and no estimated cost was read from the tender.")).alias("r"), F.lit(False).alias("c")))
        .when(need.isNull(), F.struct(F.lit("unclear").alias("d"), F.concat(F.lit("A "), rule, F.lit(" clause was found but no rupee threshold was parsed.")).alias("r"), quote.isNotNull().alias("c")))
        .when(quote.isNull(), F.struct(F.lit("missing").alias("d"), F.concat(F.lit("No uploaded document states "), rule, F.lit(".")).alias("r"), F.lit(False).alias("c")))
        .when(best["amount"].isNull(), F.struct(F.lit("unclear").alias("d"), F.concat(title, F.lit(" evidence has no parsed rupee amount.")).alias("r"), F.lit(True).alias("c")))
        .when(best["amount"] >= need, F.struct(F.lit("met").alias("d"), F.concat(F.lit("Cited "), rule, F.lit(" of Rs. "), _grouped(best["amount"]), F.lit(" meets the threshold of Rs. "), _grouped(need), F.lit(".")).alias("r"), F.lit(True).alias("c")))
        .otherwise(F.struct(F.lit("not_met").alias("d"), F.concat(F.lit("Cited "), rule, F.lit(" of Rs. "), _grouped(best["amount"]), F.lit(" is below the threshold of Rs. "), _grouped(need), F.lit(".")).alias("r"), F.lit(True).alias("c")))
    )
    alts = F.col("__alts")
    works = F.coalesce("works", F.array().cast("array<struct<rank:int,quote:string,amount:bigint,chunk_id:string,filename:string,page:int,clause:string,whole:string>>"))
    good = lambda a: F.filter(works, lambda w: w["amount"] >= a["amount"])
    chosen = F.get(F.filter(alts, lambda a: F.size(good(a)) >= a["count"]), F.lit(0))
    strongest = F.get(F.filter(works, lambda w: w["amount"] == F.array_max(F.transform(works, lambda x: x["amount"]))), F.lit(0))
    similar = (
        F.when(F.size(alts) == 0, F.struct(F.lit("unclear").alias("d"), F.lit("A similar-work clause was found but the count and amount were not parsed.").alias("r"), F.lit(False).alias("c")))
        .when(F.size(works) == 0, F.struct(F.lit("missing").alias("d"), F.lit("No uploaded work completion or work order matches this similar-work clause.").alias("r"), F.lit(False).alias("c")))
        .when(chosen.isNotNull(), F.struct(F.lit("met").alias("d"), F.concat(F.size(good(chosen)).cast("string"), F.lit(" cited work(s) meet the alternative of "), chosen["count"].cast("string"), F.lit(" work(s) at Rs. "), _grouped(chosen["amount"]), F.lit(".")).alias("r"), F.lit(True).alias("c")))
        .otherwise(F.struct(F.lit("not_met").alias("d"), F.concat(F.lit("The strongest cited similar work is Rs. "), _grouped(strongest["amount"]), F.lit(", which does not meet any stated alternative.")).alias("r"), F.lit(True).alias("c")))
    )
    label = _lookup(LABELS, rule)
    says = lambda part: F.exists(part, lambda m: F.contains(low_quote, m))
    negated = (
        F.when(quote.isNull(), F.struct(F.lit("missing").alias("d"), F.concat(F.lit("No uploaded document speaks to "), label, F.lit(".")).alias("r"), F.lit(False).alias("c")))
        .when(says(markers_of(rule, IN_FAVOUR)), F.struct(F.lit("met").alias("d"), F.concat(F.lit("The cited document supports the "), label, F.lit(" requirement.")).alias("r"), F.lit(True).alias("c")))
        .otherwise(F.struct(F.lit("not_met").alias("d"), F.concat(F.lit("The cited document contradicts the "), label, F.lit(" requirement.")).alias("r"), F.lit(True).alias("c")))
    )
    asked, seen = F.col("__asked"), F.col("__seen")
    manpower = (
        F.when(asked.isNull(), F.struct(F.lit("unclear").alias("d"), F.lit("A manpower clause was found but no headcount was parsed.").alias("r"), quote.isNotNull().alias("c")))
        .when(quote.isNull(), F.struct(F.lit("missing").alias("d"), F.lit("No uploaded document states manpower on roll.").alias("r"), F.lit(False).alias("c")))
        .when(seen.isNull(), F.struct(F.lit("unclear").alias("d"), F.lit("Manpower evidence has no parsed headcount.").alias("r"), F.lit(True).alias("c")))
        .when(seen >= asked, F.struct(F.lit("met").alias("d"), F.concat(F.lit("Cited manpower of "), seen.cast("string"), F.lit(" meets the stated "), asked.cast("string"), F.lit(".")).alias("r"), F.lit(True).alias("c")))
        .otherwise(F.struct(F.lit("not_met").alias("d"), F.concat(F.lit("Cited manpower of "), seen.cast("string"), F.lit(" is below the stated "), asked.cast("string"), F.lit(".")).alias("r"), F.lit(True).alias("c")))
    )
    emd = F.when(
        F.coalesce(T.contains_any(low_quote, INSTRUMENTS), F.lit(False)),
        F.struct(F.lit("met").alias("d"), F.lit("A company document cites an earnest-money instrument.").alias("r"), F.lit(True).alias("c")),
    ).otherwise(F.struct(F.lit("missing").alias("d"), F.lit("No earnest-money instrument was in the uploaded company documents. This is a submission item, not a capacity test.").alias("r"), F.lit(False).alias("c")))
    presence = F.when(quote.isNotNull(), F.struct(F.lit("met").alias("d"), F.concat(F.lit("The uploaded documents include a "), label, F.lit(".")).alias("r"), F.lit(True).alias("c"))).otherwise(
        F.struct(F.when(rule == "class-i", "unclear").otherwise("missing").alias("d"), F.concat(F.lit("No uploaded document shows a "), label, F.lit(".")).alias("r"), F.lit(False).alias("c"))
    )
    none = F.struct(F.lit("unclear").alias("d"), F.lit("The sentence was extracted as a requirement, but no machine-readable check matched it.").alias("r"), F.lit(False).alias("c"))
    out = (
        F.when(rule.isin(*MONEY), money).when(rule == "similar", similar).when(rule.isin("loss", "blacklist"), negated).when(rule == "manpower", manpower)
        .when(rule == "emd", emd).when(rule.isNotNull(), presence).otherwise(none)
    )
    r = r.withColumn("__o", out)
    cited = F.when(rule == "similar", F.coalesce(F.get(good(chosen), F.lit(0)), strongest)).otherwise(best)
    cite = F.when(F.col("__o.c"), cited)
    keep = [c for c in requirements.columns]
    return r.select(
        *keep, F.col("__o.d").alias("decision"), F.when(rule == "emd", "submission").otherwise("qualification").alias("obligation"), F.col("__o.r").alias("rationale"),
        cite["quote"].alias("evidence_quote"), cite["chunk_id"].alias("evidence_chunk_id"), cite["filename"].alias("evidence_filename"), cite["page"].alias("evidence_page"), cite["clause"].alias("evidence_clause"),
    )


def go_no_go(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """DEC10: (case_id, go_no_go) for every case; one without rows is CONDITIONAL."""
    stop = (F.col("decision") == "not_met") | ((F.col("decision") == "missing") & (F.col("obligation") == "qualification"))
    seen = rows.groupBy("case_id").agg(F.bool_or(stop).alias("stop"), F.bool_or(F.col("decision") != "met").alias("open"))
    return cases.select("case_id").join(seen, "case_id", "left").select("case_id", F.when(F.col("stop"), "NO-GO").when(F.coalesce("open", F.lit(True)), "CONDITIONAL").otherwise("GO").alias("go_no_go"))


def decision_counts(rows: DataFrame) -> DataFrame:
    """DEC11: counts of the four decisions and a sentence."""
    n = {d: F.count_if(F.col("decision") == d).alias(d) for d in ("met", "not_met", "missing", "unclear")}
    out = rows.groupBy("case_id").agg(F.count("*").alias("n"), *n.values())
    return out.withColumn("summary", F.format_string("%d requirement(s): %d met, %d not met, %d missing, %d unclear.", "n", "met", "not_met", "missing", "unclear"))


def worst(rows: DataFrame, *by: str) -> DataFrame:
    """DEC12: the worst decision of each group."""
    return rows.groupBy(*by).agg(F.max_by("decision", F.coalesce(_lookup(RANK, F.col("decision")), F.lit(0))).alias("worst"))


def norm_id(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw.cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def merge_model_requirements(items: DataFrame, menu: DataFrame, chunks: DataFrame) -> DataFrame:
    """DEC13: items(case_id, item_id, span_id, quote, chunk_id, kind, text) -> requirements: by span of the menu, else by quote."""
    from packreview.operators.extract import chunk_of_quote, with_optional

    spans = menu.select("case_id", norm_id(F.col("span_id")).alias("sid"), F.col("text").alias("span"), F.col("chunk_id").alias("span_chunk"))
    it = items.withColumn("sid", norm_id(F.col("span_id"))).join(spans, ["case_id", "sid"], "left")
    direct = it.where("span is not null").select("case_id", "item_id", "kind", "text", F.col("span").alias("quote"), F.col("span_chunk").alias("chunk_id"))
    rest = it.where("span is null").select("case_id", F.col("item_id").alias("claim_id"), "kind", "text", F.trim(F.coalesce("quote", F.lit(""))).alias("quote"), "chunk_id")
    found = chunk_of_quote(rest, chunks).where("found_chunk is not null").select("case_id", F.col("claim_id").alias("item_id"), "kind", "text", "quote", F.col("found_chunk").alias("chunk_id"))
    both = direct.unionByName(found)
    norm = T.whitespace_norm(F.col("text"))
    c = with_optional(chunks).select("case_id", "chunk_id", "page", F.col("clause").alias("__c"), "section", "filename")
    return both.join(c, ["case_id", "chunk_id"]).select(
        "case_id", "item_id", F.coalesce("kind", F.lit("eligibility")).alias("kind"), F.when(F.length(norm) < 20, F.col("quote")).otherwise(norm).alias("text"),
        "quote", "chunk_id", "page", F.coalesce(T.clause_number(F.col("quote")), "__c").alias("clause"), "section", "filename",
    )


def merge_model_decisions(rows: DataFrame, replies: DataFrame, menu: DataFrame, fallback: bool = True) -> DataFrame:
    """DEC14: rows(batch_id, n, ...matrix) with replies(batch_id, items array<struct<id,decision,obligation,evidence_span,rationale>>).

    An item is matched by R-number, by number, then by position when the counts agree. menu: batch_id, n, span_id, text, chunk_id, page.
    """
    item = replies.select("batch_id", F.size("items").alias("got"), F.posexplode("items").alias("at", "item"))
    size = rows.groupBy("batch_id").agg(F.count("*").alias("size"))
    ids = item.withColumn("key", norm_id(F.col("item.id")))
    last = ids.groupBy("batch_id", "key").agg(F.max_by("item", "at").alias("item"))  # of equal ids the last counts
    base = rows.join(size, "batch_id").join(replies.select("batch_id", F.coalesce(F.size("items"), F.lit(0)).alias("got")), "batch_id", "left")
    r1 = last.select("batch_id", F.col("key").alias("k1"), F.col("item").alias("by_r"))
    r2 = last.select("batch_id", F.col("key").alias("k2"), F.col("item").alias("by_n"))
    r3 = item.select("batch_id", (F.col("at") + 1).alias("n"), F.col("item").alias("by_pos"))
    j = base.withColumn("k1", F.concat(F.lit("R"), F.col("n"))).withColumn("k2", F.col("n").cast("string"))
    j = j.join(r1, ["batch_id", "k1"], "left").join(r2, ["batch_id", "k2"], "left").join(r3, ["batch_id", "n"], "left")
    j = j.withColumn("item", F.coalesce("by_r", "by_n", F.when(F.col("got") == F.col("size"), F.col("by_pos"))))
    j = j.withColumn("sid", norm_id(F.col("item.evidence_span")))
    null = F.lit(None).cast("string")
    of_menu = [(F.col(c) if c in menu.columns else null).alias(f"span_{c}") for c in ("filename", "clause")]
    spans = menu.select("batch_id", "n", norm_id(F.col("span_id")).alias("sid"), F.col("text").alias("span"), F.col("chunk_id").alias("span_chunk"), F.col("page").alias("span_page"), *of_menu)
    j = j.join(spans, ["batch_id", "n", "sid"], "left")
    said = F.regexp_replace(F.trim(F.lower(F.coalesce("item.decision", F.lit("unclear")))), "[ -]", "_")
    said = F.when(said.isin(*RANK), said).otherwise("unclear")
    lost = F.col("got").isNull()  # a batch without a reply keeps the rules' decision, or nothing
    cited = [c for c in ("evidence_filename", "evidence_clause") if c in rows.columns]
    keep = [c for c in rows.columns if c not in ("decision", "obligation", "rationale", "evidence_quote", "evidence_chunk_id", "evidence_page", *cited)]
    pick = lambda model, rule, none: F.when(~lost, model).otherwise(rule if fallback else none)
    said_of = lambda c: F.nullif(F.col(f"item.{c}"), F.lit(""))
    return j.select(
        *keep, F.col("decision").alias("rule_decision"), pick(said, F.col("decision"), F.lit("unclear")).alias("decision"),
        pick(F.coalesce(said_of("obligation"), "obligation"), F.col("obligation"), F.col("obligation")).alias("obligation"),
        pick(F.coalesce(said_of("rationale"), "rationale"), F.col("rationale"), F.lit("The model call failed. No rule fallback was applied.")).alias("rationale"),
        pick(F.col("span"), F.col("evidence_quote"), null).alias("evidence_quote"), pick(F.col("span_chunk"), F.col("evidence_chunk_id"), null).alias("evidence_chunk_id"),
        pick(F.col("span_page"), F.col("evidence_page"), F.lit(None).cast("int")).alias("evidence_page"),
        *[pick(F.col(c.replace("evidence", "span")), F.col(c), null).alias(c) for c in cited],
    )
