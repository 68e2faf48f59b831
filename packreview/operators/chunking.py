"""Pages to blocks, lines and chunks. pages: document_id, page, text (or blocks ARRAY<STRING>).

Lines are measured by Column functions into a few whole numbers each (functions.text.TRAITS). What a run of joined lines
measures is the sum of its lines, so the two steps that depend on order see numbers alone and answer with numbers: how
many lines each run joins, and from which run to which each chunk goes. The texts are then cut and joined by Columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.functions import text as T
from packreview.operators.extract import PLAN_QUERIES
from packreview.sources.scratch import reach_workers, small_batches

OCR_MIN = 40
#: Characters: a chunk takes no further line beyond TARGET, ends at HARD_MAX, and hands a last line under CARRY on.
TARGET, HARD_MAX, CARRY = 1000, 1800, 300
#: Characters of a section's name.
SECTION = 240


def blocks(text):
    """CHK1: Column: array of blocks between blank lines, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), T.strip), lambda b: b != "")


def page_quality(pages: DataFrame) -> DataFrame:
    """CHK2: n_alnum and needs_ocr of each page. No shuffle."""
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]", ""))
    return pages.withColumn("n_alnum", n).withColumn("needs_ocr", n < OCR_MIN)


def document_quality(pages: DataFrame) -> DataFrame:
    """CHK2: pages and flagged pages of each document."""
    flagged = page_quality(pages).groupBy("document_id")
    return flagged.agg(F.count("*").alias("page_count"), F.count_if("needs_ocr").alias("ocr_page_count"))


def run_lengths(page: np.ndarray, opens: np.ndarray, ends: np.ndarray, traits: np.ndarray) -> list[int]:
    """CHK5: how many lines each run joins; traits int[lines, TRAITS], opens and ends as 0 or 1.

    A line may go on from the one before only on the same page, if it opens nothing, is no heading, and the one before
    does not end a sentence; and a run that has come to measure as a heading takes no more.
    """
    n = len(page)
    title = T.measures_as_heading(*traits.T)
    free = np.zeros(n, bool)
    free[1:] = (page[1:] == page[:-1]) & (opens[1:] == 0) & ~title[1:] & (ends[:-1] == 0)
    begins, total, goes_on = [], None, traits * np.array(T.GOES_ON_TRAITS) + np.array(T.SPACE_TRAITS)
    for i in range(n):
        if free[i] and not T.measures_as_heading(*total):
            total = total + goes_on[i]
        else:
            begins.append(i)
            total = traits[i]
    return np.diff([*begins, n]).tolist()


def chunk_ranges(page: np.ndarray, size: np.ndarray, title: np.ndarray, numbered: np.ndarray) -> list[tuple[int, int, int, int]]:
    """CHK6: (first run, runs, the heading's run or -1, the run that gives the clause or -1) of each chunk.

    Headings and page changes part the runs into stretches, and each stretch is packed by itself. The clause is that of
    the last numbered run up to the one whose arrival closed the chunk.
    """
    n = len(page)
    last = lambda flag: np.maximum.accumulate(np.where(flag, np.arange(n), -1)) if n else np.zeros(0, int)
    heading, number, before = last(title), last(numbered), np.concatenate([[0], np.cumsum(size)])
    edge = np.ones(n, bool)
    edge[1:] = title[1:] | title[:-1] | (page[1:] != page[:-1])
    starts = np.flatnonzero(edge & ~title) if n else []
    stops = np.flatnonzero(np.append(edge[1:], True)) if n else []
    out = []
    for begin in starts:
        stop = int(stops[np.searchsorted(stops, begin)]) + 1
        closing = stop if stop < n and not title[stop] else stop - 1  # a page change is seen when the next line arrives
        at, free = int(begin), 1  # the first `free` runs of a chunk are taken whatever their length
        while at < stop:
            have = before[min(at + free, stop)] - before[at]
            full = int(np.searchsorted(before, before[at] + TARGET, "right")) - 1  # the first run that no longer fits
            if have >= HARD_MAX:
                end, seen = min(at + free, stop), min(at + free, stop) - 1
            elif max(full, at + free) < stop:
                end = seen = max(full, at + free)
            else:
                end, seen = stop, closing
            out.append((at, end - at, int(heading[at]), int(number[seen])))
            carried = end < stop and have < HARD_MAX and size[end - 1] < CARRY
            at, free = (end - 1, 2) if carried else (end, 1)
    return out


def _runs(page: pd.Series, opens: pd.Series, ends: pd.Series, traits: pd.Series) -> pd.Series:
    width = len(T.SPACE_TRAITS)
    flat, out = [np.array(t, np.int64).reshape(-1, width) for t in traits], []
    for x in zip(page, opens, ends, flat, strict=True):
        n = run_lengths(*map(np.asarray, x))
        out.append([{"first": a, "lines": k} for a, k in zip((np.cumsum(n) - n).tolist(), n, strict=True)])
    return pd.Series(out)


def _ranges(runs: pd.Series) -> pd.Series:
    names, out = ("first", "runs", "heading", "number"), []
    for x in runs:
        p, s, t, c = np.array(x, np.int64).reshape(-1, 4).T
        out.append([dict(zip(names, r, strict=True)) for r in chunk_ranges(p, s, t > 0, c > 0)])
    return pd.Series(out)


def lines_of(pages: Column) -> Column:
    """array<struct<page,text>> of an array<struct<page,blocks>>: stripped lines, none empty, in order."""
    split = lambda p: F.flatten(F.transform(p["blocks"], lambda b: F.split(b, T.LINE_BREAK)))
    each = lambda p: F.transform(split(p), lambda x: F.struct(p["page"].alias("page"), T.strip(x).alias("text")))
    return F.filter(F.flatten(F.transform(pages, each)), lambda x: x["text"] != "")


def chunk_documents(pages: DataFrame, keep: tuple[str, ...] = ("case_id", "role", "filename")) -> DataFrame:
    """CHK5/6: one row a chunk with `keep` and pos, the place of (document, chunk) in the corpus as one number.

    pages: document_id, ordinal (of the document in its corpus), page, text, and the columns `keep`. Pages of a document
    are gathered by document_id; where a document is one row already (single-page texts) use chunk_texts, which shuffles
    nothing.
    """
    page = F.struct("page", blocks(F.col("text")).alias("blocks"))
    one = pages.groupBy("document_id", "ordinal", *keep).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return _chunked(one, keep)


def chunk_texts(docs: DataFrame, keep: tuple[str, ...] = ("case_id", "role", "filename")) -> DataFrame:
    """The same for documents of one page: document_id, ordinal, text, and the columns `keep`."""
    page = F.struct(F.lit(1).alias("page"), blocks(F.col("text")).alias("blocks"))
    return _chunked(docs.select("document_id", "ordinal", *keep, F.array(page).alias("pages")), keep)


def _chunked(one: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    reach_workers(one.sparkSession)
    small_batches(one.sparkSession)
    runs = F.pandas_udf(_runs, "array<struct<first:int,lines:int>>")
    ranges = F.pandas_udf(_ranges, "array<struct<first:int,runs:int,heading:int,number:int>>")
    rows = one.select("document_id", "ordinal", *keep, lines_of(F.col("pages")).alias("lines"))
    of = lambda f: F.transform("lines", lambda x: f(x["text"]))
    rows = rows.withColumn("runs", runs(
        F.col("lines.page"), of(lambda t: T.opens_item(t).cast("int")), of(lambda t: t.rlike("[.:;]$").cast("int")),
        F.flatten(of(T.line_traits)),
    ))
    part = lambda r: F.slice("lines", r["first"] + 1, r["lines"])
    run = lambda r: T.let(part(r), lambda x: F.struct(x[0]["page"].alias("page"), F.array_join(x["text"], " ").alias("text")))
    rows = rows.withColumn("lines", F.transform("runs", run))
    flat = T.whitespace_norm
    # a longer run can be a heading only where white space joins up; the number is the same in a run as in its folded text
    title = lambda t: F.when((F.length(t) <= T.HEADING_MAX) | t.rlike(r"(?U)\s\s"), T.let(flat(t), T.is_heading)).otherwise(F.lit(False))
    # one argument, as Spark works the runs out anew for each
    measured = lambda x: F.array(x["page"], F.length(x["text"]), title(x["text"]).cast("int"), T.clause_number(x["text"], True).isNotNull().cast("int"))
    rows = rows.withColumn("cuts", ranges(F.flatten(F.transform("lines", measured))))

    def chunk(c: Column) -> Column:
        """A chunk is cut out while the document is one row, so that no copy of its lines goes along with each chunk."""
        own = F.slice("lines", c["first"] + 1, c["runs"])
        section = F.when(c["heading"] >= 0, F.substring(flat(F.get("lines", c["heading"])["text"]), 1, SECTION))
        number = F.when(c["number"] >= 0, T.clause_number(F.get("lines", c["number"])["text"], True))
        return T.let(own, lambda x: F.struct(
            x[0]["page"].alias("page"), T.strip(F.array_join(x["text"], "\n")).alias("text"), section.alias("section"), number.alias("number"),
        ))

    rows = rows.select("document_id", "ordinal", *keep, F.transform("cuts", chunk).alias("chunks"))
    # outer, as a filter on the number of chunks would be put where no Python function can run
    rows = rows.select("document_id", "ordinal", *keep, F.posexplode_outer("chunks").alias("i", "c")).where("i is not null")
    page, n, text = F.col("c.page"), F.col("i") + 1, F.col("c.text")
    return rows.select(
        *keep, "document_id", F.concat_ws("-", F.col("document_id").cast("string"), n.cast("string")).alias("chunk_id"),
        n.alias("n"), page.alias("page_start"), page.alias("page_end"), F.coalesce(T.clause_number(text), "c.number").alias("clause"),
        F.col("c.section").alias("section"), text.alias("text"), page.alias("page"),
        (F.shiftleft(F.col("ordinal").cast("long"), 31) + n).alias("pos"),  # 2^31 chunks a document, 2^32 documents a corpus
    )


def plan_queries(chunks: DataFrame, sections: int = 8) -> DataFrame:
    """CHK7: (case_id, query_id, text): the fixed queries, then the first distinct sections of the case in order."""
    named = chunks.where(F.trim(F.coalesce("section", F.lit(""))) != "")
    named = named.groupBy("case_id", "section").agg(F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("first", "section"))
    own = named.withColumn("n", place).where(F.col("n") <= sections)
    fixed = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(q).alias("text")) for i, q in enumerate(PLAN_QUERIES)])
    every = chunks.select("case_id").distinct().select("case_id", F.explode(fixed).alias("q")).select("case_id", "q.*")
    own = own.select("case_id", (F.col("n") + len(PLAN_QUERIES) - 1).cast("int").alias("query_id"), F.col("section").alias("text"))
    return every.unionByName(own)
