"""From files to tables, and from model replies to requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.jobs.review import sampled_menu
from packreview.operators import chunking, decide, extract
from packreview.sources import packs
from packreview.sources.scratch import materialise


def ingest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, chunks and rejects of the files under path, which stand in folders case_id=.../role=.../.

    The order of documents within a case and role is that of their names. Pages are written once, as three tables come
    from them.
    """
    pages, rejects = packs.text_documents(spark, path)
    of = lambda key: F.regexp_extract("path", rf"{key}=([^/]+)/", 1)
    pages = pages.withColumns({"case_id": of("case_id").cast("int"), "role": of("role")})
    pages = materialise(pages, "pages")
    names = pages.select("case_id", "role", "document_id", "filename").distinct()
    place = F.row_number().over(Window.partitionBy("case_id", "role").orderBy("filename", "document_id"))
    named = names.select("document_id", place.alias("ordinal"))
    documents = names.join(chunking.document_quality(pages), "document_id")
    chunks = chunking.chunk_documents(pages.join(named, "document_id"))
    return {"documents": documents, "chunks": chunks, "rejects": rejects}


def model_requirements(tender: DataFrame, replies: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Requirements of replies(case_id, reply) to the span menu of each case: parsed (TXT21), merged with the menu or found by
    their quotes (DEC13), and none that holds another or is held by one before it (EXT4).

    The menu is of all chunks, or with hits(case_id, query_id, chunk_id, rank) of the section sample (EXT7).
    """
    menu = materialise(sampled_menu(tender, hits), "menu")
    parsed = packs.model_replies(replies).where("ok")
    items = parsed.select("case_id", F.posexplode("parsed.requirements").alias("item_id", "x"))
    items = items.select("case_id", "item_id", "x.span_id", "x.quote", F.lit(None).cast("string").alias("chunk_id"), "x.kind", "x.text")
    return extract.dedupe_containment(decide.merge_model_requirements(items, menu, tender), "quote", "item_id")
