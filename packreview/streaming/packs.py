"""STR1: text packs processed as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packreview.operators.chunking import chunk_texts
from packreview.operators.extract import requirements


def stream_packs(spark: SparkSession, source: str, target: str, checkpoint: str, policy: str = "v1") -> StreamingQuery:
    """Each new file under source is a pack of one document, named by its content: its requirements go to target.

    A pack that comes again, in one batch or another, under whatever path, is dropped by a state store keyed by its name;
    the store has 64 characters a pack, and with many of them belongs in RocksDB (a setting of the session). A batch is
    written as a partition of its own that replaces what an earlier try of it left, so that after a restart the rows of
    each pack stand in target once.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(source)
    packs = files.select(F.sha2("value", 256).alias("pack_id"), "value").dropDuplicates(["pack_id"])

    def handle(batch: DataFrame, number: int) -> None:
        case = F.col("pack_id")
        docs = batch.select(case.alias("document_id"), F.lit(0).alias("ordinal"), case.alias("case_id"), F.lit("tender").alias("role"), F.concat(case, F.lit(".txt")).alias("filename"), F.col("value").alias("text"))
        requirements(chunk_texts(docs), policy).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return packs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
