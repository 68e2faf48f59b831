"""Two-pass external shuffle into shards.

Pass one scatters records by a seeded hash of the id and the text into buckets that fit memory; pass two puts a bucket's records in
a Fisher-Yates order (seeded by shard and bucket) and writes them. A shard is the concatenation of its buckets, so each
record's slot is its place in the bucket after the buckets before it.

Law `key`: the shard is the one with the highest seeded hash of (id, shard), which depends on the id and the number of
shards alone; with one more shard a record either stays or goes to the new one.

Edge cases: null text is 0 bytes (size 1, checksum of nothing); null ids hash like any value; ties in hash are broken by
the smaller shard; repeated rows each have a slot of their own, in one bucket, or where they would fill a quarter of one, in
all buckets of their shard by their place in the input (so the slots of those shards depend on its layout); an empty table
has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packreview.llm.common import fresh_path, materialise, reach_workers, table

#: Bytes of a bucket, which one task shuffles in memory at a time, and how many buckets a task of the shuffle takes.
SHARDS, SEED, BUCKET_BYTES, PER_TASK = 8, 17, 16 << 20, 4


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Highest random weight: int shard of each key."""
    k = key.cast("string")
    draws = [F.struct(F.xxhash64(k, F.lit(seed), F.lit(i)).alias("h"), F.lit(-i).alias("i")) for i in range(shards)]
    return (-(F.greatest(*draws)["i"] if shards > 1 else F.lit(0))).cast("int")


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_to_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes docs(doc_id, text) as Parquet under path with shard, bucket, place; returns what is written."""
    spark = docs.sparkSession
    reach_workers(spark)
    rows = docs.select("doc_id", "text", shard_of(F.col("doc_id"), shards, seed).alias("shard"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed + 1)).alias("__h"))
    held = rows.select("shard", "__h", record_bytes(F.col("text")).alias("size"))
    # each shard has as many buckets as its own bytes need: ids may fill one shard more than others
    sizes = {r.shard: r.size for r in held.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
    buckets = [max(1, -(-sizes.get(i, 0) // bucket_bytes)) for i in range(shards)]
    # equal rows hash alike; where they fill a quarter of a bucket together, their place in the input spreads them.
    # They are written, so that Spark knows their size: few are broadcast, many are joined by key.
    equal = held.groupBy("__h").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where(F.col("n") > 1).where(F.col("size") > bucket_bytes // 4)
    equal = materialise(equal.select("__h", F.lit(True).alias("__many")), "heavy-rows")
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).join(equal, "__h", "left")
    salt = F.when(F.col("__many"), F.col("__at")).otherwise(F.lit(-1))
    many = F.element_at(F.array(*map(F.lit, buckets)), F.col("shard") + 1)
    rows = rows.select("doc_id", "text", "shard", F.pmod(F.xxhash64("__h", salt), many).cast("int").alias("bucket"))
    n = sum(buckets)

    def permute(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # tasks that run again agree
        order = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()]).permutation(group.num_rows)
        place = pa.array(np.arange(group.num_rows), pa.int64())
        return group.take(pa.array(order)).append_column("place", place)

    tasks = max(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // PER_TASK))
    grouped = rows.repartition(tasks, "shard", "bucket").groupBy("shard", "bucket")
    out = grouped.applyInArrow(permute, rows.withColumn("place", F.lit(0).cast("long")).schema)
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def with_slots(rows: DataFrame, written: DataFrame) -> DataFrame:
    """Adds slot to rows(shard, bucket, place, ...) of written; rows that leave the text out shuffle none of it."""
    sizes = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row a bucket
    return rows.join(sizes.select("shard", "bucket", "before"), ["shard", "bucket"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = shuffle_to_shards(docs, fresh_path(spark, "shards"))
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    digest = written.select("doc_id", record_bytes(F.col("text")).alias("size"), crc.alias("text_crc32"), "shard", "bucket", "place")
    return with_slots(digest, written).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard")
    )
