"""Shared helpers of the training-data operators: tables, shared scratch tables, held-out split, components."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packreview.sources import scratch
from packreview.sources.scratch import fresh_path, materialise, shared_dir  # noqa: F401

#: Text bytes that a vectorised helper takes at a time; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def reach_workers(spark: SparkSession) -> None:
    """As in sources.scratch, with small batches."""
    scratch.reach_workers(spark)
    scratch.small_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scratch.dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by materialise() that nothing reads any more."""
    base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if base in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)


def is_held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model learns from; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together; a longer text is a range of its own."""
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the system. Workers stay for other tasks, two a core where a stage
    has two Python steps, and count as the executor's; the allocators would keep what the largest task took. glibc alone needs it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_rows(
    df: DataFrame, fn: Callable, schema: str, keep: list[str], text: str = "text", arrow: bool = False, limit: int = SLICE_BYTES
) -> DataFrame:
    """Applies fn to slices of the texts; returns the columns `keep` of df and those of `schema` that fn makes. No shuffle.

    fn takes a list of str or None, or with `arrow` an array of strings, and returns {column: values}.
    """
    from pyspark.sql.types import StructType

    reach_workers(df.sparkSession)
    made = StructType.fromDDL(schema)
    full = StructType([f for k in keep for f in df.select(k).schema.fields] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(full)
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.string())
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for a, b in slices(sizes, limit):
                part = texts.slice(a, b - a)
                out = fn(part if arrow else part.to_pylist())
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                new = [pa.array(out[f.name], type=out_schema.field(f.name).type) for f in made.fields]
                cols = [c.cast(out_schema.field(i).type) for i, c in enumerate(kept)] + new
                yield pa.RecordBatch.from_arrays(cols, schema=out_schema)
        give_back()

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, full)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """fit(rows) of a bounded sample, run in one task; the driver gets the model alone, never the texts."""
    reach_workers(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else fit([])  # Spark runs no task for a sample that it knows to be empty


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Connected components of links(a, b): (id, component), component the smallest id reachable.

    Alternates large-star and small-star until nothing changes, which takes a number of rounds that grows with
    the logarithm of the longest path. Each round is two aggregations over the links, written to the shared
    folder; no vertex's neighbours are gathered, so hubs of any degree are safe. Ids that have no link and the smallest id of each component are absent.
    """
    spark = links.sparkSession
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = materialise(small.where("a <> b").distinct(), "small")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, edges)
        discard(spark, large)
        edges = new
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
