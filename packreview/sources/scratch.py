"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, one machine makes a folder of its own; a cluster needs the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package where they see this folder; elsewhere use --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def _in_place_of(spark: SparkSession, name: str, default: str, value: str) -> None:
    if spark.conf.get(name) == default:
        spark.conf.set(name, value)


def small_batches(spark: SparkSession) -> None:
    """Texts and their lines may be many, so Python takes 512 rows at a time where the session has Spark's default, and 8 MB of
    long texts."""
    _in_place_of(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512")
    _in_place_of(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")


def bounded_joins(spark: SparkSession) -> None:
    """A sorted join holds all rows of a key of its second side on the heap by Spark's default, outside of the memory that Spark
    manages; beyond 4096 rows they go into that, which spills."""
    _in_place_of(spark, "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", "2147483632", "4096")


#: Bytes of a table whose few files may be a row group each, which one task reads whatever the number of cores.
FEW_GROUPS = 32 << 20


def dealt_out(df: DataFrame) -> DataFrame:
    """A table of at most FEW_GROUPS bytes in fewer files than there are cores is dealt out to all of them; any other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= FEW_GROUPS
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to four tasks a core, for work that is long for its bytes: Spark joins small parts to few tasks otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Within it Spark keeps the beginning of a plan's description alone; the driver holds one for each of many queries."""
    name, before = "spark.sql.maxPlanStringLength", spark.conf.get("spark.sql.maxPlanStringLength", None)
    spark.conf.set(name, "20000")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def materialise(df: DataFrame, name: str, codec: str = "zstd", plain: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    plain: neither compressed nor by dictionary, so that the file's size is that of its rows. Rows that are much alike shrink
    to a hundredth otherwise, and Spark, which goes by the file, would take a million of them as few enough to broadcast.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with short_plans(spark):
        df.write.option("compression", "none" if plain else codec).option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialise(), in as many buckets by `key` as there are shuffle partitions: groups by key need no shuffle of it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    own, n = path.rsplit("/", 1)[1].replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with short_plans(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # the name alone; the files are not the catalog's
    return out
