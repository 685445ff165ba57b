"""Session settings, lineage cuts and size checks shared by the operators."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast or collected only when a counted check proves it within these bounds.
MAX_BROADCAST_ROWS = 200_000
MAX_COLLECTED_QUERIES = 4096
TEXT_TABLES = ("documents", "pages", "conversations")


def local_session(cores: str = "*", app: str = "corpusflow", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only where all runs in one process (tests).

    Off local mode a missing folder is an error: a temporary one would lie on the driver's machine alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    active = spark.sparkContext._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = configured or os.path.join(tempfile.gettempdir(), f"spark-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to the shared checkpoint folder, so that iterative plans stay short and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the driver collect plans that are no longer held: Spark's cleaner then removes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Yields keep(df): df written as Parquet in the shared checkpoint folder and read back; all is removed at the end.

    keep.drop(df) removes a kept table earlier, when nothing reads it any more.
    What leaves the block must not read these tables any more: cut its lineage with a checkpoint first.
    """
    root = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    count, paths = 0, {}

    def keep(df: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        path = f"{root}/{count}"
        df.write.parquet(path)
        release(spark)
        kept = spark.read.schema(df.schema).parquet(path)
        paths[id(kept)] = (path, kept)  # held, so that no other table gets its id
        return kept

    def delete(name: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    keep.drop = lambda df: delete(paths.pop(id(df))[0])
    try:
        yield keep
    finally:
        paths.clear()
        delete(root)


def derived(table: DataFrame, kind: str, build: Callable[[str], None]) -> str:
    """The folder of what `build` writes from a table's files, in the checkpoint folder; built if those files have none yet.

    It is named by the files' paths, sizes and times, so that a changed table has another, and counts only when it is whole.
    """
    spark = table.sparkSession
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    name = files.agg(F.coalesce(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
    folder = f"{checkpoint_dir(spark)}/{kind}{name}"
    try:
        return spark.read.parquet(f"{folder}/ready").first()["path"]
    except AnalysisException:  # none, or one whose writing broke off
        path = f"{folder}/{uuid.uuid4().hex}"
    build(path)
    spark.range(1).select(F.lit(path).alias("path")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ready")
    return path


def within(df: DataFrame, rows: int) -> bool:
    """True when df has at most `rows` rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table.  In local mode (tests, benchmark) a text table of one file is spread over the cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if name not in TEXT_TABLES or not spark.sparkContext.master.startswith("local["):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
