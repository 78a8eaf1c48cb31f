"""Session defaults and the shared folder for durable intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"


def build_session(app_name: str = "tamarack", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for.

    ANSI arithmetic and a UTC clock fix the meaning of the results; adaptive
    execution picks partition counts, splits skewed joins and swaps join
    strategies from measured sizes. Cluster settings given in ``conf`` or by
    spark-submit win over these defaults.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    defaults = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for files that every executor must be able to read; it goes when the session's JVM ends.

    It lies below ``spark.checkpoint.dir``. Where that is unset, as in tests, it
    lies below the warehouse, which a cluster shares as well.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/tamarack-{purpose}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Let ``DataFrame.checkpoint()`` work: the cluster's folder, or one of our own in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get(CHECKPOINT_CONF, None)
        spark.sparkContext.setCheckpointDir(root or shared_folder(spark, "checkpoint"))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` read back from a table written to the shared folder.

    For a result that several later steps read: it is computed once, its lineage
    ends at the files, and its size is known when the next join is planned. Lost
    executors cost nothing but a re-read, and the shuffles behind it are removed
    at once.
    """
    return stored_in_turn([df], purpose)


def stored_in_turn(parts: Iterable[DataFrame], purpose: str, dealt_by: str | None = None, **options: str) -> DataFrame:
    """The rows of all ``parts``, at least one, read back from one table to which they are written one after another.

    For a result too large to be made in one go: the shuffles of a part are
    removed before the next part starts. ``dealt_by`` names a column of few
    values that get a folder each; ``options`` go to the writer.
    """
    path = None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{shared_folder(spark, purpose)}/rows", df.schema
        # without writers at once, a task would sort its rows by folder
        conf = {CLEANUP_CONF: "true", **({WRITERS_CONF: "64"} if dealt_by else {})}
        before = {key: spark.conf.get(key) for key in conf}
        rows = df.write.mode("append").options(**options)
        try:
            for key, value in conf.items():
                spark.conf.set(key, value)
            (rows.partitionBy(dealt_by) if dealt_by else rows).parquet(path)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
    return spark.read.schema(schema).parquet(path)
