"""Session helpers: building a session, cutting lineage in shared storage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

PART_ROWS = 1_000_000  # rows of a partition, on average, beyond the session's number of shuffle partitions


def build_session(name: str = "dyadlab", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the adaptive settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; a private one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner look at once for shuffles that no DataFrame reaches any more; their files are of no more use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of ``rows`` (PART_ROWS) rows on average, so that a task's share does not grow with the table.
    What is grouped by these keys (and more) next needs no exchange of its own. Counts the rows first."""
    return df.repartition(max(shuffle_width(df.sparkSession), -(-df.count() // (rows or PART_ROWS))), *keys)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
