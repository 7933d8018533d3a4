"""Two-phase write-once commit: a run's tables and its record appear together by one rename, or not at all.

Phase one writes every table below a staging folder beside the target, reads it back, compares it with what was computed and adds
the record. Phase two renames the staging folder. A target that exists is final; a staging folder that exists is a run that was
cut short (or is still at work), and no other run touches it until somebody has looked and called :func:`discard`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.sources.sinks import AlreadyWritten, exists, ledger_mismatches, table_ledger

RECORD = "_record"


class PartialRun(RuntimeError):
    """A staging folder is there: an earlier run did not end, and its remains await review."""


class VerificationFailed(RuntimeError):
    """What was written is not what was to be written; the staging folder is kept for review."""


def staging_path(target: str) -> str:
    return target.rstrip("/") + "._staging"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def require_fresh(spark: SparkSession, target: str) -> None:
    if exists(spark, target):
        raise AlreadyWritten(target)
    if exists(spark, staging_path(target)):
        raise PartialRun(staging_path(target))


def discard(spark: SparkSession, target: str) -> bool:
    """Remove what an interrupted run left; never a committed target. True if there was something."""
    files, place = _files(spark, staging_path(target))
    return files.delete(place, True)


def _claim(spark: SparkSession, target: str) -> None:
    """Make the staging folder; of two runs at once one fails here. ``mkdirs`` alone says nothing about who made it, so the claim is a
    file that only one writer can create."""
    files, place = _files(spark, staging_path(target))
    files.mkdirs(place)
    claim = spark._jvm.org.apache.hadoop.fs.Path(place, "_claim")
    try:
        files.create(claim, False).close()
    except Exception as error:
        raise PartialRun(staging_path(target)) from error


def publish(spark: SparkSession, tables: dict[str, DataFrame], target: str, record: dict[str, str], verify: Callable[[dict[str, DataFrame]], None] | None = None) -> DataFrame:
    """Commit ``tables`` below ``target`` with a record: one line per table with its ledger entry and the given fields.

    Tables are computed once, when they are staged. They are read back from there, ``verify`` (which raises) sees them, and their
    ledger is taken twice, before and after the record is written, so a table that changes meanwhile is noticed. Returns the record.
    """
    if not tables:
        raise ValueError("nothing to publish")
    require_fresh(spark, target)
    _claim(spark, target)
    staged = staging_path(target)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{staged}/{name}")
    back = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in tables.items()}
    if verify is not None:
        verify(back)
    lines = table_ledger(back).withColumns({k: F.lit(v) for k, v in record.items()})
    lines.coalesce(1).write.mode("errorifexists").parquet(f"{staged}/{RECORD}")
    written = spark.read.schema(lines.schema).parquet(f"{staged}/{RECORD}")
    if not ledger_mismatches(table_ledger(back), written).isEmpty():
        raise VerificationFailed(staged)
    _rename(spark, staged, target)
    return read_record(spark, target)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    files, place = _files(spark, source)
    if exists(spark, target) or not files.rename(place, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise AlreadyWritten(target)


def read_record(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target.rstrip('/')}/{RECORD}")


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A committed table, after its content was compared with the record."""
    table = spark.read.parquet(f"{target.rstrip('/')}/{name}")
    stored = read_record(spark, target).filter(F.col("table_name") == name)
    if not ledger_mismatches(table_ledger({name: table}), stored).isEmpty():
        raise VerificationFailed(f"{target}/{name}")
    return table
