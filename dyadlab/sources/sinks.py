"""Write-once sinks and ledgers over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AlreadyWritten(RuntimeError):
    """A target exists; results are never overwritten."""


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def require_absent(spark: SparkSession, *paths: str) -> None:
    """All targets are checked before any is written, so a partial result blocks a rerun too."""
    present = [p for p in paths if exists(spark, p)]
    if present:
        raise AlreadyWritten(", ".join(present))


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Write every table below ``root`` once: parquet, csv (header kept when empty) or json (fields in sorted order)."""
    spark = next(iter(tables.values())).sparkSession
    targets = {name: f"{root.rstrip('/')}/{name}" for name in tables}
    require_absent(spark, *targets.values())
    for name, df in tables.items():
        writer = (df.select(*sorted(df.columns)) if fmt == "json" else df).write.mode("errorifexists")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(targets[name])


def table_ledger(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, rows, schema and an order-free content hash of each table, in one narrow scan: SHA-256 of each row as JSON
    with its nulls, added up exactly in four parts (so repeated rows count and moved values or nulls show)."""
    out = None
    for name, df in tables.items():
        digest = df.select(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256).alias("d"))
        parts = [F.coalesce(F.sum(F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
        line = digest.agg(F.count("*").alias("rows"), F.concat_ws("-", *parts).alias("content_hash"))
        line = line.select(F.lit(name).alias("table_name"), "rows", F.lit(df.schema.simpleString()).alias("schema"), "content_hash")
        out = line if out is None else out.unionByName(line)
    return out


def ledger_mismatches(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables that are missing, new, or differ in rows, schema or content."""
    columns = ["rows", "schema", "content_hash"]
    was = stored.select("table_name", *[F.col(c).alias(f"stored_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    return now.join(was, "table_name", "full_outer").filter(~same)
