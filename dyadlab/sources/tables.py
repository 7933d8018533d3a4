"""Table readers with explicit schemas, and the contracts a table must meet before it is used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadlab.operators.pairs import SIDE, UNIT


class ContractError(ValueError):
    """A table does not meet its contract."""


def read_text_table(spark: SparkSession, path: str, header: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with every column as text: codes such as 'bv' must survive, so types are never inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    return df.select(*columns) if columns else df


def stage_rows(rows: DataFrame, manifest: DataFrame, stage: str, unit: str = UNIT) -> DataFrame:
    """Rows of the units a manifest assigns to one stage."""
    return rows.join(manifest.filter(F.col("partition") == stage).select(unit), unit, "left_semi")


def prediction_contract(df: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """Per key: rows, units, repeated (unit, side) and rows with a side outside {1, 2}."""
    per_side = df.groupBy(*keys, UNIT, SIDE).agg(F.count("*").alias("_n"))
    per_unit = per_side.groupBy(*keys, UNIT).agg(
        F.sum("_n").alias("_rows"), F.count_if(F.col("_n") > 1).alias("_twice"), F.sum(F.when(F.col(SIDE).isin(1, 2), 0).otherwise(F.col("_n"))).alias("_odd"),
        F.count_if(F.col(SIDE).isin(1, 2)).alias("_sides"))
    return per_unit.groupBy(*keys).agg(
        F.sum("_rows").alias("rows"), F.count("*").alias("units"), F.sum("_twice").alias("repeated_sides"), F.sum("_odd").alias("invalid_sides"), F.count_if(F.col("_sides") == 2).alias("complete_units"))


def require_predictions(df: DataFrame, keys: Sequence[str] = ("endpoint",)) -> DataFrame:
    """``df`` itself, after the contract held for every key."""
    broken = prediction_contract(df, keys).filter("repeated_sides > 0 OR invalid_sides > 0 OR complete_units < units OR rows <> 2 * units")
    bad = broken.limit(5).collect()
    if bad:
        raise ContractError(f"prediction table: {[r.asDict() for r in bad]}")
    return df


def manifest_contract(df: DataFrame, labels: Sequence[str], unit: str = UNIT) -> DataFrame:
    """Counts behind the manifest rules: units per label, repeated units, units under two labels, unknown labels."""
    per_unit = df.groupBy(unit).agg(F.count("*").alias("_n"), F.min("partition").alias("_lo"), F.max("partition").alias("_hi"),
                                    F.count_if(~F.coalesce(F.col("partition").isin(*labels), F.lit(False))).alias("_odd"), *[F.count_if(F.col("partition") == x).alias(x) for x in labels])
    return per_unit.agg(
        F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated_units"), F.count_if(F.col("_lo") != F.col("_hi")).alias("overlapping_units"), F.sum("_odd").alias("unknown_labels"),
        *[F.count_if(F.col(x) > 0).alias(f"{x}_units") for x in labels])


def require_manifest(df: DataFrame, labels: Sequence[str], expected: dict[str, int] | None = None, unit: str = UNIT) -> DataFrame:
    if df.columns != [unit, "partition"]:
        raise ContractError(f"manifest header is {df.columns}")
    found = manifest_contract(df, labels, unit).first().asDict()
    wrong = {k: found[k] for k in ("repeated_units", "overlapping_units", "unknown_labels") if found[k]}
    wrong.update({k: found[f"{k}_units"] for k, n in (expected or {}).items() if found[f"{k}_units"] != n})
    if wrong:
        raise ContractError(f"manifest: {wrong}")
    return df


def embedding_contract(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows, smallest and largest vector length, and vectors with a null or NaN entry."""
    bad = ~F.coalesce(F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.min(F.size(column)).alias("min_size"), F.max(F.size(column)).alias("max_size"), F.count_if(bad).alias("bad_vectors"))


def require_embeddings(df: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    found = embedding_contract(df, column).first()
    if found["rows"] and (found["min_size"] != size or found["max_size"] != size or found["bad_vectors"]):
        raise ContractError(f"embeddings: {found.asDict()}")
    return df


def attach_vectors(rows: DataFrame, vectors: DataFrame, on: Sequence[str], column: str = "embedding") -> DataFrame:
    """One-to-one attach of vectors to rows; a row without a vector is an error."""
    from dyadlab.operators.pairs import checked_join

    joined = checked_join(rows, vectors.select(*on, column), on, "left", "one_to_one")
    lost = F.raise_error(F.concat(F.lit("no vector for row "), F.concat_ws("/", *[F.col(c).cast("string") for c in on])))
    return joined.withColumn(column, F.when(F.col(column).isNull(), lost).otherwise(F.col(column)))
