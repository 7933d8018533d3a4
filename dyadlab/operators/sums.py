"""Sums of small arrays over a distributed table: the one step every fit here is made of.

Each task folds its Arrow batches into one vector per fit; vectors are added up by Spark in two levels. What travels
is (tasks x fits x parameters), never rows; what reaches the driver is (fits x parameters).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = dict[str, np.ndarray]
FAN_IN = 64


def batch_columns(batch: pa.RecordBatch) -> Columns:
    """Arrow batch to arrays; list columns become two-dimensional without a per-row copy; lists that
    are null or of unequal lengths fail."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            sizes = np.diff(column.offsets.to_numpy())
            if column.null_count or len(np.unique(sizes)) > 1:
                raise ValueError(f"vectors in {name} must have one length and no nulls")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def _lists(vectors: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vectors).astype(np.float64)))


def grouped_sums(df: DataFrame, compute: Callable[[Columns], dict[int, np.ndarray]], tasks: int | None = None) -> dict[int, np.ndarray]:
    """Add up ``compute(batch)[fit]`` over the table, per fit number. ``tasks`` is the table's partition count where the
    caller knows it: few partitions need no second level."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, vector in compute(batch_columns(batch)).items():
                    total[key] = total[key] + vector if key in total else vector
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(list(total.values()))], ["fit", "stats"])

    def add(column):
        return F.aggregate(column, F.array().cast("array<double>"), lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.zip_with(acc, x, lambda a, b: a + b)))

    partial = df.mapInArrow(run, "fit int, stats array<double>")
    if tasks is None or tasks > FAN_IN:
        partial = partial.groupBy("fit", (F.spark_partition_id() % FAN_IN).alias("bucket")).agg(add(F.collect_list("stats")).alias("stats"))
    found = partial.groupBy("fit").agg(add(F.collect_list("stats")).alias("stats")).toArrow()  # fits x parameters
    return {fit: np.array(stats.values) for fit, stats in zip(found["fit"].to_pylist(), found["stats"])}


def map_columns(df: DataFrame, compute: Callable[[Columns], Columns], keep: list[str], schema: str) -> DataFrame:
    """Row-aligned vectorised columns: ``keep`` columns pass through, ``compute`` adds arrays of the same length."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names, arrays = [], []
            for name in keep:
                names.append(name)
                arrays.append(batch.column(batch.schema.get_field_index(name)))
            for name, values in compute(batch_columns(batch)).items():
                names.append(name)
                arrays.append(_lists(list(values)) if values.ndim == 2 else pa.array(values))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, schema)
