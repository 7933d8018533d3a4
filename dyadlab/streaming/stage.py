"""Row-by-row stage reading, as a stream: new source rows are admitted by the manifest as they arrive.

Both functions are stateless (a stream-static semi join and a per-batch scoring), so there is no watermark to set and
nothing to expire.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dyadlab.operators.gates import Gate
from dyadlab.operators.pairs import UNIT
from dyadlab.sources.tables import stage_rows


def stage_stream(spark: SparkSession, folder: str, header: Sequence[str], manifest: DataFrame, stage: str, gate: Gate | None = None, sealed: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of one stage from a folder that text files are dropped into; the gate is checked before the stream starts."""
    if gate is not None:
        gate.authorize(manifest, stage, sealed)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.readStream.schema(schema).csv(folder, header=True)
    return stage_rows(rows, manifest.withColumn(UNIT, F.col(UNIT).cast("string")), stage)


def write_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch function to every micro-batch and append its result to a parquet table, one folder per batch, so
    a replayed batch replaces itself instead of being added twice."""

    def one(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
