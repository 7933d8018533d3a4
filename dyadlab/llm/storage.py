"""Intermediate results as Parquet in the shared checkpoint folder, removed as soon as nothing needs them."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from dyadlab.session import ensure_checkpoint_dir


class Shelf:
    """A folder of its own below the checkpoint folder. Stored results survive lost executors; they are compressed by column,
    unlike checkpoints, which hold whole rows. Use as a context: what is left is removed at the end, also after a failure."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.base, self.count = spark, f"{spark.sparkContext.getCheckpointDir()}/shelf-{uuid.uuid4().hex}", 0
        self.places: dict[int, str] = {}

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.base)

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and go on from what was written; the shuffle files behind it are let go."""
        place, schema = f"{self.base}/{self.count}", df.schema
        self.count += 1
        df.write.option("compression", "zstd").parquet(place)
        del df
        stored = self.spark.read.schema(schema).parquet(place)
        self.places[id(stored)] = place
        release(self.spark)
        return stored

    def drop(self, stored: DataFrame) -> None:
        self._delete(self.places.pop(id(stored)))

    def _delete(self, place: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner look at once for shuffles that no DataFrame reaches any more; their files are of no more use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
