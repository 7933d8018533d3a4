"""Exact deduplication against a persistent digest index, bucketed and sorted by hash. DataFrame functions only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.session import cut

BUCKETS = 64


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class DigestIndex:
    """A table (digest, keep_id, batch) in ``buckets`` buckets by digest, each file sorted by digest, that grows batch by batch.

    A batch is reduced to one line per digest before anything is shuffled by it, then anti-joined with the index; the
    index side needs no exchange. ``name`` is a table of the session's warehouse; an index opened again by name goes on
    where it ended. Appends write new bucket files, so rewrite the table (``compact``) after many small batches.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name or f"digest_index_{uuid.uuid4().hex}", buckets

    def create(self, key: str = "long") -> None:
        """The empty bucketed table, unless it exists."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], f"digest binary, keep_id {key}, batch string"), self.name, "append")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode(mode).format("parquet").saveAsTable(name)

    def append(self, candidates: DataFrame, batch: str | None = None) -> DataFrame:
        """Add those (digest, keep_id) lines whose digest is new; return them. A named batch can be given again, after a
        failure say: what it added before still counts as new to it, and is not added twice."""
        fresh = candidates.select("digest", "keep_id")
        self.create(fresh.schema["keep_id"].dataType.simpleString())
        held = self.read() if batch is None else self.read().filter(F.col("batch") != batch)
        fresh = cut(fresh.join(held.select("digest").hint("merge"), "digest", "left_anti"))
        unwritten = fresh
        if batch is not None:
            written = self.read().filter(F.col("batch") == batch).select("digest").hint("merge")
            unwritten = cut(fresh.join(written, "digest", "left_anti"))
        self._write(unwritten.withColumn("batch", F.lit(batch or uuid.uuid4().hex)), self.name, "append")
        return fresh

    def compact(self) -> None:
        rows = cut(self.read())
        self._write(rows, self.name, "overwrite")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex, key: str = "doc_id", text: str = "text", edges: Sequence = (), batch: str | None = None) -> DataFrame:
    """One line per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest key with that text in the batch, or what the index already holds for it. ``group_size``
    counts the batch's rows. Null texts equal empty ones. Where the text is new to the index, exactly one row of its group
    is ``kept``: the one whose key is keep_id, the first of them where rows repeat key and text. Null keys never win against
    others in the batch; where a group has no other key, keep_id is null and its first row is kept. An empty batch gives no
    lines. A ``batch`` given again under the same name has the same result (with the same edges), whether its first run
    ended or not; without a name it would be all copies.
    Ascending ``edges`` cut the rows by key into batches that enter the index one after the other, each anti-joined with
    what the earlier ones left there: keys up to the first edge, then up to the next, then the rest and null keys. The
    smallest key comes first, and group sizes are summed, so the result is that of one batch.
    Texts are read and hashed once; only digests are stored. Joining the rows with their group's line is a plain
    shuffled join, which adaptive execution splits where one text holds a large share of the rows.
    """
    digests = cut(docs.select(F.col(key).alias("key"), F.sha2(normal_text(F.col(text)), 256).alias("text_sha256")).withColumn("digest", F.unhex("text_sha256")))
    digests = digests.withColumn("row", F.monotonically_increasing_id())  # of stored rows, so that it stays
    lows, highs = [None, *edges], [*edges, None]
    groups, added = [], []
    for i, (low, high) in enumerate(zip(lows, highs)):
        over = F.lit(True) if low is None else F.col("key") > low
        part = digests.filter(over & (F.col("key") <= high) if high is not None else over | F.col("key").isNull())
        first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")).alias("first")
        groups.append(cut(part.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))))
        lines = groups[-1].select("digest", F.col("first.key").alias("keep_id"))
        added.append(index.append(lines) if batch is None else index.append(lines, f"{batch}/{i}"))
    added = reduce(DataFrame.unionByName, added).select("digest", F.lit(True).alias("new"))
    sizes = reduce(DataFrame.unionByName, groups)
    sizes = sizes.groupBy("digest").agg(F.min("first").alias("first"), F.sum("group_size").alias("group_size")) if edges else sizes
    held = sizes.select("digest", "group_size", F.col("first.row").alias("keep_row")).join(index.read().select("digest", "keep_id").hint("merge"), "digest", "left").join(added, "digest", "left")
    out = digests.join(held, "digest")
    kept = F.coalesce((F.col("row") == F.col("keep_row")) & F.col("new"), F.lit(False))
    return out.select(F.col("key").alias(key), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def halves(docs: DataFrame, key: str = "doc_id") -> list:
    """One edge for :func:`deduplicate` near the middle of the keys; none without keys."""
    middle = docs.agg(F.percentile_approx(key, 0.5)).first()[0]
    return [] if middle is None else [middle]
