"""Corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, SentencePiece encoding.

Rows are told apart by a stored number, never by doc_id: ids may repeat or be null. Toxicity, decontamination and encoding are one
scan each; the dedup stages decide on numbers and digests and move the texts once, to drop the rows that lost. Null texts count as
empty; empty tables give empty results; columns of any name come through, whatever names a stage uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_codec, toxicity
from dyadlab.llm.storage import Shelf
from dyadlab.session import cut


def _free(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of each row, written so that numbers stay, and the number's name."""
    row = _free(docs, "_row")
    return Shelf(docs.sparkSession).put(docs.withColumn(row, F.monotonically_increasing_id())), row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier does not predict toxic."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per equal text: that of the smallest doc_id, nulls last."""
    rows, row = _numbered(docs)
    digests = rows.select(F.col(row).alias("row"), "doc_id", F.sha2(exact_dedup.normal_text(F.col("text")), 256).alias("digest"))
    ordered = cut(digests.orderBy(F.col("doc_id").asc_nulls_last(), "row").select("row", "digest", F.monotonically_increasing_id().alias("rank")))
    index = exact_dedup.DigestIndex(spark)
    kept = cut(exact_dedup.deduplicate(ordered, index, key="rank", text="digest", edges=exact_dedup.halves(ordered, "rank")).filter("kept").select("rank"))
    index.drop()
    stay = ordered.join(kept, "rank", "left_semi").select(F.col("row").alias(row))
    return rows.join(stay, row, "left_semi").drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per component: that of the smallest doc_id, nulls last."""
    rows, row = _numbered(docs)
    classes = ngram_join.near_classes(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    named = classes.join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stay = named.groupBy("component").agg(F.min_by("row", order).alias(row)).select(row)
    return rows.join(stay, row, "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Coverage limit 0: a document that holds any benchmark window goes."""
    overlaps = decontaminate.find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return overlaps.filter(F.size("hits") == 0).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row."""
    return sentencepiece_codec.encode(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]
ORACLE_SQL = None  # compression lengths, the fitted model and the encoder are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages; each stage's result is stored in the checkpoint folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark)
    for _, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
