"""Token counts by separator scan over flat token streams that have no index."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the public pattern of this vocabulary
SEPARATOR = 50256
KIND = "<u2"
BLOCK_TOKENS = 1 << 16
STREAM = "kind int, file long, block long, doc_id long, payload binary"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_stream(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, block: int = BLOCK_TOKENS) -> DataFrame:
    """Encode documents into one flat stream of two-byte ids per task, a separator after each document.

    The stream is cut into blocks of ``block`` ids wherever they fall (kind 0: file, block, payload). Lines of kind 1 keep
    which document came where (``block`` is then the ordinal); the scan does not use them. Null texts count as empty,
    null ids keep their place. Store the result before use: streams are per task of this run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = _encoder(ranks), TaskContext.get().partitionId()
        rest, number, ordinal = np.zeros(0, KIND), 0, 0

        def lines(kind: int, first: int, ids: list, payloads: list) -> pa.RecordBatch:
            n = max(len(ids), len(payloads))
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([file] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(ids or [None] * n, pa.int64()), pa.array(payloads or [None] * n, pa.binary())],
                names=["kind", "file", "block", "doc_id", "payload"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                parts = [rest]
                for t in texts.slice(at, 256):
                    parts += [np.array(encoder.encode_ordinary(t.as_py() or ""), KIND), np.array([SEPARATOR], KIND)]
                flat = np.concatenate(parts)
                full = len(flat) // block
                if full:
                    yield lines(0, number, [], [flat[i * block : (i + 1) * block].tobytes() for i in range(full)])
                    number += full
                rest = flat[full * block :]
                mine = ids[at : at + 256]
                yield lines(1, ordinal, mine, [None] * len(mine))
                ordinal += len(mine)
        if len(rest):
            yield lines(0, number, [], [rest.tobytes()])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, STREAM)


def read_files(spark: SparkSession, path: str, block: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, payload) of raw token files in a folder (any store that Spark reads; 2 GB a file at most)."""
    size = block * np.dtype(KIND).itemsize
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("length", F.lit(1)) - 1) / size))).alias("block"))
    return files.select("file", "block", F.substring("content", (F.col("block") * size + 1).cast("int"), F.lit(size)).alias("payload"))


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """One line per block: how many separators, ids before the first and after the last, and lengths in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("separators", "head", "tail", "inner")}
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_py() or b"", KIND)
                at = np.flatnonzero(ids == separator)
                rows["separators"].append(len(at))
                rows["head"].append(int(at[0]) if len(at) else len(ids))
                rows["tail"].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                rows["inner"].append(np.diff(at) - 1)
            kinds = {"separators": pa.int64(), "head": pa.int64(), "tail": pa.int64(), "inner": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(rows[c], kinds[c]) for c in rows]], names=["file", "block", *rows])

    return blocks.select("file", "block", "payload").mapInArrow(run, "file long, block long, separators long, head long, tail long, inner array<long>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """One line per document of the flat streams: file, ordinal, n_tokens (without its separator), closed.

    Blocks are searched on their own; a prefix scan over one short line per block gives each the documents before it and
    the ids carried into it from blocks without a separator. Ids after the last separator of a stream are one more
    document that is not ``closed``. Empty blocks and empty streams add nothing; two separators in a row are an empty
    document. Blocks of a file must be numbered in order without repeats.
    """
    scanned = scan_blocks(blocks, separator)
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = scanned.withColumns({"ended": F.sum(F.signum("separators").cast("long")).over(upto), "before": F.sum("separators").over(upto) - F.col("separators")})
    run = Window.partitionBy("file", "ended").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("open", F.sum("tail").over(run))
    carried = summed.withColumns({"carry": F.lag("open", 1, 0).over(order), "last": F.lead("block").over(order).isNull()})
    done = F.when(F.col("separators") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    all_ = F.concat(F.transform(done, lambda n: F.struct(n.alias("n"), F.lit(True).alias("closed"))), F.when(F.col("last") & (F.col("open") > 0), F.array(F.struct(F.col("open").alias("n"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<n:long,closed:boolean>>")))
    each = carried.select("file", "before", F.posexplode(all_).alias("at", "found"))
    return each.select("file", (F.col("before") + F.col("at")).alias("ordinal"), F.col("found.n").alias("n_tokens"), F.col("found.closed").alias("closed"))
