"""File inventories, digests and checksum ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.session import shuffle_width

PIECE = 1 << 18  # bytes of a file that travel together, unless a line has more
_MARK = b"\xef\xbb\xbf"
_CODED = r"\.(deflate|gz|bz2|lz4|snappy|zst)$"  # what the reader of lines would decompress


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _named(df: DataFrame, root: str, *extra: Column) -> DataFrame:
    """relative_path, filename, stem, extension from the full path."""
    base = root.rstrip("/").split("://")[-1]
    plain = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    start = F.instr(plain, base)
    relative = F.expr(f"ltrim('/', substring(regexp_replace(path, '^[a-z0-9]+:/*(?=/)', ''), {len(base)} + 1))")
    named = df.withColumn("relative_path", F.when(start == 1, relative).otherwise(plain))
    name = F.element_at(F.split("relative_path", "/"), -1)
    return named.select(
        "relative_path", name.alias("filename"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), *extra)


def inventory(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> DataFrame:
    """Files below ``root``. Contents are not read: only path and length are selected from the scan."""
    found = _named(_binary(spark, root).select("path", "length"), root)
    return found.filter(F.col("extension").isin(*[e.lower() for e in extensions])) if extensions else found


class _Chain:
    """sha256 of a file from its lines, each with a line end. The reader drops a byte order mark at the start of a file, and whether the last
    line ended is not seen; both follow from the size."""

    def __init__(self):
        self.plain, self.marked, self.total, self.end = hashlib.sha256(), hashlib.sha256(_MARK), 0, b""

    def add(self, lines: memoryview) -> None:
        for digest in (self.plain, self.marked):
            digest.update(self.end)
            digest.update(lines[:-1])
        self.total, self.end = self.total + len(lines), b"\n"

    def hexdigest(self, size: int) -> str:
        marked = self.total < size  # at most one byte too long without the mark, three bytes too short or two with it
        digest, extra = (self.marked, self.total + len(_MARK) - size) if marked else (self.plain, self.total - size)
        if extra not in (0, 1):
            raise ValueError(f"{self.total} bytes were read of a file of {size} bytes")
        if not extra:
            digest.update(self.end)
        return digest.hexdigest()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a file that one task reads, its digest; of others, pieces of whole lines with their place."""
    at, chain, size, place = None, None, 0, 0
    schema = pa.schema([("_path", pa.string()), ("_size", pa.int64()), ("_start", pa.int64()), ("_place", pa.int64()), ("sha256", pa.string()), ("_piece", pa.binary())])
    line = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column("_path").dictionary_encode(), batch.column("_start").to_numpy()
        codes, lines = paths.indices.to_numpy(), batch.column("_line").cast(pa.large_binary())
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2])
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)]):
            here = paths.dictionary[int(codes[i])].as_py(), int(starts[i])
            if here != at:
                if chain:
                    yield line(at[0], size, 0, 0, chain.hexdigest(size), None)
                at, size, place = here, batch.column("_size")[i].as_py(), 0
                chain = _Chain() if batch.column("_length")[i].as_py() == size else None
            if chain:
                chain.add(data[ends[i] : ends[j]])
                continue
            while i < j:
                k = max(i + 1, min(j, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1))
                yield line(*here[:1], size, here[1], place, None, bytes(data[ends[i] : ends[k]]))
                i, place = k, place + 1
    if chain:
        yield line(at[0], size, 0, 0, chain.hexdigest(size), None)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the files of a sorted stream of pieces."""
    at, chain, size = None, None, 0
    line = lambda path, digest: pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([digest], pa.string())], names=["_path", "sha256"])
    for batch in batches:
        pieces = batch.column("_piece")
        for i, (path, length, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_path", "_size", "sha256")))):
            if digest is not None:
                yield line(path, digest)
                continue
            if path != at:
                if chain:
                    yield line(at, chain.hexdigest(size))
                at, chain, size = path, _Chain(), length
            chain.add(memoryview(pieces[i].as_buffer()))
    if chain:
        yield line(at, chain.hexdigest(size))


def file_digests(spark: SparkSession, root: str, extensions: Sequence[str] = ()) -> DataFrame:
    """Inventory with the sha256 of each file. Files are read as lines of bytes, in splits, so that a file of any size is held by no task: a
    file of one split is digested where it is read, and the pieces of a larger one pass in order through one task, a few at a time.

    Names that Hadoop would take for compressed text have to be read as a row each (2 GB at most); a line is held whole. Spark's readers
    leave out empty files.
    """
    name = F.lower("_metadata.file_name")
    kept = F.lower(F.regexp_extract("_metadata.file_name", r"(?<=.)(\.[^.]+)$", 1)).isin(*[e.lower() for e in extensions]) if extensions else F.lit(True)
    rows = _binary(spark, root)
    found = rows.filter(kept).select("path", "length", F.col("_metadata.file_path").alias("_path"))
    lines = spark.read.format("text").option("recursiveFileLookup", True).option("lineSep", "\n").load(root).filter(kept & ~name.rlike(_CODED))
    read = lines.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("_line"))
    pieces = read.mapInArrow(_pieces, "_path string, _size bigint, _start bigint, _place bigint, sha256 string, _piece binary")
    digests = pieces.repartition(shuffle_width(spark), "_path").sortWithinPartitions("_path", "_start", "_place").mapInArrow(_chained, "_path string, sha256 string")
    coded = rows.filter(kept & name.rlike(_CODED)).select(F.col("_metadata.file_path").alias("_path"), F.sha2("content", 256).alias("sha256"))
    mark = F.when(F.col("length") == len(_MARK), F.sha2(F.lit(_MARK), 256))  # no line is read of nothing but a mark
    missing = F.raise_error(F.concat(F.lit("no line was read of "), F.col("path")))
    joined = found.join(digests.unionByName(coded), "_path", "left").withColumn("sha256", F.coalesce("sha256", mark, missing))
    return _named(joined, root, F.col("sha256"))


def shallowest(files: DataFrame, filename: str) -> str:
    """The one file of that name nearest the root; none or a tie is an error."""
    found = files.filter(F.col("filename") == filename).select("relative_path", F.size(F.split("relative_path", "/")).alias("depth"))
    nearest = found.orderBy("depth", "relative_path").limit(2).collect()
    if not nearest:
        raise FileNotFoundError(filename)
    if len(nearest) == 2 and nearest[0]["depth"] == nearest[1]["depth"]:
        raise ValueError(f"several files named {filename} at the same depth")
    return nearest[0]["relative_path"]


def parse_ledger(lines: DataFrame, line: str = "value") -> DataFrame:
    """Ledger lines ``<64 hex>  <path>`` to (path, expected, valid); a leading star on the path is dropped."""
    text = F.trim(F.col(line))
    ok = text.rlike(r"^[0-9A-Fa-f]{64}\s+\S")
    return lines.filter(text != "").select(
        F.when(ok, F.regexp_replace(F.regexp_extract(text, r"^[0-9A-Fa-f]{64}\s+(.*)$", 1), r"^\*", "")).alias("path"),
        F.when(ok, F.lower(F.substring(text, 1, 64))).alias("expected"), ok.alias("valid"))


def ledger_problems(parsed: DataFrame) -> DataFrame:
    """Malformed lines and repeated paths; empty for a good ledger."""
    malformed = parsed.filter(~F.col("valid")).agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("malformed").alias("problem"), F.lit(None).cast("string").alias("path"), "n")
    repeated = parsed.filter("valid").groupBy("path").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), "path", "n")
    return malformed.unionByName(repeated)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    parsed = parse_ledger(spark.read.text(path))
    problems = ledger_problems(parsed).limit(5).collect()
    if problems:
        raise ValueError(f"ledger {path}: {[r.asDict() for r in problems]}")
    return parsed.select("path", "expected")


def checksum_match(actual: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """Every actual file with its expected digest and a three-valued match (null: not in the ledger)."""
    return actual.join(expected, path, "left").withColumn("matches", F.when(F.col("expected").isNotNull(), F.col("sha256") == F.col("expected")))


def ledger_differences(actual: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """Files whose digest is missing on either side or differs; empty when the tree is intact."""
    return actual.join(expected, path, "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("expected"))).select(path, "sha256", "expected")
