"""Range sharding by sampled splitters: equal bytes per shard, equal texts together. DataFrame functions only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadlab.session import cut

RANGES_PER_SHARD = 8
SAMPLES_PER_RANGE = 16
OVERFULL = 2.0  # times the mean bytes of a range
WHOLE_GROUP = 0.01  # groups of equal texts below this part of a shard are never cut


def _unit(*cols: Column) -> Column:
    """A repeatable pseudo-random number in [0, 1) of the row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _splitters(rows: DataFrame, ways: int, total: int, salt: int) -> list[int]:
    """About ``ways`` quantile boundaries of ``place``, each row drawn in proportion to its size. The sample has about
    SAMPLES_PER_RANGE lines per boundary, so its size depends on the number of ranges alone."""
    if ways < 1 or total <= 0:
        return []
    wanted = ways * SAMPLES_PER_RANGE
    drawn = F.floor(F.col("size") * F.lit(wanted / total) + _unit(F.lit(salt), "doc_id", "place"))
    sample = rows.select("place", drawn.alias("weight")).filter("weight > 0")
    lines = sorted((r.place, r.weight) for r in sample.groupBy("place").agg(F.sum("weight").alias("weight")).collect())
    weight, bounds, seen = sum(w for _, w in lines), [], 0
    for place, w in lines:
        seen += w
        while len(bounds) < ways and seen * (ways + 1) > (len(bounds) + 1) * weight:
            bounds.append(place)
    return sorted(set(bounds))


def _snap(bounds: list[int]) -> list[int]:
    """A boundary moves to the start of its key's rows, unless several boundaries fall into one key (a heavy key)."""
    keys = [b >> 32 for b in bounds]
    return sorted({b if keys.count(b >> 32) > 1 else (b >> 32) << 32 for b in bounds})


def _ranged(rows: DataFrame, bounds: list[int]) -> DataFrame:
    literal = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    return rows.withColumn("range", F.size(F.filter(literal, lambda b: b <= F.col("place"))))


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are ordered by (text hash, row hash, key). Splitters drawn in proportion to size cut that order into ranges;
    a range that proves overfull gets splitters of its own until none is (a heavy text is thereby cut by row hash).
    Running sums inside the ranges place each row; groups of equal texts smaller than WHOLE_GROUP of a shard go where
    their first row goes, larger ones are divided. Shards differ by at most the largest row or undivided group.
    Null texts have 16 bytes and the CRC of an empty text. Null keys sort first. Repeated rows take slots of their own.
    Without rows the result is empty; with few, some shards stay empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    place = F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 33), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(7)), 32))
    rows = cut(docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), place.alias("place")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    bounds = _snap(_splitters(rows, ranges - 1, total, 1))
    limit = OVERFULL * total / ranges
    for salt in count(2):  # ends: each round adds boundaries between places, or stops
        full = [r for r in _ranged(rows, bounds).groupBy("range").agg(F.sum("size").alias("size"), F.count_distinct("place").alias("places")).collect() if r["size"] > limit and r.places > 1]
        more: set[int] = set()
        for r in full:
            part = _ranged(rows, bounds).filter(F.col("range") == r.range)
            more |= set(_snap(_splitters(part, int(r["size"] / (total / ranges)) + 1, r["size"], salt)))
        if not more - set(bounds):
            break
        bounds = sorted(more | set(bounds))
    ranged = cut(_ranged(rows, bounds).repartition(F.col("range")))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("range").collect()  # one line per range
    starts, at, n = [], 0, 0
    for r in sums:
        starts.append((r.range, at, n))
        at, n = at + r.bytes, n + r.rows
    spark = docs.sparkSession
    table = spark.createDataFrame(starts, "range int, before_bytes long, before_rows long")
    group = F.shiftright("place", 32)
    order = Window.partitionBy("range").orderBy("place", "doc_id", "text_crc32")
    own = Window.partitionBy("range", group)
    placed = ranged.join(F.broadcast(table), "range").select(  # one line per range, at most a few times shards * RANGES_PER_SHARD
        "*", (F.col("before_bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("offset"), (F.col("before_rows") + F.row_number().over(order) - 1).alias("position"), group.alias("group"),
    )
    share = max(total, 1) / shards
    whole = F.sum("size").over(own) <= WHOLE_GROUP * share
    middle = F.col("offset") + F.col("size") / 2
    shard = F.least(F.floor(F.when(whole, F.min("offset").over(own)).otherwise(middle) / F.lit(share)), F.lit(shards - 1)).cast("int")
    sharded = cut(placed.select("doc_id", "size", "text_crc32", "position", "offset", shard.alias("shard")))
    firsts = sharded.groupBy("shard").agg(F.min("position").alias("first"))  # one line per shard
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
