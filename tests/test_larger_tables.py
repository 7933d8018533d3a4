"""Steps whose share of one task, or whose work, grew faster than the table."""

import hashlib

from pyspark.sql import functions as F

import dyadlab.session as session
from dyadlab.operators import audit as A
from dyadlab.operators import intervals as I
from dyadlab.operators import tree_bootstrap as T
from dyadlab.operators.ordering import hash_cuts
from dyadlab.operators.pairs import missing_keys
from dyadlab.plans.views import FIRST_DEVICE, SECOND_DEVICE, predictions


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cut_rows_are_not_shuffled_by_bucket(spark):
    drawn = spark.range(5000).select((F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    targets = spark.createDataFrame([(0, "x", 700), (1, "x", 90)], "g bigint, name string, k bigint")
    found = hash_cuts(drawn, "digest", targets, ["g"], "name")
    assert _plan(found).count("strategy=broadcast") >= 2
    want = {g: sorted(hashlib.sha256(str(i).encode()).hexdigest() for i in range(g, 5000, 2))[k - 1] for g, k in ((0, 700), (1, 90))}
    assert {r["g"]: r["cut"] for r in found.collect()} == want


def _expected(rows, repeats, seed):
    out = []
    for r in range(repeats):
        order = sorted(hashlib.sha256(f"{seed}|{r}|{key}".encode()).hexdigest() for _, key in rows)
        first, second = round(0.7 * len(rows)), round(0.7 * len(rows)) + round(0.15 * len(rows))
        cut = [order[k - 1] if k else "" for k in (first, second)]
        seen = {}
        for unit, key in rows:
            d = hashlib.sha256(f"{seed}|{r}|{key}".encode()).hexdigest()
            seen.setdefault(unit, set()).add(0 if d <= cut[0] else 1 if d <= cut[1] else 2)
        out.append((r, len(seen), sum(len(s) > 1 for s in seen.values())))
    return out


def test_row_splits_equal_sorted_digests(spark):
    for rows in ([(i // 3, str(i)) for i in range(900)], [(i, str(i % 3)) for i in range(400)] + [(i % 7, "4") for i in range(50)], [(1, "a")]):
        df = spark.createDataFrame(rows, "unit_id int, row string")
        got = sorted((r["repetition"], r["units"], r["units_in_several"]) for r in A.row_split_leakage(df, ["row"], 23, 5).collect())
        assert got == _expected(rows, 23, 5)
    assert A.row_split_leakage(spark.createDataFrame([], "unit_id int, row string"), ["row"], 2, 5).isEmpty()


def test_row_splits_send_a_line_a_unit(spark):
    df = spark.range(600).select((F.col("id") % 50).alias("unit_id"), F.col("id").alias("row"))
    assert "repetition" not in _plan(A.row_split_leakage(df, ["row"], 4, 1)).split("Aggregate [unit_id")[1]


def test_null_keys_of_both_sides_are_equal_and_partitions_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 100)
    left, right = (spark.createDataFrame([(None,), *((i,) for i in span)], "k int") for span in (range(0, 4000), range(10, 4010)))
    found = missing_keys(left, right, ["k"])
    assert {tuple(r) for r in found.collect()} == {(i, "left_only") for i in range(10)} | {(i, "right_only") for i in range(4000, 4010)}
    assert {r["k"] for r in missing_keys(left, right, ["k"], both=False).collect()} == set(range(10))
    assert "RepartitionByExpression [k" in _plan(found) and ", 81" in _plan(found)


def test_labels_are_folded_in_partitions_that_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 50)
    df = spark.range(4000).select((F.col("id") % 1000).alias("unit_id"), (F.col("id") % 2).cast("string").alias("a"), F.when(F.col("id") < 10, "x").alias("b"))
    found = A.label_summary(df, ["a", "b"])
    assert ", 80" in _plan(found)
    assert {tuple(r) for r in found.collect()} == {("a", 4000, 2000, 2000, 0, 0, 500, 0.5), ("b", 0, 0, 0, 3990, 10, 0, None)}


def test_strata_and_blocks_lie_in_partitions_that_follow_rows(spark, monkeypatch):
    rows = predictions(spark, "/root/testdata/sf0.001")
    usual = I.stratum_units(rows, FIRST_DEVICE, SECOND_DEVICE).collect()
    monkeypatch.setattr(I, "PART_ROWS", 110)
    monkeypatch.setattr(session, "PART_ROWS", 100)
    units = I.stratum_units(rows, FIRST_DEVICE, SECOND_DEVICE)
    assert f", {-(-rows.count() // 10)}" in _plan(units)
    assert [(*r[:4], round(r["value"], 12)) for r in sorted(units.collect())] == [(*r[:4], round(r["value"], 12)) for r in sorted(usual)]
    marked, tree = T.grow(units, [])
    assert T.laid_out(marked, tree).rdd.getNumPartitions() == -(-len(usual) // 100)
