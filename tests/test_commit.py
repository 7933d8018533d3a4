"""Two-phase commit: a crash at any step leaves nothing committed, nothing is run twice, and the gate scores once."""

import pytest
from pyspark.sql import functions as F

from dyadlab.operators import cohort as C
from dyadlab.operators import gates as V
from dyadlab.sources import commit as W
from dyadlab.sources.sinks import AlreadyWritten, exists


class Crash(RuntimeError):
    pass


def crash(*_args, **_kwargs):
    raise Crash


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "x"), (2, None)], "b int, a string")


def test_tables_and_record_appear_together_once(spark, df, tmp_path):
    target = str(tmp_path / "out")
    record = W.publish(spark, {"one": df, "none": df.limit(0)}, target, {"status": "DONE"})
    assert {(r["table_name"], r["rows"], r["status"]) for r in record.collect()} == {("one", 2, "DONE"), ("none", 0, "DONE")}
    assert W.read_published(spark, target, "one").count() == 2 and not exists(spark, W.staging_path(target))
    with pytest.raises(AlreadyWritten):
        W.publish(spark, {"one": df}, target, {})
    assert not W.discard(spark, target) and exists(spark, target)  # a committed target is never discarded


@pytest.mark.parametrize("step", ["table_ledger", "_rename", "verify", "table"])
def test_a_crash_leaves_nothing_committed_and_blocks_until_reviewed(spark, df, tmp_path, monkeypatch, step):
    target = str(tmp_path / "out")
    verify, tables = None, {"one": df}
    with monkeypatch.context() as m:
        if step == "verify":
            verify = crash
        elif step == "table":
            tables["two"] = df.withColumn("c", F.raise_error(F.lit("boom")).cast("int"))
        else:
            m.setattr(W, step, crash)
        with pytest.raises(Exception):
            W.publish(spark, tables, target, {}, verify)
    assert not exists(spark, target) and exists(spark, W.staging_path(target))
    with pytest.raises(W.PartialRun):
        W.publish(spark, {"one": df}, target, {})
    assert W.discard(spark, target)
    assert W.publish(spark, {"one": df}, target, {}).count() == 1


def test_two_runs_at_once(spark, df, tmp_path):
    target = str(tmp_path / "out")
    W._claim(spark, target)
    with pytest.raises(W.PartialRun):
        W._claim(spark, target)


def test_changed_files_are_noticed(spark, df, tmp_path):
    target = str(tmp_path / "out")
    W.publish(spark, {"one": df}, target, {})
    df.withColumn("b", F.col("b") + 1).write.mode("overwrite").parquet(f"{target}/one")
    with pytest.raises(W.VerificationFailed):
        W.read_published(spark, target, "one")


@pytest.fixture()
def released(spark, tmp_path):
    manifest = spark.createDataFrame([(u, C.HOLDOUT if u % 2 else C.DEVELOPMENT) for u in range(6)], "unit_id int, partition string")
    rows = spark.createDataFrame([(u, s, float(u)) for u in range(6) for s in (1, 2)], "unit_id int, side int, x double")
    gate = V.Gate(str(tmp_path / "release"), C.content_hash(manifest, ["unit_id", "partition"]).first()["content_hash"])
    gate.release(spark, spark.createDataFrame([("all", True)], "check string, passed boolean"), {"rows": rows})
    return gate, manifest, rows, str(tmp_path / "scored")


def scored(rows):
    return rows.withColumn("endpoint", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("prob", F.col("x") / 10)


def test_holdout_is_scored_once_behind_the_gate(spark, released):
    gate, manifest, rows, target = released
    record = gate.execute(rows, manifest, scored, target, {"rows": rows}, ["a", "b"]).first()
    assert (record["rows"], record["status"], record["execution_count"]) == (12, "EXECUTED", "1")
    assert {r["unit_id"] for r in W.read_published(spark, target, "predictions").collect()} == {1, 3, 5}
    with pytest.raises(AlreadyWritten):
        gate.execute(rows, manifest, scored, target, {"rows": rows}, ["a", "b"])


@pytest.mark.parametrize("broken", [
    lambda p: p.filter("NOT (unit_id = 3 AND side = 1 AND endpoint = 'a')"), lambda p: p.unionByName(p.filter("unit_id = 3")), lambda p: p.filter("endpoint = 'a'"),
    lambda p: p.withColumn("endpoint", F.concat("endpoint", F.lit("x"))), lambda p: p.limit(0), lambda p: p.withColumn("side", F.lit(1)),
])
def test_predictions_that_do_not_cover_the_holdout_are_not_committed(spark, released, broken):
    gate, manifest, rows, target = released
    with pytest.raises(V.AccessDenied, match="cover"):
        gate.execute(rows, manifest, lambda r: broken(scored(r)), target, {"rows": rows}, ["a", "b"])
    assert not exists(spark, target)
    with pytest.raises(W.PartialRun):
        gate.execute(rows, manifest, scored, target, {"rows": rows}, ["a", "b"])


def test_a_unit_without_both_sides_stops_the_run(spark, released):
    gate, manifest, rows, target = released
    short = rows.filter("NOT (unit_id = 5 AND side = 2)")
    with pytest.raises(V.AccessDenied):
        gate.execute(short, manifest, scored, target, {"rows": short}, ["a", "b"])
    with pytest.raises(V.AccessDenied, match="one row a side"):
        V._require_both_sides(short)
    assert not exists(spark, target) and not exists(spark, W.staging_path(target))
