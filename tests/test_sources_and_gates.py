import hashlib

import pytest
from pyspark.sql import functions as F

from dyadlab.operators import cohort as C
from dyadlab.operators import gates as V
from dyadlab.sources import files as D
from dyadlab.sources import sinks as W
from dyadlab.sources import tables as T


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "deep" / "er").mkdir(parents=True)
    for name, text in (("labels.csv", "a,b\n1,bv\n"), ("deep/labels.csv", "x"), ("deep/er/photo.JPG", "pixels"), ("deep/noext", "n")):
        (root / name).write_text(text)
    return root


def test_inventory_digests_and_location(spark, tree):
    files = D.inventory(spark, str(tree))
    got = {r["relative_path"]: (r["stem"], r["extension"], r["bytes"]) for r in files.collect()}
    assert got == {"labels.csv": ("labels", ".csv", 9), "deep/labels.csv": ("labels", ".csv", 1), "deep/er/photo.JPG": ("photo", ".jpg", 6), "deep/noext": ("noext", "", 1)}
    assert "content" not in D.inventory(spark, str(tree))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    digests = {r["relative_path"]: r["sha256"] for r in D.file_digests(spark, str(tree), [".jpg"]).collect()}
    assert digests == {"deep/er/photo.JPG": hashlib.sha256(b"pixels").hexdigest()}
    assert D.shallowest(files, "labels.csv") == "labels.csv"
    with pytest.raises(FileNotFoundError):
        D.shallowest(files, "none.csv")
    (tree / "deep" / "noext2").mkdir()
    with pytest.raises(ValueError):
        D.shallowest(files.filter("relative_path <> 'labels.csv'").union(files.filter("relative_path = 'deep/labels.csv'")), "labels.csv")


def test_ledger_round_trip(spark, tree, tmp_path):
    good = hashlib.sha256(b"pixels").hexdigest()
    ledger = tmp_path / "SUMS"
    ledger.write_text(f"{good.upper()}  deep/er/photo.JPG\n{'0' * 64} *deep/noext\n\n")
    expected = D.read_ledger(spark, str(ledger))
    assert {r["path"] for r in expected.collect()} == {"deep/er/photo.JPG", "deep/noext"}
    actual = D.file_digests(spark, str(tree)).select(F.col("relative_path").alias("path"), "sha256")
    match = {r["path"]: r["matches"] for r in D.checksum_match(actual, expected).collect()}
    assert match == {"deep/er/photo.JPG": True, "deep/noext": False, "labels.csv": None, "deep/labels.csv": None}
    assert {r["path"] for r in D.ledger_differences(actual, expected).collect()} == {"deep/noext", "labels.csv", "deep/labels.csv"}
    ledger.write_text(f"{good}  a\n{good}  a\n")
    with pytest.raises(ValueError, match="duplicate"):
        D.read_ledger(spark, str(ledger))
    ledger.write_text("short  a\n")
    with pytest.raises(ValueError, match="malformed"):
        D.read_ledger(spark, str(ledger))


def test_text_table_keeps_codes(spark, tree):
    df = T.read_text_table(spark, str(tree / "labels.csv"), ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [("1", "bv")]


def test_sinks_write_once_and_keep_headers(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    W.write_tables({"empty": df.filter("b > 5").coalesce(1)}, root, "csv")
    text = "".join(p.read_text() for p in (tmp_path / "out" / "empty").glob("*.csv"))
    assert text.strip() == "b,a"
    W.write_tables({"t": df}, root, "json")
    assert "".join(p.read_text() for p in (tmp_path / "out" / "t").glob("*.json")).strip() == '{"a":"x","b":1}'
    with pytest.raises(W.AlreadyWritten):
        W.write_tables({"new": df, "t": df}, root)
    assert not (tmp_path / "out" / "new").exists()  # nothing was written before the conflict was seen


def test_table_ledger_is_order_free_and_sees_changes(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    one, two = W.table_ledger({"t": df}), W.table_ledger({"t": df.repartition(5).orderBy(F.desc("id"))})
    assert W.ledger_mismatches(one, two).isEmpty()
    changed = W.table_ledger({"t": df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v")))})
    assert W.ledger_mismatches(changed, one).count() == 1


def test_contracts(spark):
    rows = spark.createDataFrame([("e", 1, 1), ("e", 1, 2), ("e", 2, 1), ("e", 2, 3)], "endpoint string, unit_id int, side int")
    with pytest.raises(T.ContractError):
        T.require_predictions(rows)
    assert T.require_predictions(rows.filter("unit_id = 1")).count() == 2
    twice = spark.createDataFrame([(1, "development"), (1, "final_holdout"), (2, "development")], "unit_id int, partition string")
    with pytest.raises(T.ContractError):
        T.require_manifest(twice, [C.DEVELOPMENT, C.HOLDOUT])
    fine = twice.filter("partition = 'development'")
    assert T.require_manifest(fine, [C.DEVELOPMENT, C.HOLDOUT], {"development": 2}) is fine
    with pytest.raises(T.ContractError):
        T.require_manifest(fine, [C.DEVELOPMENT, C.HOLDOUT], {"development": 3})
    with pytest.raises(T.ContractError, match="header"):
        T.require_manifest(fine.withColumn("x", F.lit(1)), [C.DEVELOPMENT, C.HOLDOUT])
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, float("nan")])], "unit_id int, embedding array<double>")
    with pytest.raises(T.ContractError):
        T.require_embeddings(vectors, 2)
    assert T.require_embeddings(vectors.filter("unit_id = 1"), 2).count() == 1
    with pytest.raises(Exception, match="no vector"):
        T.attach_vectors(spark.createDataFrame([(9,)], "unit_id int"), vectors, ["unit_id"]).collect()


def test_gate(spark, tmp_path):
    manifest = spark.createDataFrame([(1, "development"), (2, "final_holdout"), (3, "development")], "unit_id int, partition string")
    rows = spark.createDataFrame([(u, s) for u in (1, 2, 3) for s in (1, 2)], "unit_id int, side int")
    frozen = C.content_hash(manifest, ["unit_id", "partition"]).first()["content_hash"]
    gate = V.Gate(str(tmp_path / "release"), frozen)
    assert {r["unit_id"] for r in gate.read_stage(rows, manifest, C.DEVELOPMENT).collect()} == {1, 3}
    with pytest.raises(V.AccessDenied, match="not been released"):
        gate.read_stage(rows, manifest, C.HOLDOUT)
    failing = spark.createDataFrame([("coverage", True), ("leak", False)], "check string, passed boolean")
    with pytest.raises(V.AccessDenied, match="leak"):
        gate.release(spark, failing, {"rows": rows})
    with pytest.raises(V.AccessDenied):
        gate.release(spark, failing.limit(0), {"rows": rows})
    passing = failing.filter("passed")
    gate.release(spark, passing, {"rows": rows})
    assert {r["unit_id"] for r in gate.read_stage(rows, manifest, C.HOLDOUT, {"rows": rows}).collect()} == {2}
    with pytest.raises(V.AccessDenied, match="sealed"):
        gate.read_stage(rows, manifest, C.HOLDOUT)
    with pytest.raises(V.AccessDenied, match="sealed"):
        gate.read_stage(rows, manifest, C.HOLDOUT, {"rows": rows.filter("side = 1")})
    with pytest.raises(W.AlreadyWritten):
        gate.release(spark, passing, {"rows": rows})
    tampered = manifest.withColumn("partition", F.when(F.col("unit_id") == 3, "final_holdout").otherwise(F.col("partition")))
    with pytest.raises(V.AccessDenied, match="frozen"):
        gate.read_stage(rows, tampered, C.DEVELOPMENT)
    with pytest.raises(V.AccessDenied, match="no rows"):
        gate.read_stage(rows.filter("unit_id <> 3"), manifest, C.DEVELOPMENT)


def test_text_scan(spark):
    texts = spark.createDataFrame([(1, "x " * 5000 + 'api_key = "abcdefgh1234"'), (2, "AKIA" + "A" * 16), (3, "see /home/someone/file"), (4, "clean"), (5, 'token = "' + "0a" * 20 + '"')], "id int, text string")
    assert {tuple(r) for r in V.scan_text(texts, "id", "text").collect()} == {(1, "generic_secret_assignment"), (2, "aws_access_key"), (3, "absolute_user_path"), (5, "token_assignment")}


def test_stage_stream(spark, tmp_path):
    from dyadlab.streaming.stage import stage_stream, write_batches

    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "one.csv").write_text("unit_id,side\n1,1\n2,1\n")
    manifest = spark.createDataFrame([(1, "development"), (2, "final_holdout"), (3, "development")], "unit_id int, partition string")
    frozen = C.content_hash(manifest, ["unit_id", "partition"]).first()["content_hash"]
    gate = V.Gate(str(tmp_path / "release"), frozen)
    with pytest.raises(V.AccessDenied):
        stage_stream(spark, str(drop), ["unit_id", "side"], manifest, C.HOLDOUT, gate)
    target, state = str(tmp_path / "target"), str(tmp_path / "state")
    for text in (None, "unit_id,side\n3,2\n"):
        if text:
            (drop / "two.csv").write_text(text)
        stream = stage_stream(spark, str(drop), ["unit_id", "side"], manifest, C.DEVELOPMENT, gate)
        write_batches(stream, lambda batch: batch.withColumn("seen", F.lit(1)), target, state).awaitTermination(120)
    assert {(r["unit_id"], r["side"]) for r in spark.read.parquet(target).collect()} == {("1", "1"), ("3", "2")}
