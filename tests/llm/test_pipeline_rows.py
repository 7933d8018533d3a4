"""The pipeline keeps rows whatever their ids and columns are called; run() against its stages one by one."""

from collections import Counter

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_encode_keeps_null_and_repeated_ids(spark, folder):
    docs = spark.createDataFrame([(None, "clean"), (3, "clean"), (3, None), (None, "")], "doc_id long, text string").repartition(2)
    out = P.encode(spark, docs, folder).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"] > 0, r["round_trip"]) for r in out) == [(-1, False, True), (-1, True, True), (3, False, True), (3, True, True)]


def test_columns_named_like_inner_ones_come_through(spark, folder):
    kinds = "doc_id long, text string, _row string, _row_ int, row long, rank long, digest string, items int, hits string, component long, predicted int"
    rows = [(i, t, f"r{i}", i, 5, None, "d", 1, "h", 2, 0) for i, t in enumerate(["a b c", "a  b c", "d e f g h i", "d e f g h i j", "x", None, "zero one two three four five six seven eight nine ten eleven"])]
    docs = spark.createDataFrame(rows, kinds).repartition(3)
    want = {"toxicity": set(range(7)), "exact_dedup": {0, 2, 3, 4, 5, 6}, "ngram_join": set(range(7)) - {1}, "decontamination": set(range(6))}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema["rank"].dataType == docs.schema["rank"].dataType
        got = plain(out.collect())
        assert got == Counter(rows[i] for i in want[name]), name


def test_empty_tables_and_very_long_texts(spark, folder):
    none = spark.createDataFrame([], "doc_id long, text string, n long")
    long = spark.createDataFrame([(1, "word and other words " * 60_000, 1), (2, "x" * 400_000, 2)], "doc_id long, text string, n long")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, none, folder).collect() == []
        assert plain(stage(spark, long, folder).collect()) == plain(long.collect()), name


def test_run_is_its_stages_in_order(spark, folder, tmp_path):
    texts = [f"some words of text number {i} and {i * 7} more {i % 3}" for i in range(30)] + ["some words of text number 1 and 7 more 1", "zero one two three four five six seven eight nine ten eleven", None]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs, str(tmp_path)).schema)
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) and len(got) > 5
