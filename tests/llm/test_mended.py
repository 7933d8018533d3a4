"""Defects of the numbered operators that were mended, each with the case that showed it."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

KINDS = "conv_id long, turn long, role string, text string"


def test_loss_text_is_read_by_the_mask(spark):
    from dyadlab.llm import chat

    said = ["\ufeffb<c\\l", "</turn>\\b", "ü😀", "", "\ufeff"]
    rows = [(1, i, "assistant" if i % 2 == 0 else "user", t) for i, t in enumerate(said)] + [(2, 0, "user", "x")]
    chats = chat.format_chats(spark.createDataFrame(rows, KINDS))
    loss = "".join(said[0::2])
    got = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())
    for broken in (lambda m: F.struct((m["skip"] + 3).alias("skip"), m["chars"].alias("chars"), m["loss"].alias("loss")), lambda m: F.struct(m["skip"].alias("skip"), F.lit(1).alias("chars"), m["loss"].alias("loss"))):
        wrong = chats.withColumn("loss_mask", F.transform("loss_mask", broken)).filter("conv_id = 1")
        assert chat.read_back(wrong).first().loss_sha256 != got[1].loss_sha256
    assert chat.read_back(chats.limit(0)).count() == 0


def test_license_rows_with_repeated_and_null_keys(spark):
    from dyadlab.llm import licenses

    rows = [(1, "mit license"), (1, "mit license"), (2, "mit license"), (2, "apache license x"), (None, "cc by"), (None, None), (3, None)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == Counter([(1, 2, 1, "mit"), (1, 2, 1, "mit"), (2, 2, 1, "mit"), (2, 3, 1, "apache"), (None, 2, 1, "cc-by"), (None, 0, 0, ""), (3, 0, 0, "")])


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    from dyadlab.llm.exact_dedup import DigestIndex, deduplicate

    rows = [(None, "only null"), (None, "only  null"), (4, "twice"), (4, "twice"), (None, "named"), (9, "named"), (8, "named")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for edges in ([], [8]):
        index = DigestIndex(spark, buckets=4)
        got = deduplicate(docs, index, edges=edges).collect()
        assert Counter((r.keep_id, r.group_size) for r in got if r.kept) == Counter([(None, 2), (4, 2), (8, 3)])
        assert {r.doc_id for r in got if r.keep_id == 8 and r.kept} == {8} and len(got) == len(rows)
        index.drop()


def test_exact_dedup_of_a_named_batch_can_be_repeated(spark):
    from dyadlab.llm.exact_dedup import DigestIndex, deduplicate

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (5, "b"), (6, "c")], "doc_id long, text string")
    index = DigestIndex(spark, buckets=4)
    run = lambda: sorted((r.doc_id, r.keep_id, r.kept) for r in deduplicate(docs, index, edges=[4], batch="monday").collect())
    first = run()
    assert run() == first and [d for d, _, kept in first if kept] == [1, 3, 6]
    assert index.read().count() == 3
    other = deduplicate(docs, index, batch="tuesday").collect()
    assert not any(r.kept for r in other) and index.read().count() == 3
    index.drop()
