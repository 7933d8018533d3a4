"""License scan by diagonal voting: k-gram hashes joined to template places, votes per diagonal, spans verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}  # fixed values of the task
TEMPLATES = {  # longer wordings that are worth a label even when a few words differ
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TELLING = {  # runs of a template's words that tell versions and variants apart: a span must hold each unbroken
    "this work is licensed under the gnu general public license version 3": ["gnu general public license version 3"],
    "licensed under the apache license version 2 0": ["apache license version 2 0"],
    "licensed under cc by nc 4 0": ["cc by nc 4 0"],
    "licensed under cc by sa 4 0": ["cc by sa 4 0"],
    "released under the mit license": ["mit license"],
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ["person obtaining a copy of this software"],
    "redistribution and use in source and binary forms with or without modification are permitted": ["source and binary forms", "with or without modification"],
    "this source code form is subject to the terms of the mozilla public license": ["mozilla public license"],
    "this is free and unencumbered software released into the public domain": ["unencumbered software", "public domain"],
}
PHRASE_GRAM, TEMPLATE_GRAM = 2, 3
NEAR = 2  # diagonals that differ by at most so many words belong to one span
VOTES = 0.5  # part of a template's k-grams, each counted once, that makes a span a candidate; its words decide
AGREE = 0.75  # part of a template's words that its span must hold in their order
REACH = max(len(t.split()) for t in TEMPLATES) + NEAR  # words on each side of a hit that its spans can hold


def _templates(spark: SparkSession) -> DataFrame:
    lines = [(t, text, label, base, k, TELLING.get(text, [])) for t, (text, label, base, k) in enumerate([(p, l, True, PHRASE_GRAM) for p, l in PHRASES.items()] + [(p, l, False, TEMPLATE_GRAM) for p, l in TEMPLATES.items()])]
    table = spark.createDataFrame(lines, "template int, text string, label string, base boolean, gram int, telling array<string>")
    words = table.withColumn("words", F.split("text", " "))
    places = words.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("gram"))))
    grams = reduce(lambda rest, k: F.when(F.col("gram") == k, _gram(F.col("words"), F.col("place"), k)).otherwise(rest), (PHRASE_GRAM, TEMPLATE_GRAM), F.lit(None).cast("long"))
    return places.select("template", "label", "base", "gram", "place", F.col("words").alias("wording"), "telling", (F.size("words") - F.col("gram") + 1).alias("grams"), F.size("words").alias("length"), grams.alias("hash"))


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _aligned(words: Column, wording: Column) -> Column:
    """How many words of ``wording`` stand in ``words`` in the same order, each used once (longest common subsequence)."""

    def row(old: Column, word: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            before = lambda a: F.when(j > 0, F.get(a, j - 1)).otherwise(0)
            return F.array_append(new, F.when(F.get(wording, j) == word, before(old) + 1).otherwise(F.greatest(F.get(old, j), before(new))))

        return F.aggregate(F.sequence(F.lit(0), F.size(wording) - 1), F.array().cast("array<int>"), cell)

    return F.aggregate(words, F.array_repeat(F.lit(0), F.size(wording)), row, lambda last: F.element_at(last, -1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One line per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling word 2-gram and 3-gram is hashed and joined to the template places that hold it. Hits vote for their
    diagonal (place in the text less place in the template). For the fixed phrases a diagonal with all grams is an
    occurrence; counts and first and last starts come from these. For longer templates, a span whose diagonals within NEAR
    words hold VOTES of the template's grams, each counted once, is a candidate. It holds if its words, read around the
    hits, contain AGREE of the template's words in order and every telling run unbroken. ``score`` is the best such part
    of any held span (1 for a fixed phrase), 0 without one. Grams that no template has are dropped in the same projection
    that hashes them, which leaves a few lines per document to shuffle. Null texts have no words. Every row gets
    a line of its own, also where keys repeat or are null: votes are counted by a number of the row.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    wanted = [r.hash for r in templates.select("hash").distinct().collect()]  # a fixed list, not data
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))

    def hits(k: int) -> Column:
        hashed = F.transform("words", lambda w, i: F.struct(F.xxhash64(F.lit(k), w, *[F.get(F.col("words"), i + j) for j in range(1, k)]).alias("hash"), i.alias("at")))
        found = F.filter(hashed, lambda x: x["hash"].isin(wanted))
        start = lambda x: F.greatest(x["at"] - REACH, F.lit(0))
        around = lambda x: F.slice(F.col("words"), start(x) + 1, F.lit(2 * REACH + k)) if k == TEMPLATE_GRAM else F.lit(None).cast("array<string>")
        return F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), x["at"].alias("at"), start(x).alias("start"), around(x).alias("around")))

    counted = worded.select("row", "key", F.size("words").cast("long").alias("n_words"), F.concat(*[hits(k) for k in (PHRASE_GRAM, TEMPLATE_GRAM)]).alias("hits"))
    votes = counted.select("row", "key", "n_words", F.explode_outer("hits").alias("hit")).select("row", "key", "n_words", "hit.hash", "hit.at", "hit.start", "hit.around")
    joined = votes.join(F.broadcast(templates), "hash", "left")  # a hundred lines, fixed in this module
    joined = joined.withColumn("diagonal", F.col("at") - F.col("place"))
    first = F.greatest(F.col("diagonal") - NEAR, F.col("start"))
    joined = joined.withColumn("span", F.when(~F.col("base"), F.slice("around", first - F.col("start") + 1, F.col("diagonal") + F.col("length") + NEAR - first)))
    told = F.forall("telling", lambda run: F.concat(F.lit(" "), F.array_join("span", " "), F.lit(" ")).contains(F.concat(F.lit(" "), run, F.lit(" "))))
    joined = joined.withColumn("agreed", F.when(F.col("span").isNotNull() & told, _aligned(F.col("span"), F.col("wording")) / F.col("length")))
    diagonals = joined.groupBy("row", "key", "n_words", "template", "label", "base", "grams", "diagonal").agg(
        F.count("place").alias("votes"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("places"), F.max("agreed").alias("agreed"))
    exact = F.col("base") & (F.col("votes") == F.col("grams")) & (F.col("diagonal") >= 0)
    near = F.transform(F.sequence(F.lit(-NEAR), F.lit(NEAR)), lambda d: d + F.col("diagonal"))
    # each diagonal offers its votes to the neighbours; a span is where the sum of a neighbourhood is enough
    spread = diagonals.withColumn("centre", F.explode_outer(F.when(~F.col("base"), near).otherwise(F.array("diagonal"))))
    spans = spread.groupBy("row", "key", "n_words", "template", "label", "base", "grams", "centre").agg(
        F.bit_count(F.bit_or("places")).alias("votes"), F.max("agreed").alias("agreed"), F.max(F.when(F.col("centre") == F.col("diagonal"), F.struct(exact.alias("exact"))))["exact"].alias("exact"))
    base = F.coalesce(F.col("exact"), F.lit(False))
    held = base | (~F.col("base") & (F.col("votes") >= VOTES * F.col("grams")) & (F.col("agreed") >= AGREE))
    names = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")  # noqa: E731  few labels exist
    by_row = spans.groupBy("row").agg(
        F.first("key").alias(key),
        F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("centre"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("centre"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(held).alias("labels"), F.coalesce(F.max(F.when(held, F.when(base, F.lit(1.0)).otherwise(F.col("agreed")))), F.lit(0.0)).alias("score"))
    return by_row.drop("row")
