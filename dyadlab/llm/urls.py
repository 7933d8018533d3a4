"""URL filters: fixed host and path rules, and token combinations mined with FP-growth from labelled URLs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadlab.session import cut

ALLOW, BLOCK = "allow", "block"
RULES = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]  # fixed values of the task
LABEL = "verdict="  # prefix of the item that carries a label


@dataclass(frozen=True)
class Mining:
    support: float = 0.001  # least part of the labelled URLs that hold a combination
    confidence: float = 0.8  # least part of these that are to be blocked
    lift: float = 1.2  # over the blocked part of all labelled URLs


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased; empty without ``://`` or for null."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # longer ones overwrite
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct items of a URL: the labels of its host and the words of its path, numbers as one item."""
    hosts = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    paths = F.transform(F.split(_lower(path), r"[^a-z0-9]+"), lambda t: F.concat(F.lit("p:"), F.when(t.rlike("^[0-9]+$"), F.lit("#")).otherwise(t)))
    return F.array_distinct(F.filter(F.concat(hosts, paths), lambda t: ~t.isin("h:", "p:")))


def tested(rules: list[tuple[str, str]] = RULES) -> list[str]:
    """The items that the fixed rules test: the labels of their hosts and the words of their paths."""
    out = set()
    for text, _ in rules:
        name, _, rest = text.lower().partition("/")
        out |= {"h:" + t for t in name.split(".")} | {"p:" + ("#" if t.isdigit() else t) for t in re.split("[^a-z0-9]+", rest)}
    return sorted(out - {"h:", "p:"})


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Blocking rules (rule_id, items, confidence, support) from ``items`` and ``block`` (0/1) of labelled URLs.

    FP-growth finds combinations of at least ``support``; those that end in the blocking label with enough confidence and
    lift stay, unless a part of the combination alone has at least the same confidence. Without labelled rows, or with
    one label only, there are no rules.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, items array<string>, confidence double, support double")
    labelled = cut(labelled.filter(F.col("block").isNotNull() & (F.size("items") > 0)).select(F.array_append("items", F.concat(F.lit(LABEL), F.col("block").cast("string"))).alias("items"), "block"))
    counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("block").alias("bad")).first()
    if not counts.n or not counts.bad or counts.bad == counts.n:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=how.support, minConfidence=how.confidence).fit(labelled)
    base = counts.bad / counts.n
    rules = cut(model.associationRules.filter((F.col("consequent")[0] == LABEL + "1") & (F.col("confidence") >= base * how.lift)).select(F.array_sort("antecedent").alias("items"), "confidence", "support"))
    # a rule is redundant if it holds all items of a shorter rule of no less confidence
    shorter = rules.select(F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    one = rules.select(F.explode("items").alias("item"), "items", "confidence")
    first = shorter.withColumn("item", F.col("part")[0])
    redundant = one.join(first, "item").filter((F.size("part") < F.size("items")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0)).select("items").distinct()
    kept = rules.join(redundant, "items", "left_anti")
    return cut(kept.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines (key, rule_id, confidence) of the best mined rule that each row of ``urls`` (key, items) satisfies.

    Inverted index: each rule is filed under its rarest item among the rules' URLs; a URL probes it with its own items
    and the few rules found are checked whole.
    """
    probes = urls.select("key", "items", F.explode("items").alias("item"))
    used = rules.select(F.explode("items").alias("item")).distinct()
    rarity = probes.join(used, "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))  # partial counts before the shuffle
    filed = rules.select("rule_id", F.col("items").alias("rule_items"), "confidence", F.explode("items").alias("item")).join(rarity, "item", "left")
    index = filed.groupBy("rule_id", "rule_items", "confidence").agg(F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item"))
    found = probes.join(index, "item").filter(F.size(F.array_except("rule_items", "items")) == 0)
    return found.groupBy("key").agg(F.max(F.struct("confidence", "rule_id")).alias("best")).select("key", "best.rule_id", "best.confidence")


def judge(pages: DataFrame, labels: DataFrame | None = None, key: str = "page_id", url: str = "url", how: Mining = Mining()) -> DataFrame:
    """One line per row of ``pages``: key, host, path, rule, verdict, mined_rule, mined_confidence.

    Fixed rules decide where one fits (the longest wins). The rest is judged by mined combinations, learnt from
    ``labels`` (key, block 0/1) or, without these, from the URLs that the fixed rules decide; a URL that fits no mined
    rule is allowed. In the latter case the items that the fixed rules test are no evidence, as they are what made the
    labels: rules are mined from the other items. Null URLs have empty parts, no items and are allowed. Repeated keys are judged row by row.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"))
    parts = cut(parts.withColumns({"rule": rule, "ruled": verdict, "items": tokens(F.col("host"), F.col("path"))}))
    if labels is None:
        parts = parts.withColumn("items", F.array_except("items", F.array(*[F.lit(t) for t in tested()])))
    distinct = parts.filter("ruled IS NULL").select("items").distinct().withColumn("key", F.xxhash64("items"))
    if labels is None:
        labelled = parts.filter("ruled IS NOT NULL").select("items", (F.col("ruled") == BLOCK).cast("int").alias("block"))
    else:
        labelled = parts.join(labels.select(F.col(key).alias("key"), F.col("block").cast("int").alias("block")), "key").select("items", "block")
    rules = mine(labelled, how)
    best = match(distinct, rules).withColumnsRenamed({"key": "item_key", "rule_id": "mined_rule", "confidence": "mined_confidence"})
    out = parts.withColumn("item_key", F.when(F.col("ruled").isNull(), F.xxhash64("items"))).join(best, "item_key", "left")
    said = F.coalesce(F.col("ruled"), F.when(F.col("mined_rule").isNotNull(), F.lit(BLOCK)), F.lit(ALLOW))
    return out.select(F.col("key").alias(key), "host", "path", "rule", said.alias("verdict"), "mined_rule", "mined_confidence")
