"""Integrity audit of the order lines seen as a raw table of paired units with coded text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import audit as A
from dyadlab.operators.pairs import UNIT, missing_keys, pair_wide
from dyadlab.plans.registry import query, table
from dyadlab.plans.risk_queries import rounded

N = S.number
LABELS, QUALITIES, GRADES = ["y1", "y2", "y3"], ["q1", "q2"], ["grade_a", "grade_b"]
DOMAINS = {"q1": (1, 2), "q2": (1, 2), "anatomy": (1, 2), "y1": (0, 1), "y2": (0, 1), "y3": (0, 1), "grade_a": range(5), "grade_b": range(5), "sex": (1, 2), "side": (1, 2)}
ROW_KEY = ["unit_id", "side", "l_partkey", "l_suppkey", "price"]


def source(spark, folder):
    key, line, text = F.col("l_orderkey"), F.col("l_linenumber"), lambda c: c.cast("int").cast("string")
    qty, disc, tax, price = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    return table(spark, folder, "lineitem").select(
        key.alias("unit_id"), line.alias("side"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("device"),
        F.when(F.col("l_returnflag") == "R", "2").otherwise("1").alias("q1"),
        F.when(tax >= N(0.075), "0").when(tax >= N(0.055), "2").otherwise("1").alias("q2"),
        F.when(qty == 13, "bv").when(qty == 17, None).when(qty > 30, "2").otherwise("1").alias("anatomy"),
        F.when(disc >= N(0.075), "1").otherwise("0").alias("y1"),
        F.when(qty >= 38, "1").when(qty == 20, None).otherwise("0").alias("y2"),
        F.when(price >= N(60000), "1").when((qty == 5) & (tax < N(0.015)), "9").otherwise("0").alias("y3"),
        text(F.floor(qty / N(10.5))).alias("grade_a"),
        F.when(disc >= N(0.095), "5").otherwise(text(F.floor(disc * N(40)))).alias("grade_b"),
        F.when(key % 23 == 0, None).when((line == 2) & (key % 17 == 0), text(key % 70 + 21)).otherwise(text(key % 70 + 20)).alias("age"),
        F.when((line == 2) & (key % 19 == 0), "3").when(key % 2 == 0, "1").otherwise("2").alias("sex"),
        F.concat(F.lit("img"), key.cast("string"), line.cast("string")).alias("row_id"),
        "l_partkey", "l_suppkey", price.alias("price"),
    )


SRC = """WITH src AS (SELECT l_orderkey AS unit_id, l_linenumber AS side, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS device,
  CASE WHEN l_returnflag = 'R' THEN '2' ELSE '1' END AS q1, CASE WHEN l_tax >= 0.075 THEN '0' WHEN l_tax >= 0.055 THEN '2' ELSE '1' END AS q2,
  CASE WHEN l_quantity = 13 THEN 'bv' WHEN l_quantity = 17 THEN NULL WHEN l_quantity > 30 THEN '2' ELSE '1' END AS anatomy,
  CASE WHEN l_discount >= 0.075 THEN '1' ELSE '0' END AS y1, CASE WHEN l_quantity >= 38 THEN '1' WHEN l_quantity = 20 THEN NULL ELSE '0' END AS y2,
  CASE WHEN l_extendedprice >= 60000 THEN '1' WHEN l_quantity = 5 AND l_tax < 0.015 THEN '9' ELSE '0' END AS y3,
  CAST(CAST(FLOOR(l_quantity / 10.5) AS INTEGER) AS VARCHAR) AS grade_a,
  CASE WHEN l_discount >= 0.095 THEN '5' ELSE CAST(CAST(FLOOR(l_discount * 40) AS INTEGER) AS VARCHAR) END AS grade_b,
  CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_linenumber = 2 AND l_orderkey % 17 = 0 THEN CAST(l_orderkey % 70 + 21 AS VARCHAR) ELSE CAST(l_orderkey % 70 + 20 AS VARCHAR) END AS age,
  CASE WHEN l_linenumber = 2 AND l_orderkey % 19 = 0 THEN '3' WHEN l_orderkey % 2 = 0 THEN '1' ELSE '2' END AS sex,
  'img' || l_orderkey || l_linenumber AS row_id, l_partkey, l_suppkey, l_extendedprice AS price FROM lineitem)
"""
CODED = ["anatomy", "age", "sex", *LABELS, *QUALITIES, *GRADES]


def source_pairs(spark, folder):
    """Clean pairs of lines 1 and 2, codes as numbers (unreadable codes are null)."""
    rows = source(spark, folder).filter(F.col("side").isin(1, 2))
    coded = rows.select(UNIT, "side", F.when(F.col("device") == "A", 1).otherwise(2).alias("device"), *[S.lenient_number(F.col(c)).alias(c) for c in CODED])
    return pair_wide(coded, ["device", *CODED]).withColumns({f"device_{s}": F.when(F.col(f"device_{s}") == 1, "A").otherwise("B") for s in "rl"})


PAIR = SRC + """, two AS (SELECT * FROM src WHERE side IN (1, 2)), ok AS (SELECT unit_id FROM two GROUP BY unit_id HAVING COUNT(*) = 2 AND COUNT(DISTINCT side) = 2),
pr AS (SELECT r.unit_id, r.device AS device_r, l.device AS device_l, """ + ", ".join(
    f"TRY_CAST(r.{c} AS DOUBLE) AS {c}_r, TRY_CAST(l.{c} AS DOUBLE) AS {c}_l" for c in CODED) + """
  FROM two r JOIN two l ON r.unit_id = l.unit_id AND r.side = 1 AND l.side = 2 JOIN ok ON ok.unit_id = r.unit_id)
"""


def lines_sql(columns, rel="src", keep="", name="column_name"):
    return " UNION ALL ".join(f"SELECT {keep}'{c}' AS {name}, CAST({c} AS VARCHAR) AS raw FROM {rel}" for c in columns)


def good_sql(columns=DOMAINS):
    return " OR ".join(f"(column_name = '{c}' AND TRY_CAST(raw AS DOUBLE) IN ({', '.join(map(str, DOMAINS[c]))}))" for c in columns)


DOMAIN_SQL = SRC + ", u AS (" + lines_sql(DOMAINS) + f"), d AS (SELECT column_name, raw, COUNT(*) AS n, raw IS NOT NULL AND NOT COALESCE({good_sql()}, FALSE) AS bad FROM u GROUP BY column_name, raw) "


@query("domain_audit", DOMAIN_SQL + "SELECT column_name, raw AS unexpected_value, n AS count FROM d WHERE bad")
def domain_audit(spark, folder):
    return A.domain_audit(source(spark, folder), DOMAINS)


@query("code_summary", DOMAIN_SQL + """SELECT column_name, CAST(SUM(CASE WHEN raw IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS nonmissing, CAST(SUM(CASE WHEN raw IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing,
  CAST(SUM(CASE WHEN raw IS NOT NULL AND NOT bad THEN n ELSE 0 END) AS BIGINT) AS evaluable, CAST(SUM(CASE WHEN bad THEN n ELSE 0 END) AS BIGINT) AS unexpected,
  COALESCE(STRING_AGG(raw, '|' ORDER BY raw) FILTER (WHERE bad), '') AS unexpected_values FROM d GROUP BY column_name""")
def code_summary(spark, folder):
    return A.code_summary(source(spark, folder), DOMAINS)


@query("count_expectations", SRC + """, t AS (SELECT COUNT(*) AS r, COUNT(DISTINCT unit_id) AS u FROM src)
SELECT 'rows' AS quantity, r AS actual, CAST(60000 AS BIGINT) AS expected, r = 60000 AS matches FROM t UNION ALL SELECT 'units', u, CAST(15000 AS BIGINT), u = 15000 FROM t""")
def count_expectations(spark, folder):
    return A.count_expectations(source(spark, folder), UNIT, 60000, 15000)


MISSING_TABLES = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
                  "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"]}
KIND = {"doc_id": "bigint", "n_chars": "bigint", "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "value": "double", "conv_id": "bigint", "turn": "bigint", "page_id": "bigint", "item_id": "bigint"}


@query("missingness_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS percent_missing, COUNT(DISTINCT {c}) AS distinct_values, '{KIND.get(c, 'string')}' AS data_type FROM {t}"
    for t, cols in MISSING_TABLES.items() for c in cols))
def missingness_profile(spark, folder):
    out = None
    for name in MISSING_TABLES:
        part = A.missingness(table(spark, folder, name)).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query("source_missingness", SRC + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing, ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 6) AS percent_missing, COUNT(DISTINCT {c}) AS distinct_values FROM src" for c in [*CODED, "device", "row_id"]))
def source_missingness(spark, folder):
    return rounded(A.missingness(source(spark, folder).select(*CODED, "device", "row_id")).drop("data_type"), 6)


@query("duplicate_unit_sides", SRC + "SELECT unit_id, side, COUNT(*) AS row_count FROM src GROUP BY unit_id, side HAVING COUNT(*) > 1")
def duplicate_unit_sides(spark, folder):
    return A.duplicate_keys(source(spark, folder), ["unit_id", "side"])


@query("duplicate_rows", SRC + "SELECT * FROM (SELECT unit_id, side, device, q1, anatomy, price, COUNT(*) OVER (PARTITION BY unit_id, anatomy, device) AS row_count FROM src) WHERE row_count > 1")
def duplicate_rows(spark, folder):
    """Members of repeated (unit, anatomy code, device) keys; a null code is a key value."""
    rows = source(spark, folder).select("unit_id", "side", "device", "q1", "anatomy", "price")
    return A.duplicate_rows(rows, ["unit_id", "anatomy", "device"])


@query("full_row_duplicates", "SELECT lang, COUNT(*) AS repeated_rows, CAST(SUM(n) AS BIGINT) AS members FROM (SELECT lang, text, n_chars, COUNT(*) AS n FROM documents GROUP BY lang, text, n_chars HAVING COUNT(*) > 1) GROUP BY lang")
def full_row_duplicates(spark, folder):
    """Rows equal in everything but the id; long text is compared by digest."""
    keyed = table(spark, folder, "documents").select("lang", "n_chars", F.sha2("text", 256).alias("digest"))
    return A.duplicate_keys(keyed, ["lang", "n_chars", "digest"]).groupBy("lang").agg(F.count("*").alias("repeated_rows"), F.sum("row_count").alias("members"))


@query("duplicate_content_groups", """WITH g AS (SELECT SHA256(text) AS digest, COUNT(*) AS members, MIN('doc/' || doc_id || '.txt') AS first_member FROM documents GROUP BY 1 HAVING COUNT(*) > 1)
SELECT ROW_NUMBER() OVER (ORDER BY first_member) AS group_number, digest, members, first_member FROM g""")
def duplicate_content_groups(spark, folder):
    docs = table(spark, folder, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return A.duplicate_groups(docs, F.sha2("text", 256), "path")


STRUCTURE = SRC + """, g AS (SELECT unit_id, COUNT(*) AS rows, COUNT(*) FILTER (WHERE side = 1) AS right_rows, COUNT(*) FILTER (WHERE side = 2) AS left_rows,
  COUNT(*) FILTER (WHERE side NOT IN (1, 2)) AS invalid_rows, STRING_AGG(DISTINCT device, '|' ORDER BY device) AS devices, COUNT(DISTINCT device) AS dc FROM src GROUP BY unit_id),
us AS (SELECT unit_id, rows, right_rows, left_rows, invalid_rows, CAST((right_rows > 0) AS INTEGER) + CAST((left_rows > 0) AS INTEGER) AS valid_sides,
  CASE WHEN right_rows > 0 AND left_rows > 0 THEN 'R+L' WHEN right_rows > 0 THEN 'R-only' WHEN left_rows > 0 THEN 'L-only' ELSE 'none' END AS pattern,
  CAST(right_rows > 0 AND left_rows > 0 AS INTEGER) AS has_both, CAST(right_rows = 1 AND left_rows = 1 AND invalid_rows = 0 AS INTEGER) AS valid_pair,
  CAST(right_rows > 1 OR left_rows > 1 AS INTEGER) AS has_duplicate, devices, CAST(dc AS INTEGER) AS device_count FROM g)
"""


@query("unit_structure", STRUCTURE + "SELECT * FROM us")
def unit_structure(spark, folder):
    return A.unit_structure(source(spark, folder))


@query("cohort_structure", STRUCTURE + """SELECT COUNT(*) AS units, COUNT(*) FILTER (WHERE has_both = 1) AS with_both_sides, COUNT(*) FILTER (WHERE valid_pair = 1) AS valid_pairs,
  COUNT(*) FILTER (WHERE pattern = 'R-only') AS right_only, COUNT(*) FILTER (WHERE pattern = 'L-only') AS left_only, COUNT(*) FILTER (WHERE rows > 2) AS over_two_rows,
  COUNT(*) FILTER (WHERE has_duplicate = 1) AS with_duplicate_side, COUNT(*) FILTER (WHERE right_rows > 1) + COUNT(*) FILTER (WHERE left_rows > 1) AS duplicate_unit_sides,
  COUNT(*) FILTER (WHERE device_count > 1) AS on_several_devices FROM us""")
def cohort_structure(spark, folder):
    return A.cohort_structure(A.unit_structure(source(spark, folder)))


@query("device_membership", STRUCTURE + "SELECT devices AS membership, COUNT(*) AS units FROM us GROUP BY devices")
def device_membership(spark, folder):
    return A.device_membership(A.unit_structure(source(spark, folder)))


@query("several_device_units", STRUCTURE + "SELECT unit_id, rows, devices FROM us WHERE device_count > 1")
def several_device_units(spark, folder):
    return A.unit_structure(source(spark, folder)).filter("device_count > 1").select("unit_id", "rows", "devices")


ATTRIBUTES = ["age", "sex", "device", "anatomy"]


@query("within_unit_inconsistency", SRC + " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, COUNT(*) FILTER (WHERE v > 1) AS inconsistent_units, MAX(v) AS max_values FROM (SELECT unit_id, COUNT(DISTINCT COALESCE({c}, '~')) AS v FROM src GROUP BY unit_id)" for c in ATTRIBUTES))
def within_unit_inconsistency(spark, folder):
    return A.within_unit_inconsistency(source(spark, folder), ATTRIBUTES)


@query("event_inconsistency", " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, COUNT(*) FILTER (WHERE v > 1) AS inconsistent_units, MAX(v) AS max_values FROM (SELECT user_id, COUNT(DISTINCT {c}) AS v FROM events GROUP BY user_id)" for c in ("event_type", "props")))
def event_inconsistency(spark, folder):
    return A.within_unit_inconsistency(table(spark, folder, "events"), ["event_type", "props"], "user_id")


def label_sql(rel, labels, unit):
    return " UNION ALL ".join(f"""SELECT '{c}' AS label_name, COUNT(*) FILTER (WHERE v IN (0, 1)) AS evaluable, COUNT(*) FILTER (WHERE v = 1) AS positive, COUNT(*) FILTER (WHERE v = 0) AS negative,
  COUNT(*) FILTER (WHERE raw IS NULL) AS missing, COUNT(*) FILTER (WHERE raw IS NOT NULL AND COALESCE(v, 9) NOT IN (0, 1)) AS unexpected, COUNT(DISTINCT u) FILTER (WHERE v = 1) AS positive_units,
  ROUND(CAST(COUNT(*) FILTER (WHERE v = 1) AS DOUBLE) / COUNT(*) FILTER (WHERE v IN (0, 1)), 8) AS prevalence FROM (SELECT {unit} AS u, {c} AS raw, TRY_CAST({c} AS DOUBLE) AS v FROM {rel})""" for c in labels)


@query("label_summary", SRC + label_sql("src", LABELS, "unit_id"))
def label_summary(spark, folder):
    return rounded(A.label_summary(source(spark, folder), LABELS))


@query("document_label_summary", label_sql("labels", ["quality", "toxic"], "doc_id"))
def document_label_summary(spark, folder):
    return rounded(A.label_summary(table(spark, folder, "labels"), ["quality", "toxic"], "doc_id"))


NUM = SRC + ", num AS (SELECT " + ", ".join(f"CASE WHEN TRY_CAST({c} AS DOUBLE) IN (0, 1) THEN TRY_CAST({c} AS DOUBLE) END AS {c}" for c in LABELS) + ", " + ", ".join(
    f"CASE WHEN TRY_CAST({c} AS DOUBLE) IN (1, 2) THEN TRY_CAST({c} AS DOUBLE) END AS {c}" for c in QUALITIES) + ", device FROM src) "


@query("label_cooccurrence", NUM + " UNION ALL ".join(f"""SELECT '{a}' AS label_a, '{b}' AS label_b, COUNT(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS "both", COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND ({a} = 1 OR {b} = 1)) AS either,
  ROUND(CAST(COUNT(*) FILTER (WHERE {a} = 1 AND {b} = 1) AS DOUBLE) / COUNT(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND ({a} = 1 OR {b} = 1)), 8) AS jaccard FROM num""" for a in LABELS for b in LABELS))
def label_cooccurrence(spark, folder):
    return rounded(A.label_cooccurrence(source(spark, folder), LABELS))


PB = PAIR + ", pb AS (SELECT unit_id, device_r, device_l, " + ", ".join(
    f"CASE WHEN {c}_{s} IN ({', '.join(map(str, DOMAINS[c]))}) THEN {c}_{s} END AS {c}_{s}" for c in [*LABELS, *QUALITIES, *GRADES] for s in "rl") + " FROM pr) "
CARD = PB + ", num AS (SELECT " + ", ".join(f"CASE WHEN TRY_CAST({c} AS DOUBLE) IN (0, 1) THEN TRY_CAST({c} AS DOUBLE) END AS {c}" for c in LABELS) + """ FROM src),
x AS (SELECT 'row' AS level, CAST(y1 + y2 + y3 AS INTEGER) AS k FROM num UNION ALL SELECT 'pair_union', CAST(CASE WHEN y1_r + y1_l + y2_r + y2_l + y3_r + y3_l IS NOT NULL THEN GREATEST(y1_r, y1_l) + GREATEST(y2_r, y2_l) + GREATEST(y3_r, y3_l) END AS INTEGER) FROM pb)
"""


@query("label_cardinality", CARD + "SELECT level, k AS positive_labels, COUNT(*) AS count, CAST(SUM(COUNT(*)) OVER (PARTITION BY level) AS BIGINT) AS evaluable, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY level), 8) AS rate FROM x WHERE k IS NOT NULL GROUP BY level, k")
def label_cardinality(spark, folder):
    return rounded(A.label_cardinality(source(spark, folder), source_pairs(spark, folder), LABELS))


def quality_sql(keys=""):
    return f"""SELECT {keys}quality, COUNT(*) FILTER (WHERE v IN (1, 2)) AS evaluable, COUNT(*) FILTER (WHERE v = 1) AS normal, COUNT(*) FILTER (WHERE v = 2) AS abnormal, COUNT(*) FILTER (WHERE raw IS NULL) AS missing,
  COUNT(*) FILTER (WHERE raw IS NOT NULL AND COALESCE(v, 9) NOT IN (1, 2)) AS unexpected, ROUND(CAST(COUNT(*) FILTER (WHERE v = 2) AS DOUBLE) / COUNT(*) FILTER (WHERE v IN (1, 2)), 8) AS abnormal_rate FROM q GROUP BY {keys}quality"""


def quality_lines(columns):
    return ", q AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS v FROM (" + lines_sql(columns, keep="device, ", name="quality") + ")) "


@query("quality_summary", SRC + quality_lines([*QUALITIES, "anatomy"]) + quality_sql())
def quality_summary(spark, folder):
    return rounded(A.quality_summary(source(spark, folder), [*QUALITIES, "anatomy"]))


@query("device_quality", SRC + quality_lines(QUALITIES) + quality_sql("device, "))
def device_quality(spark, folder):
    return rounded(A.quality_summary(source(spark, folder), QUALITIES, ["device"]))


@query("quality_distribution", SRC + "SELECT q2 AS value, COUNT(*) AS count, ROUND(CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (), 8) AS rate FROM src GROUP BY q2")
def quality_distribution(spark, folder):
    return rounded(A.value_distribution(source(spark, folder), "q2"))


@query("device_summary", SRC + """SELECT device, COUNT(*) AS rows, COUNT(DISTINCT unit_id) AS units, ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM src), 8) AS row_fraction,
  ROUND(CAST(COUNT(DISTINCT unit_id) AS DOUBLE) / (SELECT COUNT(DISTINCT unit_id) FROM src), 8) AS unit_fraction FROM src GROUP BY device""")
def device_summary(spark, folder):
    return rounded(A.device_summary(source(spark, folder)))


@query("device_labels", NUM + " UNION ALL ".join(
    f"SELECT device, '{c}' AS label_name, COUNT({c}) AS evaluable, COUNT(*) FILTER (WHERE {c} = 1) AS positive, ROUND(CAST(COUNT(*) FILTER (WHERE {c} = 1) AS DOUBLE) / COUNT({c}), 8) AS prevalence FROM num GROUP BY device" for c in LABELS))
def device_labels(spark, folder):
    return rounded(A.device_labels(source(spark, folder), LABELS))


@query("source_labels", """SELECT source, 'quality' AS label_name, COUNT(*) AS evaluable, COUNT(*) FILTER (WHERE quality = 1) AS positive, ROUND(AVG(CAST(quality AS DOUBLE)), 8) AS prevalence FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source
UNION ALL SELECT source, 'toxic', COUNT(*), COUNT(*) FILTER (WHERE toxic = 1), ROUND(AVG(CAST(toxic AS DOUBLE)), 8) FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def source_labels(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "source").join(table(spark, folder, "labels"), "doc_id")
    return rounded(A.device_labels(joined, ["quality", "toxic"], "source"))


@query("quality_by_label", NUM + ", q AS (" + " UNION ALL ".join(f"SELECT '{q}' AS quality, '{y}' AS label_name, {q} AS q, {y} AS y FROM num" for q in QUALITIES for y in LABELS) + """)
SELECT quality, label_name, COUNT(*) FILTER (WHERE q IS NOT NULL AND y IS NOT NULL) AS evaluable, COUNT(*) FILTER (WHERE q = 1 AND y = 0) AS normal_negative, COUNT(*) FILTER (WHERE q = 1 AND y = 1) AS normal_positive,
  COUNT(*) FILTER (WHERE q = 2 AND y = 0) AS abnormal_negative, COUNT(*) FILTER (WHERE q = 2 AND y = 1) AS abnormal_positive,
  ROUND(CAST(COUNT(*) FILTER (WHERE q = 2 AND y = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE q IS NOT NULL AND y = 0), 8) AS abnormal_rate_negative,
  ROUND(CAST(COUNT(*) FILTER (WHERE q = 2 AND y = 1) AS DOUBLE) / COUNT(*) FILTER (WHERE q IS NOT NULL AND y = 1), 8) AS abnormal_rate_positive FROM q GROUP BY quality, label_name""")
def quality_by_label(spark, folder):
    return rounded(A.quality_by_label(source(spark, folder), QUALITIES, LABELS))


@query("device_demographics", SRC + """, u AS (SELECT device, unit_id, CASE WHEN COUNT(DISTINCT age) = 1 THEN MIN(CAST(age AS DOUBLE)) END AS a, COUNT(DISTINCT age) AS an, CASE WHEN COUNT(DISTINCT sex) = 1 THEN MIN(sex) END AS s, COUNT(DISTINCT sex) AS sn FROM src GROUP BY device, unit_id)
SELECT device, COUNT(*) AS units, COUNT(a) AS age_evaluable, COUNT(*) FILTER (WHERE an > 1) AS age_inconsistent, ROUND(AVG(a), 7) AS age_mean, ROUND(STDDEV_SAMP(a), 7) AS age_sd, MIN(a) AS age_min, MAX(a) AS age_max, COUNT(s) AS sex_evaluable,
  COUNT(*) FILTER (WHERE sn > 1) AS sex_inconsistent, COUNT(*) FILTER (WHERE s = '1') AS male, COUNT(*) FILTER (WHERE s = '2') AS female, COUNT(*) FILTER (WHERE s NOT IN ('1', '2')) AS unexpected_sex, ROUND(QUANTILE_CONT(a, 0.5), 7) AS age_median FROM u GROUP BY device""")
def device_demographics(spark, folder):
    return rounded(A.device_demographics(source(spark, folder)), 7)


def concordance_sql(columns, name, low, high, w):
    return " UNION ALL ".join(f"""SELECT '{c}' AS {name}, COUNT(*) FILTER (WHERE r IS NOT NULL AND l IS NOT NULL) AS evaluable_pairs, COUNT(*) FILTER (WHERE r = {high} AND l = {high}) AS both_{w[1]}, COUNT(*) FILTER (WHERE r = {low} AND l = {low}) AS both_{w[0]},
  COUNT(*) FILTER (WHERE r = {high} AND l = {low}) AS right_{w[1]}_only, COUNT(*) FILTER (WHERE r = {low} AND l = {high}) AS left_{w[1]}_only, COUNT(*) FILTER (WHERE r <> l) AS discordant,
  ROUND(CAST(COUNT(*) FILTER (WHERE r <> l) AS DOUBLE) / COUNT(*) FILTER (WHERE r IS NOT NULL AND l IS NOT NULL), 8) AS discordance_rate FROM (SELECT {c}_r AS r, {c}_l AS l FROM pb)""" for c in columns)


@query("label_concordance", PB + "SELECT *, both_positive + discordant AS pairs_with_positive, ROUND(CAST(discordant AS DOUBLE) / (both_positive + discordant), 8) AS discordance_rate_among_positive FROM ("
       + concordance_sql(LABELS, "label_name", 0, 1, ("negative", "positive")) + ")")
def label_concordance(spark, folder):
    return rounded(A.label_concordance(source_pairs(spark, folder), LABELS))


@query("quality_concordance", PB + concordance_sql(QUALITIES, "quality", 1, 2, ("normal", "abnormal")))
def quality_concordance(spark, folder):
    return rounded(A.quality_concordance(source_pairs(spark, folder), QUALITIES))


@query("quality_pair_summary", PB + """, x AS (SELECT q1_r + q1_l + q2_r + q2_l IS NOT NULL AS ok, COALESCE(q1_r <> q1_l, FALSE) OR COALESCE(q2_r <> q2_l, FALSE) AS d FROM pb)
SELECT COUNT(*) AS valid_pairs, COUNT(*) FILTER (WHERE ok) AS all_evaluable, COUNT(*) FILTER (WHERE ok AND d) AS any_discordant, ROUND(CAST(COUNT(*) FILTER (WHERE ok AND d) AS DOUBLE) / COUNT(*) FILTER (WHERE ok), 8) AS any_discordance_rate FROM x""")
def quality_pair_summary(spark, folder):
    return rounded(A.quality_pair_summary(source_pairs(spark, folder), QUALITIES))


def one(c, s):
    return f"COALESCE(CAST({c}_{s} = 1 AS INTEGER), 0)"


PS = PB + ", ps AS (SELECT *, " + " + ".join(one(c, "r") for c in LABELS) + " AS positive_r, " + " + ".join(one(c, "l") for c in LABELS) + " AS positive_l, " + " + ".join(
    f"{one(c, 'r')} * {one(c, 'l')}" for c in LABELS) + " AS shared, " + " + ".join(f"GREATEST({one(c, 'r')}, {one(c, 'l')})" for c in LABELS) + """ AS "union",
  y1_r + y1_l + y2_r + y2_l + y3_r + y3_l IS NOT NULL AS evaluable, COALESCE(q1_r <> q1_l, FALSE) OR COALESCE(q2_r <> q2_l, FALSE) AS anyq FROM pb),
st AS (SELECT unit_id, device_r, device_l, CAST(device_r = device_l AS INTEGER) AS same_device, positive_r, positive_l, shared, "union", evaluable, CAST(anyq AS INTEGER) AS any_quality_discordant,
  CAST(shared < "union" AS INTEGER) AS discordant, CASE WHEN evaluable AND "union" > 0 THEN CAST(shared AS DOUBLE) / "union" END AS jaccard FROM ps)
"""


@query("pair_structure", PS + 'SELECT * REPLACE (ROUND(jaccard, 8) AS jaccard) FROM st')
def pair_structure(spark, folder):
    return rounded(A.pair_structure(source_pairs(spark, folder), LABELS, QUALITIES))


@query("label_vector_summary", PS + """SELECT COUNT(*) FILTER (WHERE evaluable) AS evaluable_pairs, COUNT(*) FILTER (WHERE evaluable AND "union" = 0) AS no_positive, COUNT(jaccard) AS with_positive,
  COUNT(*) FILTER (WHERE evaluable AND discordant = 0) AS identical, COUNT(*) FILTER (WHERE evaluable AND discordant = 1) AS discordant, ROUND(AVG(jaccard), 8) AS mean_jaccard, ROUND(QUANTILE_CONT(jaccard, 0.5), 8) AS median_jaccard,
  ROUND(CAST(COUNT(*) FILTER (WHERE evaluable AND discordant = 1) AS DOUBLE) / COUNT(*) FILTER (WHERE evaluable), 8) AS discordance_rate_all,
  ROUND(CAST(COUNT(*) FILTER (WHERE evaluable AND discordant = 1) AS DOUBLE) / COUNT(jaccard), 8) AS discordance_rate_positive FROM st""")
def label_vector_summary(spark, folder):
    return rounded(A.vector_summary(A.pair_structure(source_pairs(spark, folder), LABELS, QUALITIES)))


@query("device_agreement", PB + """SELECT COUNT(*) AS evaluable_pairs, COUNT(*) FILTER (WHERE device_r = device_l) AS same_device, COUNT(*) FILTER (WHERE device_r <> device_l) AS different_device,
  ROUND(CAST(COUNT(*) FILTER (WHERE device_r <> device_l) AS DOUBLE) / COUNT(*), 8) AS different_rate FROM pb""")
def device_agreement(spark, folder):
    return rounded(A.device_agreement(source_pairs(spark, folder)))


@query("device_pairs", PB + "SELECT device_r, device_l, COUNT(*) AS pairs FROM pb GROUP BY device_r, device_l")
def device_pairs(spark, folder):
    return A.device_pairs(source_pairs(spark, folder))


@query("grade_difference", PB + ", d AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grade, CAST(ABS({g}_r - {g}_l) AS INTEGER) AS difference FROM pb WHERE {g}_r IS NOT NULL AND {g}_l IS NOT NULL" for g in GRADES) + """),
t AS (SELECT grade, COUNT(*) AS n, MAX(difference) AS mx, AVG(difference) AS mean, QUANTILE_CONT(difference, 0.5) AS med FROM d GROUP BY grade)
SELECT d.grade, difference, COUNT(*) AS count, MAX(n) AS evaluable_pairs, MAX(mx) AS max_difference, ROUND(MAX(mean), 8) AS mean_difference, ROUND(MAX(med), 8) AS median_difference, ROUND(CAST(COUNT(*) AS DOUBLE) / MAX(n), 8) AS rate
FROM d JOIN t ON d.grade = t.grade GROUP BY d.grade, difference""")
def grade_difference(spark, folder):
    return rounded(A.grade_difference(source_pairs(spark, folder), GRADES))


@query("grade_label_consistency", SRC + ", g AS (" + " UNION ALL ".join(
    f"SELECT '{g}' AS grade, CASE WHEN TRY_CAST(y1 AS DOUBLE) IN (0, 1) THEN CAST(y1 AS INTEGER) END AS y, CASE WHEN TRY_CAST({g} AS DOUBLE) IN (0, 1, 2, 3, 4) THEN CAST({g} AS INTEGER) END AS v FROM src" for g in GRADES) + """)
SELECT grade, COUNT(*) FILTER (WHERE y IS NOT NULL AND v IS NOT NULL) AS evaluable, COUNT(*) FILTER (WHERE y = 0 AND v = 0) AS negative_zero, COUNT(*) FILTER (WHERE y = 0 AND v > 0) AS negative_graded,
  COUNT(*) FILTER (WHERE y = 1 AND v = 0) AS positive_zero, COUNT(*) FILTER (WHERE y = 1 AND v > 0) AS positive_graded FROM g GROUP BY grade""")
def grade_label_consistency(spark, folder):
    return A.grade_label_consistency(source(spark, folder), "y1", GRADES)


LEAK_COLS = """COUNT(*) AS units, COUNT(*) FILTER (WHERE n > 1) AS repeated_units, COUNT(*) FILTER (WHERE s > 1) AS units_in_several, ROUND(CAST(COUNT(*) FILTER (WHERE s > 1) AS DOUBLE) / COUNT(*), 8) AS fraction_all,
  ROUND(CAST(COUNT(*) FILTER (WHERE s > 1) AS DOUBLE) / COUNT(*) FILTER (WHERE n > 1), 8) AS fraction_repeated"""
LEAK = SRC + """, d AS (SELECT r AS repetition, unit_id, ROW_NUMBER() OVER (PARTITION BY r ORDER BY SHA256('20260828|' || r || '|' || unit_id || '|' || side || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(price AS DECIMAL(18, 2)))) AS k,
  COUNT(*) OVER (PARTITION BY r) AS total FROM src, range(5) t(r)),
p AS (SELECT *, CASE WHEN k <= ROUND_EVEN(0.7 * total, 0) THEN 0 WHEN k <= ROUND_EVEN(0.7 * total, 0) + ROUND_EVEN(0.15 * total, 0) THEN 1 ELSE 2 END AS split FROM d),
u AS (SELECT repetition, unit_id, COUNT(*) AS n, COUNT(DISTINCT split) AS s FROM p GROUP BY repetition, unit_id)
"""


def leakage(spark, folder):
    rows = source(spark, folder).withColumn("price", F.col("price").cast("decimal(18,2)"))
    return A.row_split_leakage(rows, ROW_KEY, 5, 20260828)


@query("row_split_leakage", LEAK + f"SELECT CAST(repetition AS INTEGER) AS repetition, {LEAK_COLS} FROM u GROUP BY repetition")
def row_split_leakage(spark, folder):
    return rounded(leakage(spark, folder))


WHOLE = "(CASE WHEN {m} < {k} THEN 0 ELSE EXP(COALESCE(LIST_SUM(LIST_TRANSFORM(RANGE(0, {k}), lambda i: LN(CAST({m} - i AS DOUBLE) / ({n} - i)))), 0)) END)"


@query("expected_row_leakage", SRC + f""", h AS (SELECT k, COUNT(*) AS c FROM (SELECT COUNT(*) AS k FROM src GROUP BY unit_id) GROUP BY k),
t AS (SELECT CAST(SUM(k * c) AS BIGINT) AS n, CAST(SUM(c) AS BIGINT) AS units FROM h), e AS (SELECT n, units, CAST(ROUND_EVEN(0.7 * n, 0) AS BIGINT) AS m1, CAST(ROUND_EVEN(0.15 * n, 0) AS BIGINT) AS m2 FROM t),
s AS (SELECT 1 AS s, m1 AS m, n FROM e UNION ALL SELECT 2, m2, n FROM e UNION ALL SELECT 3, n - m1 - m2, n FROM e),
a AS (SELECT h.k, h.c, s.s, s.m, s.n, {WHOLE.format(m='s.m', k='h.k', n='s.n')} AS a FROM h, s), p AS (SELECT k, c, SUM(a) AS p FROM a GROUP BY k, c),
b AS (SELECT x.k, y.k AS j, SUM(CASE WHEN x.s = y.s THEN {WHOLE.format(m='x.m', k='(x.k + y.k)', n='x.n')} ELSE x.a * y.a / {WHOLE.format(m='(x.n - x.k)', k='y.k', n='x.n')} END) AS b FROM a x, a y GROUP BY x.k, y.k),
v AS (SELECT SUM(x.c * (y.c - CASE WHEN x.k = y.k THEN 1 ELSE 0 END) * (b.b - x.p * y.p)) AS v FROM b JOIN p x ON x.k = b.k JOIN p y ON y.k = b.j)
SELECT MAX(n) AS rows, MAX(units) AS units, ROUND(MAX(units) - SUM(c * p), 6) AS expected, ROUND(SQRT(SUM(c * p * (1 - p)) + MAX(v)), 4) AS deviation FROM p, e, v""")
def expected_row_leakage(spark, folder):
    return A.expected_row_leakage(source(spark, folder)).withColumns({"expected": F.round("expected", 6), "deviation": F.round("deviation", 4)})


@query("split_leakage", SRC + f""", u AS (SELECT unit_id, COUNT(*) AS n, COUNT(DISTINCT device) AS s FROM src GROUP BY unit_id) SELECT {LEAK_COLS} FROM u""")
def split_leakage(spark, folder):
    return rounded(A.split_leakage(source(spark, folder), "device"))


GUIDANCE = {  # fixed values: what is known about each column
    "availability": {"unit_id": "key", "side": "at_scoring", "device": "at_scoring", "age": "at_scoring", "sex": "at_scoring", "y1": "target", "y2": "target", "y3": "target"},
    "leakage": {"unit_id": "grouping_only", "side": "low", "device": "possible", "age": "low", "sex": "low", "y1": "target", "y2": "target", "y3": "target"},
}


def _case(kind):
    return "CASE variable " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in GUIDANCE[kind].items()) + " ELSE 'uncertain' END"


@query("variable_register", SRC + f", v AS (SELECT variable, missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, COUNT(*) - COUNT({c}) AS missing FROM src" for c in ["unit_id", "side", "device", "anatomy", *LABELS, "age", "sex", "price"])
       + f")) SELECT variable, {_case('availability')} AS availability, {_case('leakage')} AS leakage, missing FROM v")
def variable_register(spark, folder):
    rows = source(spark, folder).select("unit_id", "side", "device", "anatomy", *LABELS, "age", "sex", "price")
    guidance = spark.createDataFrame([(k, v, GUIDANCE["leakage"][k]) for k, v in GUIDANCE["availability"].items()], "variable string, availability string, leakage string")
    register = A.variable_register(rows, guidance, {"availability": "uncertain", "leakage": "uncertain"})
    seen = A.missingness(rows).select(F.col("column_name").alias("variable"), "missing")
    return register.join(seen, "variable")


FINDINGS = DOMAIN_SQL + """, f AS (SELECT 'YELLOW' AS level, 'UNEXPECTED_VALUE' AS code, column_name || '=' || raw AS message FROM d WHERE bad
UNION ALL SELECT 'RED', 'DUPLICATE_UNIT_SIDE', CAST(COUNT(*) AS VARCHAR) FROM (SELECT unit_id, side FROM src GROUP BY unit_id, side HAVING COUNT(*) > 1) HAVING COUNT(*) > 0
UNION ALL SELECT 'INFO', 'ROWS', CAST(COUNT(*) AS VARCHAR) FROM src UNION ALL SELECT 'RED', 'MISSING_COLUMN', 'vessels' UNION ALL SELECT 'YELLOW', 'UNEXPECTED_COLUMN', 'l_partkey' UNION ALL SELECT 'YELLOW', 'UNEXPECTED_COLUMN', 'l_suppkey')
"""


def findings(spark, folder):
    """Rule outputs as one table of level, code and message."""
    rows = source(spark, folder)
    expected = [c for c in rows.columns if not c.startswith("l_")] + ["vessels"]
    line = lambda df, level, code, message: df.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.cast("string").alias("message"))
    domains = A.domain_audit(rows, DOMAINS)
    repeated = A.duplicate_keys(rows, ["unit_id", "side"]).agg(F.count("*").alias("n")).filter("n > 0")
    return (
        line(domains, "YELLOW", "UNEXPECTED_VALUE", F.concat_ws("=", "column_name", "unexpected_value"))
        .unionByName(line(repeated, "RED", "DUPLICATE_UNIT_SIDE", F.col("n")))
        .unionByName(line(rows.agg(F.count("*").alias("n")), "INFO", "ROWS", F.col("n")))
        .unionByName(A.schema_drift(spark, rows.columns, expected))
    )


@query("findings", FINDINGS + "SELECT * FROM f")
def findings_query(spark, folder):
    return findings(spark, folder)


@query("findings_by_level", FINDINGS + "SELECT level, COUNT(*) AS findings FROM f GROUP BY level")
def findings_by_level(spark, folder):
    return A.findings_summary(findings(spark, folder))


@query("release_verdict", LEAK + """, c AS (SELECT COUNT(*) AS rows, COUNT(DISTINCT unit_id) AS units FROM src),
b AS (SELECT COUNT(*) AS valid_pairs FROM (SELECT unit_id FROM src GROUP BY unit_id HAVING COUNT(*) FILTER (WHERE side = 1) = 1 AND COUNT(*) FILTER (WHERE side = 2) = 1 AND COUNT(*) FILTER (WHERE side NOT IN (1, 2)) = 0)),
l AS (SELECT repetition, COUNT(*) FILTER (WHERE s > 1) AS k FROM u GROUP BY repetition)
SELECT c.rows, c.units, valid_pairs, ROUND(AVG(k), 8) AS leakage_mean, MIN(k) AS leakage_min, MAX(k) AS leakage_max, CASE WHEN c.rows = 60000 AND c.units = 15000 THEN 'consistent' ELSE 'not_fully_verified' END AS verdict FROM c, b, l GROUP BY c.rows, c.units, valid_pairs""")
def release_verdict(spark, folder):
    units = A.unit_structure(source(spark, folder))
    leak = leakage(spark, folder).agg(F.avg("units_in_several").alias("leakage_mean"), F.min("units_in_several").alias("leakage_min"), F.max("units_in_several").alias("leakage_max"))
    counts = units.agg(F.sum("rows").alias("rows"), F.count("*").alias("units"), F.count_if(F.col("valid_pair") == 1).alias("valid_pairs"))
    as_expected = (F.col("rows") == 60000) & (F.col("units") == 15000)
    verdict = F.when(as_expected, "consistent").otherwise("not_fully_verified")
    packed = leak.select(F.struct("leakage_mean", "leakage_min", "leakage_max")).scalar()
    return rounded(counts.withColumn("_l", packed).select("rows", "units", "valid_pairs", "_l.*", verdict.alias("verdict")))


@query("identifier_audit", SRC + """SELECT 'row_id' AS key, COUNT(*) AS rows, BOOL_AND(REGEXP_FULL_MATCH(row_id, 'img\\d+')) AS all_match FROM src
UNION ALL SELECT 'url', COUNT(*), BOOL_AND(REGEXP_FULL_MATCH(url, 'img\\d+')) FROM pages""")
def identifier_audit(spark, folder):
    check = lambda df, name: df.agg(F.count("*").alias("rows"), F.bool_and(F.col(name).rlike(r"^img\d+$")).alias("all_match")).withColumn("key", F.lit(name))
    return check(source(spark, folder), "row_id").unionByName(check(table(spark, folder, "pages"), "url"))


@query("manifest_key_differences", """WITH l AS (SELECT DISTINCT l_orderkey AS unit_id FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT o_orderkey AS unit_id FROM orders WHERE o_orderstatus = 'F')
SELECT unit_id, 'left_only' AS found_in FROM (SELECT unit_id FROM l EXCEPT SELECT unit_id FROM o) UNION ALL SELECT unit_id, 'right_only' FROM (SELECT unit_id FROM o EXCEPT SELECT unit_id FROM l)""")
def manifest_key_differences(spark, folder):
    lines = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit_id"))
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit_id"))
    return missing_keys(lines, orders, ["unit_id"])
