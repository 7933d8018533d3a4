"""Contracts, ledgers, gates and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators import gates as V
from dyadlab.operators.cohort import DEVELOPMENT, HOLDOUT
from dyadlab.operators.pairs import UNIT
from dyadlab.plans.audit_queries import LABELS, source
from dyadlab.plans.cohort_queries import ASSIGNED, assigned
from dyadlab.plans.registry import query, table
from dyadlab.plans.risk_queries import rounded
from dyadlab.plans.views import ROWS_SQL, predictions
from dyadlab.session import cut
from dyadlab.sources import files as D
from dyadlab.sources import sinks as W
from dyadlab.sources import tables as C

N = S.number


@query("gated_stage_rows", ASSIGNED + """SELECT src.unit_id, side, device, q1, y1, y2, y3 FROM src WHERE unit_id IN (SELECT unit_id FROM assigned WHERE "partition" = 'development')""")
def gated_stage_rows(spark, folder):
    """Rows of the development units only."""
    rows = source(spark, folder).select(UNIT, "side", "device", "q1", *LABELS)
    return C.stage_rows(rows, assigned(spark, folder).select(UNIT, "partition"), DEVELOPMENT)


@query("stage_unit_coverage", ASSIGNED + """SELECT "partition", COUNT(DISTINCT a.unit_id) AS units, COUNT(*) AS rows FROM assigned a JOIN src ON src.unit_id = a.unit_id GROUP BY "partition" """)
def stage_unit_coverage(spark, folder):
    manifest = assigned(spark, folder).select(UNIT, "partition")
    rows = source(spark, folder).groupBy(UNIT).agg(F.count("*").alias("n"))
    return manifest.join(rows, UNIT).groupBy("partition").agg(F.count("*").alias("units"), F.sum("n").alias("rows"))


@query("prediction_contract", ROWS_SQL + """SELECT endpoint, COUNT(*) AS rows, COUNT(DISTINCT unit_id) AS units, COUNT(*) - COUNT(DISTINCT unit_id || '/' || side) AS repeated_sides, COUNT(*) FILTER (WHERE side NOT IN (1, 2)) AS invalid_sides,
  COUNT(DISTINCT unit_id) FILTER (WHERE side = 2) AS complete_units FROM pred GROUP BY endpoint""")
def prediction_contract(spark, folder):
    return C.prediction_contract(C.require_predictions(cut(predictions(spark, folder).select("endpoint", UNIT, "side"))))


@query("raw_row_contract", """WITH s AS (SELECT l_orderkey AS u, l_linenumber AS s, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), u AS (SELECT u, SUM(n) AS r, COUNT(*) FILTER (WHERE n > 1) AS t, COALESCE(SUM(n) FILTER (WHERE s NOT IN (1, 2)), 0) AS o, COUNT(*) FILTER (WHERE s IN (1, 2)) AS k FROM s GROUP BY u)
SELECT CAST(SUM(r) AS BIGINT) AS rows, COUNT(*) AS units, CAST(SUM(t) AS BIGINT) AS repeated_sides, CAST(SUM(o) AS BIGINT) AS invalid_sides, COUNT(*) FILTER (WHERE k = 2) AS complete_units FROM u""")
def raw_row_contract(spark, folder):
    """The same counts on the unfiltered lines, where every rule is broken."""
    return C.prediction_contract(source(spark, folder).select(UNIT, "side"), [])


@query("manifest_contract", ASSIGNED + """SELECT COUNT(*) AS rows, COUNT(*) - COUNT(DISTINCT unit_id) AS repeated_units, CAST(0 AS BIGINT) AS overlapping_units, COUNT(*) FILTER (WHERE "partition" NOT IN ('development', 'final_holdout')) AS unknown_labels,
  COUNT(*) FILTER (WHERE "partition" = 'development') AS development_units, COUNT(*) FILTER (WHERE "partition" = 'final_holdout') AS final_holdout_units FROM assigned""")
def manifest_contract(spark, folder):
    return C.manifest_contract(assigned(spark, folder).select(UNIT, "partition"), [DEVELOPMENT, HOLDOUT])


@query("embedding_contract", """SELECT COUNT(*) AS rows, CAST(MIN(LEN(embedding)) AS INTEGER) AS min_size, CAST(MAX(LEN(embedding)) AS INTEGER) AS max_size,
  COUNT(*) FILTER (WHERE LEN(LIST_FILTER(embedding, lambda v: v IS NULL OR ISNAN(v))) > 0) AS bad_vectors FROM embeddings""")
def embedding_contract(spark, folder):
    return C.embedding_contract(table(spark, folder, "embeddings"))


@query("attached_vectors", "SELECT vec_id AS row_id, vec_id // 2 AS unit_id, CAST(vec_id % 2 + 1 AS INTEGER) AS side, label, CAST(LEN(embedding) AS INTEGER) AS size, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM embeddings")
def attached_vectors(spark, folder):
    keyed = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.floor(F.col("vec_id") / 2).alias(UNIT), (F.col("vec_id") % 2 + 1).cast("int").alias("side"), "label", "embedding")
    on = ["row_id", UNIT, "side"]
    joined = C.attach_vectors(keyed.drop("embedding"), keyed, on)
    return rounded(joined.select(*on, "label", F.size("embedding").alias("size"), F.get("embedding", F.lit(0)).cast("double").alias("first_value")), 6)


# -- ledgers -----------------------------------------------------------------------------------------------------------

LEDGER_SQL = """WITH doc AS (SELECT doc_id, 'doc/' || doc_id || '.txt' AS path, SHA256(text) AS digest FROM documents),
parsed AS (SELECT CASE WHEN doc_id % 50 <> 0 THEN path END AS path, CASE WHEN doc_id % 50 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN REVERSE(digest) ELSE digest END END AS expected, doc_id % 50 <> 0 AS valid FROM doc
  UNION ALL SELECT path, digest, TRUE FROM doc WHERE doc_id % 90 = 1)
"""


def ledger_lines(spark, folder):
    """A checksum ledger over the documents: upper case, starred paths, wrong, cut and repeated lines among the good."""
    doc, digest = F.col("doc_id"), F.sha2("text", 256)
    path = F.concat(F.lit("doc/"), doc.cast("string"), F.lit(".txt"))
    docs = table(spark, folder, "documents").select("doc_id", path.alias("path"), digest.alias("digest"))
    stated = F.when(doc % 7 == 0, F.reverse("digest")).when(doc % 3 == 0, F.upper("digest")).otherwise(F.col("digest"))
    text = F.concat(F.when(doc % 50 == 0, F.substring(stated, 1, 60)).otherwise(stated), F.when(doc % 2 == 0, F.lit("  ")).otherwise(F.lit(" *")), F.col("path"))
    return docs, docs.select(text.alias("value")).unionByName(docs.filter(doc % 90 == 1).select(F.concat_ws("  ", "digest", "path").alias("value")))


@query("ledger_parse", LEDGER_SQL + "SELECT * FROM parsed")
def ledger_parse(spark, folder):
    return D.parse_ledger(ledger_lines(spark, folder)[1])


@query("ledger_problems", LEDGER_SQL + "SELECT 'malformed' AS problem, CAST(NULL AS VARCHAR) AS path, COUNT(*) AS n FROM parsed WHERE NOT valid UNION ALL SELECT 'duplicate', path, COUNT(*) FROM parsed WHERE valid GROUP BY path HAVING COUNT(*) > 1")
def ledger_problems(spark, folder):
    return D.ledger_problems(D.parse_ledger(ledger_lines(spark, folder)[1]))


EXPECTED_SQL = LEDGER_SQL + ", stated AS (SELECT DISTINCT path, MIN(expected) AS expected FROM parsed WHERE valid GROUP BY path) "


def stated(spark, folder):
    docs, lines = ledger_lines(spark, folder)
    expected = D.parse_ledger(lines).filter("valid").groupBy("path").agg(F.min("expected").alias("expected"))
    return docs.select("path", F.col("digest").alias("sha256")), expected


@query("checksum_match", EXPECTED_SQL + "SELECT doc.path, digest AS sha256, expected, CASE WHEN expected IS NOT NULL THEN digest = expected END AS matches FROM doc LEFT JOIN stated ON doc.path = stated.path")
def checksum_match(spark, folder):
    return D.checksum_match(*stated(spark, folder))


@query("ledger_differences", EXPECTED_SQL + "SELECT doc.path, digest AS sha256, expected FROM doc LEFT JOIN stated ON doc.path = stated.path WHERE digest IS DISTINCT FROM expected")
def ledger_differences(spark, folder):
    return D.ledger_differences(*stated(spark, folder))


TABLES = ("orders", "customer", "supplier", "part", "labels")


@query("table_ledger")
def table_ledger(spark, folder):
    return W.table_ledger({t: table(spark, folder, t) for t in TABLES})


@query("ledger_verification", "SELECT 'orders' AS table_name, COUNT(*) AS rows_now, COUNT(*) FILTER (WHERE o_orderstatus <> 'P') AS rows_stored FROM orders")
def ledger_verification(spark, folder):
    """Current tables against a ledger taken before rows were added to one of them: that one table is reported."""
    now = {t: table(spark, folder, t) for t in TABLES}
    before = {**now, "orders": now["orders"].filter("o_orderstatus <> 'P'")}
    found = W.ledger_mismatches(W.table_ledger(now), W.table_ledger(before))
    return found.select("table_name", F.col("rows").alias("rows_now"), F.col("stored_rows").alias("rows_stored"))


@query("file_inventory")
def file_inventory(spark, folder):
    return D.inventory(spark, folder, [".parquet"])


@query("file_digests")
def file_digests(spark, folder):
    return D.file_digests(spark, folder, [".parquet"])


# -- validation and scans ------------------------------------------------------------------------------------------------

FOLD_SQL = "('0x' || SUBSTR(SHA256('5|' || unit_id), 1, 15))::BIGINT % 5"


@query("validation_checks", ROWS_SQL + f""", f AS (SELECT DISTINCT unit_id, {FOLD_SQL} AS fold FROM base), x AS (SELECT p.*, CASE WHEN p.unit_id % 100 = 7 AND endpoint = 'price' THEN 0 ELSE fold END AS stored, fold,
    p.unit_id % 200 = 11 AND endpoint <> 'discount' AS held, endpoint = 'quantity' AND p.unit_id % 50 = 1 AS bad_loss FROM pred p JOIN f ON p.unit_id = f.unit_id),
u AS (SELECT endpoint, unit_id, COUNT(*) AS n, MAX(CAST(stored <> fold AS INTEGER)) AS mis, MAX(CAST(held AS INTEGER)) AS held, MAX(CAST(bad_loss AS INTEGER)) AS bad FROM x GROUP BY endpoint, unit_id),
t AS (SELECT endpoint, COUNT(*) FILTER (WHERE n <> 2) AS uncovered, COUNT(*) FILTER (WHERE unit_id % 200 = 11) AS leaked, COUNT(*) FILTER (WHERE mis = 1) AS mis, MAX(bad) AS bad FROM u GROUP BY endpoint)
SELECT endpoint, 'coverage' AS "check", uncovered = 0 AS passed, CAST(uncovered AS VARCHAR) AS detail FROM t UNION ALL SELECT endpoint, 'holdout_exclusion', leaked = 0, CAST(leaked AS VARCHAR) FROM t
UNION ALL SELECT endpoint, 'fold_provenance', mis = 0, CAST(mis AS VARCHAR) FROM t UNION ALL SELECT endpoint, 'loss_recomputation', bad = 0, '0' FROM t UNION ALL SELECT endpoint, 'registered_choices', TRUE, '0' FROM t""")
def validation_checks(spark, folder):
    """Rules on a table with planted faults: wrong folds in one endpoint, wrong losses in another, held-out units in all."""
    unit, endpoint = F.col(UNIT), F.col("endpoint")
    rows = predictions(spark, folder)
    fold = (S.digest_int(S.keyed_digest(5, unit), 1) % 5).cast("int")
    exact = S.binary_nll(F.col("label").cast("double"), F.col("prob"))
    table_ = rows.withColumns({
        "outer_fold": F.when((unit % 100 == 7) & (endpoint == "price"), 0).otherwise(fold), "nll": F.when((endpoint == "quantity") & (unit % 50 == 1), exact + N(1e-9)).otherwise(exact)})
    units = rows.select(UNIT).distinct()
    return V.validation_checks(table_, units.withColumn("outer_fold", fold), units.filter(unit % 200 == 11))


SCANS = {name: pattern for name, pattern in V.SECRET_PATTERNS.items()}


@query("secret_scan", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule FROM documents WHERE REGEXP_MATCHES(text, '" + p.replace("'", "''") + "')" for n, p in SCANS.items()))
def secret_scan(spark, folder):
    return V.scan_text(table(spark, folder, "documents"), "doc_id", "text", SCANS)


@query("page_secret_scan", " UNION ALL ".join(f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE REGEXP_MATCHES(html, '" + p.replace("'", "''") + "')) AS pages, COUNT(*) AS scanned FROM pages" for n, p in SCANS.items()))
def page_secret_scan(spark, folder):
    """Pages per rule, rules without a hit included."""
    pages = table(spark, folder, "pages")
    hits = pages.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col("html").rlike(p).alias("hit")) for n, p in SCANS.items()])).alias("_h")).select("_h.*")
    return hits.groupBy("rule").agg(F.count_if("hit").alias("pages"), F.count("*").alias("scanned"))


@query("restricted_columns", "SELECT 'predictions' AS table_name, 'side' AS column_name, COUNT(*) AS rows FROM lineitem UNION ALL SELECT 'predictions', 'unit_id', COUNT(*) FROM lineitem UNION ALL SELECT 'predictions', 'row_id', COUNT(*) FROM lineitem UNION ALL SELECT 'embeddings', 'label', COUNT(*) FROM embeddings")
def restricted_columns(spark, folder):
    """Restricted columns found in tables up for release, with the rows they would expose."""
    tables = {"predictions": source(spark, folder), "embeddings": table(spark, folder, "embeddings"), "orders": table(spark, folder, "orders")}
    out = None
    for name, df in tables.items():
        found = V.restricted_columns(df)
        if found:
            line = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.explode(F.array(*map(F.lit, found))).alias("column_name"), "rows")
            out = line if out is None else out.unionByName(line)
    return out


@query("path_scan", """WITH f AS (SELECT url, page_id, SPLIT(url, '/') AS parts, LENGTH(html) AS n FROM pages), h AS (SELECT page_id, url AS relative_path, 'forbidden path component' AS reason FROM f WHERE LIST_HAS_ANY(parts, ['fr', 'de'])
UNION ALL SELECT page_id, url, 'forbidden suffix' FROM f WHERE url LIKE '%#top' UNION ALL SELECT page_id, url, 'file exceeds release limit' FROM f WHERE n > 4096) SELECT relative_path, reason FROM h""")
def path_scan(spark, folder):
    """Pages as an inventory, with parts, endings and a size limit that occur in it."""
    files = table(spark, folder, "pages").select(F.col("url").alias("relative_path"), F.length("html").alias("bytes"), F.regexp_extract("url", r"(#\w+)$", 1).alias("extension"))
    return V.scan_inventory(files, ["fr", "de"], ["#top"], 4096)
