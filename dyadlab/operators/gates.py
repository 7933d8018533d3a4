"""Access gate, release record, pre-release validation, release scan of text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlab.functions import scalars as S
from dyadlab.operators.cohort import DEVELOPMENT, HOLDOUT, content_hash
from dyadlab.operators.pairs import SIDE, UNIT
from dyadlab.sources.commit import publish, require_fresh
from dyadlab.sources.sinks import exists, ledger_mismatches, require_absent, table_ledger
from dyadlab.sources.tables import require_manifest, stage_rows


class AccessDenied(RuntimeError):
    """The stage may not be read (yet)."""


@dataclass(frozen=True)
class Gate:
    """Where the release record lives and what it must say."""

    release_path: str
    manifest_hash: str

    def release(self, spark: SparkSession, checks: DataFrame, sealed: dict[str, DataFrame]) -> None:
        """Open the holdout once: only after every check passed, sealing the content of the given tables."""
        failed = checks.filter(~F.coalesce("passed", F.lit(False))).limit(5).collect()
        if failed or checks.isEmpty():
            raise AccessDenied(f"validation did not pass: {[r['check'] for r in failed] or 'no checks'}")
        require_absent(spark, self.release_path)
        record = table_ledger(sealed).withColumns({"status": F.lit("PASS"), "manifest_hash": F.lit(self.manifest_hash)})
        record.coalesce(1).write.mode("errorifexists").parquet(self.release_path)

    def authorize(self, manifest: DataFrame, stage: str, sealed: dict[str, DataFrame] | None = None) -> None:
        """Raise unless ``stage`` may be read: intact manifest; for the holdout also a PASS record and unchanged sealed tables."""
        require_manifest(manifest, [DEVELOPMENT, HOLDOUT])
        if content_hash(manifest, [UNIT, "partition"]).first()["content_hash"] != self.manifest_hash:
            raise AccessDenied("manifest differs from the frozen one")
        if stage == DEVELOPMENT:
            return
        if stage != HOLDOUT:
            raise AccessDenied(f"unknown stage {stage}")
        spark = manifest.sparkSession
        if not exists(spark, self.release_path):
            raise AccessDenied("holdout has not been released")
        record = spark.read.parquet(self.release_path)
        wrong = record.filter((F.col("status") != "PASS") | (F.col("manifest_hash") != self.manifest_hash))
        if record.isEmpty() or not wrong.isEmpty():
            raise AccessDenied("release record is not valid for this manifest")
        changed = ledger_mismatches(table_ledger(sealed or {}), record) if sealed else record
        if not changed.isEmpty():
            raise AccessDenied("sealed tables are missing or changed")

    def read_stage(self, rows: DataFrame, manifest: DataFrame, stage: str, sealed: dict[str, DataFrame] | None = None) -> DataFrame:
        """The stage's rows, and nothing of other stages, after authorisation; every unit of the stage must be there."""
        self.authorize(manifest, stage, sealed)
        selected = stage_rows(rows, manifest, stage)
        absent = manifest.filter(F.col("partition") == stage).select(UNIT).join(rows.select(UNIT), UNIT, "left_anti")
        if not absent.isEmpty():
            raise AccessDenied(f"units of stage {stage} have no rows")
        return selected

    def execute(
        self, rows: DataFrame, manifest: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, sealed: dict[str, DataFrame], endpoints: Sequence[str], fields: dict[str, str] | None = None,
    ) -> DataFrame:
        """Score the holdout once, behind the gate, and commit predictions and execution record together; return the record.

        ``score`` maps the stage's rows to predictions (unit_id, side, endpoint, ...). Refused: a second run, a run over the
        remains of an interrupted one, a stage that :meth:`read_stage` refuses or that lacks one of the two sides of a unit,
        predictions that do not cover every held-out unit and side exactly once for each of ``endpoints``, other endpoints.
        """
        spark = rows.sparkSession
        require_fresh(spark, target)
        stage = self.read_stage(rows, manifest, HOLDOUT, sealed)
        held = manifest.filter(F.col("partition") == HOLDOUT).select(UNIT)
        _require_both_sides(stage)

        def covered(tables: dict[str, DataFrame]) -> None:
            gaps = coverage_gaps(tables["predictions"], held, endpoints).limit(5).collect()
            if gaps:
                raise AccessDenied(f"predictions do not cover the holdout: {[tuple(g) for g in gaps]}")

        record = {"status": "EXECUTED", "execution_count": "1", "manifest_hash": self.manifest_hash, "used_for_selection": "false", **(fields or {})}
        return publish(spark, {"predictions": score(stage)}, target, record, covered)


def _require_both_sides(rows: DataFrame) -> None:
    """Two rows a unit, one a side."""
    odd = rows.groupBy(UNIT).agg(F.count("*").alias("n"), F.count_if(F.col(SIDE) == 1).alias("r"), F.count_if(F.col(SIDE) == 2).alias("l")).filter("NOT (n = 2 AND r = 1 AND l = 1)")
    if not odd.isEmpty():
        raise AccessDenied(f"units without exactly one row a side: {[r[UNIT] for r in odd.limit(5).collect()]}")


def coverage_gaps(predictions: DataFrame, units: DataFrame, endpoints: Sequence[str]) -> DataFrame:
    """(endpoint, unit_id, rows): units of an expected endpoint without exactly one row a side, and what is there unexpected."""
    listed = predictions.sparkSession.createDataFrame([(e,) for e in endpoints], "endpoint string")
    # a line per unit and endpoint that must be there, made on the units' side; endpoints are a short registered list
    wanted = units.withColumn("endpoint", F.explode(F.array(*map(F.lit, endpoints)))).withColumn("wanted", F.lit(True)) if endpoints else units.limit(0).withColumns({"endpoint": F.lit(""), "wanted": F.lit(True)})
    found = predictions.groupBy("endpoint", UNIT).agg(F.count("*").alias("rows"), F.count_if(F.col(SIDE) == 1).alias("r"), F.count_if(F.col(SIDE) == 2).alias("l"))
    both = wanted.join(found, ["endpoint", UNIT], "full")
    fine = F.coalesce(F.col("wanted") & (F.col("rows") == 2) & (F.col("r") == 1) & (F.col("l") == 1), F.lit(False))
    missing = both.filter(~fine).select("endpoint", UNIT, F.coalesce("rows", F.lit(0)).alias("rows"))
    # an endpoint that is expected where there are no units at all
    absent = listed.join(found.select("endpoint").distinct(), "endpoint", "left_anti").select("endpoint", F.lit(None).cast(units.schema[UNIT].dataType).alias(UNIT), F.lit(0).cast("long").alias("rows"))
    return missing.unionByName(absent)


# -- validation --------------------------------------------------------------------------------------------------


def validation_checks(
    predictions: DataFrame, folds: DataFrame, holdout: DataFrame, methods: Sequence[str] = (), strengths: Sequence[float] = (), tolerance: float = 1e-12,
    endpoints: Sequence[str] = (),
) -> DataFrame:
    """Rules a prediction table must meet before holdout release, one line per endpoint and rule; fails closed.

    ``folds`` has (unit_id, outer_fold) of every development unit, ``holdout`` the held-out unit ids. Each of ``endpoints``
    gets its lines whether it was predicted or not; without predictions they fail.
    """
    registered = F.lit(True)
    if methods:
        registered = registered & F.col("method").isin(*methods)
    if strengths:
        registered = registered & F.col("strength").isin(*[float(s) for s in strengths])
    loss_gap = F.abs(S.binary_nll(F.col("label").cast("double"), F.col("prob")) - F.col("nll"))
    units = predictions.groupBy("endpoint", UNIT).agg(
        F.count("*").alias("n"), F.count_if(F.col(SIDE) == 1).alias("r"), F.count_if(F.col(SIDE) == 2).alias("l"), F.min("outer_fold").alias("f0"), F.max("outer_fold").alias("f1"),
        F.max(loss_gap).alias("gap"), F.count_if(loss_gap.isNull()).alias("no_gap"), F.count_if(~F.coalesce(registered, F.lit(False))).alias("odd"))
    expected = folds.select(UNIT, F.col("outer_fold").alias("fold"), F.lit(1).alias("known"))
    held = holdout.select(UNIT, F.lit(1).alias("held"))
    joined = units.join(expected, UNIT, "left").join(held, UNIT, "left")
    total = folds.agg(F.count("*")).scalar()
    table = joined.groupBy("endpoint").agg(
        F.count("*").alias("units"), F.count_if((F.col("n") != 2) | (F.col("r") != 1) | (F.col("l") != 1)).alias("uncovered"), F.count_if(F.col("held").isNotNull()).alias("leaked"),
        F.count_if(~((F.col("f0") == F.col("fold")) & (F.col("f1") == F.col("fold"))) | F.col("fold").isNull()).alias("misfolded"), F.max("gap").alias("gap"), F.sum("no_gap").alias("no_gap"), F.sum("odd").alias("odd"))
    if endpoints:
        listed = predictions.sparkSession.createDataFrame([(e,) for e in endpoints], "endpoint string")
        table = table.join(F.broadcast(listed), "endpoint", "full")  # one line per endpoint
    table = table.withColumn("expected_units", total)
    rules = [
        ("coverage", (F.col("uncovered") == 0) & (F.col("units") == F.col("expected_units")), F.col("uncovered")), ("holdout_exclusion", F.col("leaked") == 0, F.col("leaked")),
        ("fold_provenance", F.col("misfolded") == 0, F.col("misfolded")), ("loss_recomputation", (F.col("gap") <= S.number(tolerance)) & (F.col("no_gap") == 0), F.col("no_gap")),
        ("registered_choices", F.col("odd") == 0, F.col("odd"))]
    return table.select("endpoint", F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for name, passed, detail in rules])).alias("_r")).select("endpoint", "_r.*")


# -- release scan ------------------------------------------------------------------------------------------------

# What a released text must not contain, and what a released table or file must not be.
SECRET_PATTERNS = {
    "github_token": r"(?:ghp|github_pat)_[A-Za-z0-9_]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "generic_secret_assignment": r"""(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password)\s*[:=]\s*['"][^'"]{8,}['"]""",
    "absolute_user_path": r"/(?:Users|home)/[^/\s]+/",
    "token_assignment": r"""(?i)\btoken\s*=\s*"[0-9a-f]{40}\"""",
}
RESTRICTED_COLUMNS = ("unit_id", "row_id", "side", "label")
FORBIDDEN_PARTS = (".env", ".venv", "__pycache__", "data", "private_artifacts", "predictions", "embeddings", "checkpoints")
FORBIDDEN_SUFFIXES = (
    ".jpg", ".jpeg", ".tif", ".tiff", ".dcm", ".npy", ".npz", ".pt",
    ".pth", ".pkl", ".joblib", ".p12", ".pfx", ".key", ".pem",
)
SIZE_LIMIT = 10 * 1024 * 1024


def scan_text(texts: DataFrame, key: str, text: str, rules: dict[str, str] = SECRET_PATTERNS) -> DataFrame:
    """(key, rule) for every rule found anywhere in the whole text."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))
    return texts.select(key, F.explode(hits).alias("rule"))


def restricted_columns(df: DataFrame, restricted: Sequence[str] = RESTRICTED_COLUMNS) -> list[str]:
    return sorted(set(df.columns) & set(restricted))


def scan_inventory(files: DataFrame, parts: Sequence[str] = FORBIDDEN_PARTS, suffixes: Sequence[str] = FORBIDDEN_SUFFIXES, limit: int = SIZE_LIMIT) -> DataFrame:
    """(relative_path, reason) for forbidden path parts and suffixes and for oversized files."""
    inside = F.arrays_overlap(F.split("relative_path", "/"), F.array(*map(F.lit, parts)))
    reasons = F.array_compact(F.array(
        F.when(inside, "forbidden path component"), F.when(F.col("extension").isin(*suffixes), "forbidden suffix"), F.when(F.col("bytes") > limit, "file exceeds release limit")))
    return files.select("relative_path", F.explode(reasons).alias("reason"))
