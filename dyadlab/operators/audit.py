"""Integrity audit of a raw table of paired units: codes, duplicates, structure, labels, concordance, leakage."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from dyadlab.functions import scalars as S
from dyadlab.operators.ordering import exact_quantiles, hash_cuts
from dyadlab.operators.pairs import SIDE, UNIT
from dyadlab.session import dealt

N = S.number
BINARY = (0, 1)
QUALITY = (S.NORMAL, S.ABNORMAL)
BRACKET_DEVIATIONS = 5  # reach of the bracket in which a digest is looked for; it steers costs, never what is found


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column_name", value: str = "raw") -> DataFrame:
    """Columns to (name, value as text) lines, nulls kept."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns
    ])).alias("_u")).select(*keep, "_u.*")


def _codes(values: str, allowed: Sequence[int]) -> Column:
    return S.in_domain(F.col(values), allowed)


# -- schema and domains ------------------------------------------------------------------------------------------


def schema_drift(spark: SparkSession, columns: Sequence[str], expected: Sequence[str], legacy: Sequence[str] = ()) -> DataFrame:
    """Findings about column names (names only, no data is read)."""
    lines = [("RED", "MISSING_COLUMN", c) for c in sorted(set(expected) - set(columns))]
    lines += [("YELLOW", "UNEXPECTED_COLUMN", c) for c in sorted(set(columns) - set(expected))]
    lines += [("RED", "LEGACY_COLUMN", c) for c in sorted(set(legacy) & set(columns))]
    return spark.createDataFrame(lines, "level string, code string, message string")


def count_expectations(df: DataFrame, unit: str, rows: int, units: int) -> DataFrame:
    per_unit = df.groupBy(unit).agg(F.count("*").alias("_n"))
    total = per_unit.agg(F.sum("_n").alias("rows"), F.count(unit).alias("units"))
    return total.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("quantity"), F.col("rows").alias("actual"), F.lit(rows).cast("bigint").alias("expected")),
        F.struct(F.lit("units").alias("quantity"), F.col("units").alias("actual"), F.lit(units).cast("bigint").alias("expected")),
    )).alias("_c")).select("_c.*").withColumn("matches", F.col("actual") == F.col("expected"))


def _domain_lines(df: DataFrame, domains: dict[str, Sequence[int]]) -> DataFrame:
    """Distinct values of the coded columns with counts and whether they are unexpected."""
    counted = unpivot(df, list(domains)).groupBy("column_name", "raw").agg(F.count("*").alias("n"))
    good = F.lit(False)
    for column, allowed in domains.items():
        good = good | ((F.col("column_name") == column) & _codes("raw", allowed))
    return counted.withColumn("bad", F.col("raw").isNotNull() & ~good)


def domain_audit(df: DataFrame, domains: dict[str, Sequence[int]]) -> DataFrame:
    return _domain_lines(df, domains).filter("bad").select("column_name", F.col("raw").alias("unexpected_value"), F.col("n").alias("count"))


def code_summary(df: DataFrame, domains: dict[str, Sequence[int]]) -> DataFrame:
    known, bad = F.col("raw").isNotNull(), F.col("bad")
    return _domain_lines(df, domains).groupBy("column_name").agg(
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("nonmissing"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(known & ~bad, F.col("n")).otherwise(0)).alias("evaluable"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("unexpected"),
        F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("raw")))), "|").alias("unexpected_values"),
    )


def missingness(df: DataFrame) -> DataFrame:
    """Per column: missing, percent, distinct values, type. Long text is compared by digest, so the shuffle stays small."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    narrow = df.select(*[F.sha2(F.col(c), 256).alias(c) if t == "string" else F.col(c) for c, t in types.items()])
    counted = unpivot(narrow, list(types)).groupBy("column_name", "raw").agg(F.count("*").alias("n"))
    table = counted.groupBy("column_name").agg(
        F.sum(F.when(F.col("raw").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.sum("n").alias("_all"), F.count("raw").alias("distinct_values"))
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return table.select(
        "column_name", "missing", (N(100) * S.safe_ratio(F.col("missing"), F.col("_all"))).alias("percent_missing"),
        "distinct_values", kind[F.col("column_name")].alias("data_type"))


# -- duplicates --------------------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row (nulls count as a value)."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All members of repeated keys. Counts are folded before the shuffle; the join back can split a hot key,
    which a window over the key could not."""
    repeated = duplicate_keys(df, keys).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "row_count")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(repeated, match).drop(*[f"_k{i}" for i in range(len(keys))])


def duplicate_groups(df: DataFrame, content: Column, path: str) -> DataFrame:
    """Exact-content groups with two or more members, numbered by their first member in path order."""
    from dyadlab.operators.ordering import positions

    groups = df.groupBy(content.alias("digest")).agg(F.count("*").alias("members"), F.min(path).alias("first_member")).filter("members > 1")
    return positions(groups, ["first_member"]).select((F.col("pos") + 1).alias("group_number"), "digest", "members", "first_member")


# -- units -------------------------------------------------------------------------------------------------------


def unit_structure(df: DataFrame, device: str = "device") -> DataFrame:
    """Structure of every unit in one aggregation (partials are folded before the shuffle)."""
    side = F.col(SIDE)
    counted = df.groupBy(UNIT).agg(
        F.count("*").alias("rows"), F.count_if(side == 1).alias("right_rows"), F.count_if(side == 2).alias("left_rows"),
        F.count_if(side.isNotNull() & ~side.isin(1, 2)).alias("invalid_rows"), F.sort_array(F.collect_set(device)).alias("_devices"),
    )
    has_r, has_l = F.col("right_rows") > 0, F.col("left_rows") > 0
    return counted.withColumns({
        "valid_sides": has_r.cast("int") + has_l.cast("int"),
        "pattern": F.when(has_r & has_l, "R+L").when(has_r, "R-only").when(has_l, "L-only").otherwise("none"),
        "has_both": (has_r & has_l).cast("int"),
        "valid_pair": ((F.col("right_rows") == 1) & (F.col("left_rows") == 1) & (F.col("invalid_rows") == 0)).cast("int"),
        "has_duplicate": ((F.col("right_rows") > 1) | (F.col("left_rows") > 1)).cast("int"),
        "devices": F.array_join("_devices", "|"), "device_count": F.size("_devices"),
    }).drop("_devices")


def cohort_structure(units: DataFrame) -> DataFrame:
    """Counts over the unit table."""
    is_on = lambda c: F.count_if(F.col(c) == 1)
    return units.agg(
        F.count("*").alias("units"), is_on("has_both").alias("with_both_sides"), is_on("valid_pair").alias("valid_pairs"),
        F.count_if(F.col("pattern") == "R-only").alias("right_only"), F.count_if(F.col("pattern") == "L-only").alias("left_only"),
        F.count_if(F.col("rows") > 2).alias("over_two_rows"), is_on("has_duplicate").alias("with_duplicate_side"),
        F.sum((F.col("right_rows") > 1).cast("bigint") + (F.col("left_rows") > 1).cast("bigint")).alias("duplicate_unit_sides"),
        F.count_if(F.col("device_count") > 1).alias("on_several_devices"),
    )


def within_unit_inconsistency(df: DataFrame, attributes: Sequence[str], unit: str = UNIT) -> DataFrame:
    """Units holding more than one value of a nominal unit attribute (null counts as a value)."""
    values = unpivot(df, attributes, [unit], "attribute").groupBy("attribute", unit, "raw").agg(F.lit(1).alias("_"))
    per_unit = values.groupBy("attribute", unit).agg(F.count("*").alias("values"))
    return per_unit.groupBy("attribute").agg(
        F.count_if(F.col("values") > 1).alias("inconsistent_units"), F.max("values").alias("max_values"))


def device_membership(units: DataFrame) -> DataFrame:
    return units.groupBy(F.col("devices").alias("membership")).agg(F.count("*").alias("units"))


# -- labels ------------------------------------------------------------------------------------------------------


def _label_lines(df: DataFrame, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    ok = _codes("raw", BINARY)
    return unpivot(df, labels, keep, "label_name").withColumns({
        "ok": ok, "positive": ok & (S.lenient_number(F.col("raw")) == 1), "known": F.col("raw").isNotNull()})


def label_summary(df: DataFrame, labels: Sequence[str], unit: str = UNIT) -> DataFrame:
    """Label totals; units are folded first, all labels of a unit in one line, so positive units need no distinct count."""
    texts = dealt(df.select(unit, *[F.col(c).cast("string").alias(f"_label{i}") for i, c in enumerate(labels)]), unit)
    counts = []
    for i in range(len(labels)):
        raw = F.col(f"_label{i}")
        ok = S.in_domain(raw, BINARY)
        counts += [
            F.count_if(ok).alias(f"_ok{i}"), F.count_if(ok & (S.lenient_number(raw) == 1)).alias(f"_pos{i}"),
            F.count_if(raw.isNull()).alias(f"_gone{i}"), F.count_if(raw.isNotNull() & ~ok).alias(f"_odd{i}")]
    per_unit = texts.groupBy(unit).agg(*counts)
    lines = per_unit.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label_name"), *[F.col(f"_{k}{i}").alias(k) for k in ("ok", "pos", "gone", "odd")]) for i, c in enumerate(labels)])).alias("_u")).select("_u.*")
    table = lines.groupBy("label_name").agg(
        F.sum("ok").alias("evaluable"), F.sum("pos").alias("positive"), F.sum(F.col("ok") - F.col("pos")).alias("negative"),
        F.sum("gone").alias("missing"), F.sum("odd").alias("unexpected"), F.count_if(F.col("pos") > 0).alias("positive_units"))
    return table.withColumn("prevalence", S.safe_ratio(F.col("positive"), F.col("evaluable")))


def _label_array(labels: Sequence[str], suffix: str = "") -> Column:
    """Array of (name, 0/1/null) with everything outside {0, 1} as null."""
    return F.array(*[
        F.struct(F.lit(c).alias("name"), F.when(S.in_domain(F.col(c + suffix), BINARY), S.lenient_number(F.col(c + suffix).cast("string"))).cast("int").alias("y"))
        for c in labels])


def label_cooccurrence(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Pairwise-complete intersections, unions and Jaccard of labels; pairs are formed inside the row, no join."""
    lines = df.select(_label_array(labels).alias("_l")).select(F.explode("_l").alias("a"), F.col("_l")).select("a", F.explode("_l").alias("b"))
    ya, yb = F.col("a.y"), F.col("b.y")
    return lines.groupBy(F.col("a.name").alias("label_a"), F.col("b.name").alias("label_b")).agg(
        F.count_if((ya == 1) & (yb == 1)).alias("both"),
        F.count_if(ya.isNotNull() & yb.isNotNull() & ((ya == 1) | (yb == 1))).alias("either"),
    ).withColumn("jaccard", S.safe_ratio(F.col("both"), F.col("either")))


def _cardinality(df: DataFrame, count: Column, level: str) -> DataFrame:
    table = df.select(count.alias("positive_labels")).filter(F.col("positive_labels").isNotNull()).groupBy("positive_labels").agg(F.count("*").alias("count"))
    total = table.agg(F.sum("count")).scalar()
    return table.select(
        F.lit(level).alias("level"), "positive_labels", "count", total.alias("evaluable"), S.safe_ratio(F.col("count"), total).alias("rate"))


def _total(columns: Sequence[Column]) -> Column:
    """Sum that is null when any part is null."""
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def label_cardinality(df: DataFrame, pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """How many labels are positive, per row and per pair (union of the sides)."""
    row = _total([_binary(c) for c in labels])
    union = _total([F.greatest(_both(c, "r"), _both(c, "l")) for c in labels])
    return _cardinality(df, row, "row").unionByName(_cardinality(pairs, union, "pair_union"))


def _binary(name: str) -> Column:
    return F.when(S.in_domain(F.col(name), BINARY), S.lenient_number(F.col(name).cast("string"))).cast("int")


def _both(name: str, side: str) -> Column:
    """The side's label, null unless both sides are evaluable."""
    return F.when(_binary(f"{name}_r").isNotNull() & _binary(f"{name}_l").isNotNull(), _binary(f"{name}_{side}"))


# -- quality, device ---------------------------------------------------------------------------------------------


def quality_summary(df: DataFrame, qualities: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Normal and abnormal counts of quality codes, overall or per key (device)."""
    lines = unpivot(df, qualities, keys, "quality")
    ok, code = _codes("raw", QUALITY), S.lenient_number(F.col("raw"))
    return lines.groupBy(*keys, "quality").agg(
        F.count_if(ok).alias("evaluable"), F.count_if(ok & (code == S.NORMAL)).alias("normal"), F.count_if(ok & (code == S.ABNORMAL)).alias("abnormal"),
        F.count_if(F.col("raw").isNull()).alias("missing"), F.count_if(F.col("raw").isNotNull() & ~ok).alias("unexpected"),
    ).withColumn("abnormal_rate", S.safe_ratio(F.col("abnormal"), F.col("evaluable")))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    table = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    return table.withColumn("rate", S.safe_ratio(F.col("count"), table.agg(F.sum("count")).scalar()))


def device_summary(df: DataFrame, device: str = "device", unit: str = UNIT) -> DataFrame:
    """Rows and units per device, as counts and shares. Units are folded per (device, unit) first."""
    per_unit = df.groupBy(device, unit).agg(F.count("*").alias("n"))
    table = per_unit.groupBy(device).agg(F.sum("n").alias("rows"), F.count("*").alias("units"))
    all_rows = table.agg(F.sum("rows")).scalar()
    all_units = per_unit.groupBy(unit).agg(F.sum("n").alias("n")).agg(F.count("*")).scalar()
    return table.withColumns({"row_fraction": S.safe_ratio(F.col("rows"), all_rows), "unit_fraction": S.safe_ratio(F.col("units"), all_units)})


def device_labels(df: DataFrame, labels: Sequence[str], device: str = "device") -> DataFrame:
    return _label_lines(df, labels, [device]).groupBy(device, "label_name").agg(
        F.count_if("ok").alias("evaluable"), F.count_if("positive").alias("positive"),
    ).withColumn("prevalence", S.safe_ratio(F.col("positive"), F.col("evaluable")))


def quality_by_label(df: DataFrame, qualities: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """2 x 2 counts of quality by label, both evaluable; formed inside the row."""
    quality = F.array(*[F.struct(F.lit(q).alias("name"), F.when(S.in_domain(F.col(q), QUALITY), S.lenient_number(F.col(q).cast("string"))).alias("code")) for q in qualities])
    lines = df.select(F.explode(quality).alias("q"), _label_array(labels).alias("_l")).select("q", F.explode("_l").alias("y"))
    ok = F.col("q.code").isNotNull() & F.col("y.y").isNotNull()
    bad, pos = F.col("q.code") == S.ABNORMAL, F.col("y.y") == 1
    table = lines.groupBy(F.col("q.name").alias("quality"), F.col("y.name").alias("label_name")).agg(
        F.count_if(ok).alias("evaluable"), F.count_if(ok & ~bad & ~pos).alias("normal_negative"), F.count_if(ok & ~bad & pos).alias("normal_positive"),
        F.count_if(ok & bad & ~pos).alias("abnormal_negative"), F.count_if(ok & bad & pos).alias("abnormal_positive"))
    rate = lambda top, other: S.safe_ratio(F.col(top), F.col(top) + F.col(other))
    return table.withColumns({
        "abnormal_rate_negative": rate("abnormal_negative", "normal_negative"), "abnormal_rate_positive": rate("abnormal_positive", "normal_positive")})


def device_demographics(df: DataFrame, age: str = "age", sex: str = "sex", device: str = "device") -> DataFrame:
    """Age and sex per device from units whose value does not vary within the device."""
    a, s = S.lenient_number(F.col(age).cast("string")), S.lenient_number(F.col(sex).cast("string"))
    units = df.groupBy(device, UNIT).agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(s).alias("s0"), F.max(s).alias("s1"))
    one_age, one_sex = F.col("a0") == F.col("a1"), F.col("s0") == F.col("s1")
    units = units.withColumns({"age": F.when(one_age, F.col("a0")), "sex": F.when(one_sex, F.col("s0"))})
    table = units.groupBy(device).agg(
        F.count("*").alias("units"), F.count("age").alias("age_evaluable"), F.count_if(F.col("a0") < F.col("a1")).alias("age_inconsistent"),
        F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"), F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        F.count("sex").alias("sex_evaluable"), F.count_if(F.col("s0") < F.col("s1")).alias("sex_inconsistent"),
        F.count_if(F.col("sex") == 1).alias("male"), F.count_if(F.col("sex") == 2).alias("female"), F.count_if(~F.col("sex").isin(1.0, 2.0)).alias("unexpected_sex"))
    return table.join(exact_quantiles(units, "age", {"age_median": 0.5}, [device]), device, "left")


# -- concordance of sides (inputs are wide pairs) ------------------------------------------------------------------


def _pair_lines(pairs: DataFrame, columns: Sequence[str], allowed: Sequence[int], name: str) -> DataFrame:
    """(name, r, l) codes per pair, null where the code is outside ``allowed``."""

    def code(c: str, s: str) -> Column:
        return F.when(S.in_domain(F.col(f"{c}_{s}"), allowed), S.lenient_number(F.col(f"{c}_{s}").cast("string")))

    return pairs.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), code(c, "r").alias("r"), code(c, "l").alias("l")) for c in columns])).alias("_p")).select("_p.*")


def _concordance(pairs: DataFrame, columns: Sequence[str], low: int, high: int, name: str, words: tuple[str, str]) -> DataFrame:
    r, l = F.col("r"), F.col("l")
    counted = _pair_lines(pairs, columns, (low, high), name).groupBy(name).agg(
        F.count_if(r.isNotNull() & l.isNotNull()).alias("evaluable_pairs"),
        F.count_if((r == high) & (l == high)).alias(f"both_{words[1]}"), F.count_if((r == low) & (l == low)).alias(f"both_{words[0]}"),
        F.count_if((r == high) & (l == low)).alias(f"right_{words[1]}_only"), F.count_if((r == low) & (l == high)).alias(f"left_{words[1]}_only"))
    table = counted.withColumn("discordant", F.col(f"right_{words[1]}_only") + F.col(f"left_{words[1]}_only"))
    return table.withColumn("discordance_rate", S.safe_ratio(F.col("discordant"), F.col("evaluable_pairs")))


def label_concordance(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    table = _concordance(pairs, labels, 0, 1, "label_name", ("negative", "positive"))
    some = F.col("both_positive") + F.col("discordant")
    return table.withColumns({"pairs_with_positive": some, "discordance_rate_among_positive": S.safe_ratio(F.col("discordant"), some)})


def quality_concordance(pairs: DataFrame, qualities: Sequence[str]) -> DataFrame:
    return _concordance(pairs, qualities, S.NORMAL, S.ABNORMAL, "quality", ("normal", "abnormal"))


def _all_ok(columns: Sequence[str], allowed: Sequence[int]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & S.in_domain(F.col(f"{c}_r"), allowed) & S.in_domain(F.col(f"{c}_l"), allowed)
    return ok


def _any_differs(columns: Sequence[str], allowed: Sequence[int]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (S.in_domain(F.col(f"{c}_r"), allowed) & S.in_domain(F.col(f"{c}_l"), allowed) &
                     (S.lenient_number(F.col(f"{c}_r").cast("string")) != S.lenient_number(F.col(f"{c}_l").cast("string"))))
    return out


def quality_pair_summary(pairs: DataFrame, qualities: Sequence[str]) -> DataFrame:
    ok, differs = _all_ok(qualities, QUALITY), _any_differs(qualities, QUALITY)
    return pairs.agg(
        F.count("*").alias("valid_pairs"), F.count_if(ok).alias("all_evaluable"), F.count_if(ok & differs).alias("any_discordant"),
    ).withColumn("any_discordance_rate", S.safe_ratio(F.col("any_discordant"), F.col("all_evaluable")))


def pair_structure(pairs: DataFrame, labels: Sequence[str], qualities: Sequence[str]) -> DataFrame:
    """One line per pair: label vectors of both sides compared, device and quality agreement."""

    def positives(s: str) -> Column:
        return F.array_compact(F.array(*[F.when(_binary(f"{c}_{s}") == 1, F.lit(c)) for c in labels]))

    sets = pairs.withColumns({"_r": positives("r"), "_l": positives("l")})
    shared, union = F.size(F.array_intersect("_r", "_l")), F.size(F.array_union("_r", "_l"))
    table = sets.select(
        UNIT, "device_r", "device_l", (F.col("device_r") == F.col("device_l")).cast("int").alias("same_device"),
        F.size("_r").alias("positive_r"), F.size("_l").alias("positive_l"), shared.alias("shared"), union.alias("union"),
        _all_ok(labels, BINARY).alias("evaluable"), _any_differs(qualities, QUALITY).cast("int").alias("any_quality_discordant"))
    return table.withColumns({
        "discordant": (F.col("shared") < F.col("union")).cast("int"),
        "jaccard": F.when(F.col("evaluable") & (F.col("union") > 0), F.col("shared") / F.col("union"))})


def vector_summary(structure: DataFrame) -> DataFrame:
    ok, some, differs = F.col("evaluable"), F.col("jaccard").isNotNull(), F.col("discordant") == 1
    table = structure.agg(
        F.count_if(ok).alias("evaluable_pairs"), F.count_if(ok & (F.col("union") == 0)).alias("no_positive"), F.count_if(some).alias("with_positive"),
        F.count_if(ok & ~differs).alias("identical"), F.count_if(ok & differs).alias("discordant"), F.avg("jaccard").alias("mean_jaccard"))
    return table.withColumns({
        "median_jaccard": exact_quantiles(structure, "jaccard", {"median_jaccard": 0.5}).scalar(),
        "discordance_rate_all": S.safe_ratio(F.col("discordant"), F.col("evaluable_pairs")),
        "discordance_rate_positive": S.safe_ratio(F.col("discordant"), F.col("with_positive"))})


def device_agreement(pairs: DataFrame) -> DataFrame:
    known = F.col("device_r").isNotNull() & F.col("device_l").isNotNull()
    return pairs.agg(
        F.count_if(known).alias("evaluable_pairs"), F.count_if(F.col("device_r") == F.col("device_l")).alias("same_device"),
        F.count_if(F.col("device_r") != F.col("device_l")).alias("different_device"),
    ).withColumn("different_rate", S.safe_ratio(F.col("different_device"), F.col("evaluable_pairs")))


def device_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.dropna(subset=["device_r", "device_l"]).groupBy("device_r", "device_l").agg(F.count("*").alias("pairs"))


def grade_difference(pairs: DataFrame, grades: Sequence[str], levels: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Distribution of |R - L| of ordinal grades with its mean, median and maximum. A difference takes at most
    ``len(levels)`` values, so the median is read off the counts."""
    lines = _pair_lines(pairs, grades, levels, "grade").select("grade", F.abs(F.col("r") - F.col("l")).cast("int").alias("difference"))
    counts = lines.filter(F.col("difference").isNotNull()).groupBy("grade", "difference").agg(F.count("*").alias("count"))
    packed = counts.groupBy("grade").agg(
        F.sum("count").alias("evaluable_pairs"), F.sum(F.col("difference") * F.col("count")).alias("_total"), F.max("difference").alias("max_difference"),
        F.sort_array(F.collect_list(F.struct("difference", "count"))).alias("_levels"))

    def at(position: Column) -> Column:  # value at a 0-based position of the expanded, sorted differences
        walk = F.aggregate("_levels", F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("value")), lambda acc, x: F.struct(
            (acc["seen"] + x["count"]).alias("seen"),
            F.coalesce(acc["value"], F.when(acc["seen"] + x["count"] > position, x["difference"])).alias("value")))
        return walk["value"]

    last = F.col("evaluable_pairs") - 1
    middle = (at(F.floor(last / 2)) + at(F.ceil(last / 2))) / N(2)
    overall = packed.select("grade", "evaluable_pairs", "max_difference", (F.col("_total") / F.col("evaluable_pairs")).alias("mean_difference"), middle.alias("median_difference"))
    return counts.join(F.broadcast(overall), "grade").withColumn("rate", S.safe_ratio(F.col("count"), F.col("evaluable_pairs")))


def grade_label_consistency(df: DataFrame, label: str, grades: Sequence[str], levels: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Binary label against each ordinal grade: negative with a grade above zero, positive with grade zero."""
    y = _binary(label)
    lines = df.select(y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(g).alias("grade"), F.when(S.in_domain(F.col(g), levels), S.lenient_number(F.col(g).cast("string"))).alias("g")) for g in grades])).alias("_g")).select("y", "_g.*")
    y, g = F.col("y"), F.col("g")
    return lines.groupBy("grade").agg(
        F.count_if(y.isNotNull() & g.isNotNull()).alias("evaluable"), F.count_if((y == 0) & (g == 0)).alias("negative_zero"), F.count_if((y == 0) & (g > 0)).alias("negative_graded"),
        F.count_if((y == 1) & (g == 0)).alias("positive_zero"), F.count_if((y == 1) & (g > 0)).alias("positive_graded"))


# -- leakage -----------------------------------------------------------------------------------------------------


def split_leakage(rows: DataFrame, split: str, unit: str = UNIT) -> DataFrame:
    """Units of any split table that fall in more than one split."""
    per_unit = rows.groupBy(unit).agg(F.count("*").alias("n"), F.min(split).alias("lo"), F.max(split).alias("hi"))
    return _leakage(per_unit, [])


def _leakage(per_unit: DataFrame, keys: Sequence[str]) -> DataFrame:
    table = per_unit.groupBy(*keys).agg(
        F.count("*").alias("units"), F.count_if(F.col("n") > 1).alias("repeated_units"), F.count_if(F.col("lo") != F.col("hi")).alias("units_in_several"))
    return table.withColumns({
        "fraction_all": S.safe_ratio(F.col("units_in_several"), F.col("units")), "fraction_repeated": S.safe_ratio(F.col("units_in_several"), F.col("repeated_units"))})


def _digest_cuts(digests: DataFrame, repeats: int, n: int, targets: dict[str, int]) -> dict[tuple[int, str], str]:
    """Digest of the k-th of the n rows in order of ``_digest0``, ``_digest1``, ..., for each target k above 0, by (repeat, target).

    Digests are uniform, so the k-th lies within a few standard deviations of the share k / n, unless row keys repeat. One pass
    counts what lies below these brackets, one folds what lies in them; a bracket that misses its row is replaced by ``hash_cuts``.
    """
    def bound(share: float) -> str:
        return "g" if share >= 1 else format(int(max(share, 0.0) * 16**13), "013x")  # "g" is above all digests

    brackets = {}
    for name, k in targets.items():
        reach = BRACKET_DEVIATIONS * (k * max(n - k, 0) / n) ** 0.5 + 1 if n else 0
        if k > 0:
            brackets |= {(r, name): (k, bound((k - reach) / n), bound((k + reach) / n)) for r in range(repeats)}
    if not brackets:
        return {}
    below = digests.agg(*[F.count_if(F.col(f"_digest{r}") < low).alias(f"{r}/{name}") for (r, name), (_, low, _) in brackets.items()]).first()
    inside = lambda r, low, high: (F.col(f"_digest{r}") >= low) & (F.col(f"_digest{r}") < high)
    held = [F.when(inside(r, low, high), F.struct(
        F.lit(r).alias("r"), F.lit(name).alias("name"), F.lit(k - below[f"{r}/{name}"]).alias("nth"), F.col(f"_digest{r}").alias("digest"))) for (r, name), (k, low, high) in brackets.items()]
    # no filter before the lines are made: it would move below the digests and make each of them anew for every bracket
    near = digests.select(F.explode(F.array(*held)).alias("_h")).filter("_h IS NOT NULL").select("_h.*").groupBy("r", "name", "nth", "digest").agg(F.count("*").alias("_n"))
    upto = near.withColumn("_upto", F.sum("_n").over(Window.partitionBy("r", "name").orderBy("digest")))
    cuts = {(x["r"], x["name"]): x["digest"] for x in upto.filter("nth BETWEEN _upto - _n + 1 AND _upto").collect()}  # a digest a target
    missed = [x for x in brackets if x not in cuts]
    if missed:
        drawn = digests.select(F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"_digest{r}").alias("digest")) for r in sorted({r for r, _ in missed})])).alias("_d")).select("_d.*")
        wanted = digests.sparkSession.createDataFrame([(r, name, targets[name]) for r, name in missed], "r int, name string, k bigint")
        cuts |= {(x["r"], x["name"]): x["cut"] for x in hash_cuts(drawn, "digest", wanted, ["r"], "name").collect()}
    return cuts


def row_split_leakage(rows: DataFrame, row_key: Sequence[str], repeats: int, seed: int, shares: tuple[float, float] = (0.70, 0.15), unit: str = UNIT) -> DataFrame:
    """What a row-level split would do to units, over repeated hash-ordered splits of exact sizes.

    Splits are found from two cut digests per repeat, so no repeat is sorted as a whole and no digest is shuffled.
    """
    whole = rows.filter(F.col(unit).isNotNull())
    numbers = [i for i, c in enumerate(row_key) if isinstance(rows.schema[c].dataType, NumericType)]
    # the text that is digested is made once a row, and spread before the repeats multiply the work
    keyed = whole.select(unit, S.joined_parts(*[F.col(c) for c in row_key], numbers=numbers).alias("_key")).hint("rebalance")
    digest = lambda r: F.sha2(F.concat(S.joined_parts(F.lit(str(seed)), r), F.lit("|"), F.col("_key")), 256)
    digests = keyed.select(unit, *[digest(F.lit(r)).alias(f"_digest{r}") for r in range(repeats)])
    n = whole.count()
    first, second = (round(share * n) for share in shares)
    cuts = _digest_cuts(digests, repeats, n, {"train": first, "validation": first + second})
    at = lambda r, split: F.col(f"_digest{r}") <= F.lit(cuts.get((r, split), ""))
    split_of = lambda r: F.when(at(r, "train"), 1).when(at(r, "validation"), 2).otherwise(4)
    # a unit is one line for all repeats: three bits a repeat say which splits it lies in
    words = [range(i, min(i + 20, repeats)) for i in range(0, repeats, 20)]
    seen = [F.bit_or(reduce(Column.bitwiseOR, [F.shiftleft(split_of(r).cast("bigint"), 3 * (r % 20)) for r in word])).alias(f"_seen{i}") for i, word in enumerate(words)]
    units = digests.groupBy(unit).agg(F.count("*").alias("n"), *seen)
    of = lambda r: F.bit_count(F.shiftrightunsigned(f"_seen{r // 20}", 3 * (r % 20)).bitwiseAND(F.lit(7)))
    per_unit = units.select("n", F.explode(F.array(*[F.struct(F.lit(r).alias("repetition"), F.lit(1).alias("lo"), of(r).alias("hi")) for r in range(repeats)])).alias("_u")).select("n", "_u.*")
    return _leakage(per_unit, ["repetition"])


def _falling(of: Column, among: Column, k: Column) -> Column:
    """Chance that k rows drawn from ``among`` without replacement all come from ``of`` of them."""
    steps = F.sequence(F.lit(0).cast("bigint"), k - 1)
    log = F.aggregate(steps, N(0), lambda t, i: t + F.log((of - i) / (among - i)))
    return F.when(k == 0, N(1)).when(of < k, N(0)).otherwise(F.exp(log))


def expected_row_leakage(rows: DataFrame, shares: Sequence[float] = (0.70, 0.15), unit: str = UNIT) -> DataFrame:
    """Mean and deviation, over all row-level splits of the exact sizes, of the number of units that lie in several splits.

    One line: rows, units, expected, deviation. ``shares`` are rounded to rows, what is left is one more split. Nothing is
    drawn: a unit's chance to stay whole depends on its number of rows alone, and a pair's on both numbers, so all follows
    from the histogram of sizes. A unit larger than ``most`` rows stays whole with a chance below the least double, hence
    pairs are only formed of sizes up to ``most`` (some 2,100 for a share of 0.7), however large the hottest unit. Null
    units take no part. Without rows the values are null.
    """
    top = max([*shares, 1 - sum(shares)])
    most = math.ceil(-745 / math.log(top)) if 0 < top < 1 else None
    if most is None:
        raise ValueError("shares must leave at least two splits")
    sizes = rows.filter(F.col(unit).isNotNull()).groupBy(unit).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum(F.col("k") * F.col("c")).alias("n"), F.sum("c").alias("units"))
    cuts = [F.rint(N(s) * F.col("n")).cast("bigint") for s in shares]
    total = total.withColumn("splits", F.array(*cuts, F.col("n") - sum(cuts[1:], cuts[0])))
    live = sizes.filter(F.col("k") <= most).withColumn("_t", total.select(F.struct("n", "splits")).scalar()).select("k", "c", "_t.*")
    live = live.withColumn("a", F.transform("splits", lambda m: _falling(m, F.col("n"), F.col("k"))))
    plus = lambda xs: F.aggregate(xs, N(0), lambda t, x: t + x)
    live = live.withColumn("p", plus(F.col("a")))
    others = live.select(F.struct(F.col("k").alias("j"), F.col("c").alias("d"), F.col("a").alias("b"), F.col("p").alias("q")).alias("o")).agg(F.collect_list("o")).scalar()  # at most ``most`` sizes
    pairs = live.withColumn("o", F.explode(others)).select("k", "c", "n", "splits", "a", "p", "o.*")
    times = F.col("c") * (F.col("d") - (F.col("j") == F.col("k")).cast("bigint"))
    pairs = pairs.withColumn("times", times).filter("times > 0")
    rest = F.col("n") - F.col("k")  # once k rows of one unit are placed
    same = F.transform(F.arrays_zip("splits", "a"), lambda z: z["a"] * _falling(z["splits"] - F.col("k"), rest, F.col("j")))
    apart = F.transform(F.arrays_zip("splits", "a", "b"), lambda z: z["a"] * (F.col("q") - z["b"]))
    # other splits lose nothing to the first unit, but are drawn from the rest
    both = plus(same) + plus(apart) / _falling(rest, F.col("n"), F.col("j"))
    spread = pairs.agg(F.sum(F.col("times") * (both - F.col("p") * F.col("q"))).alias("cov"))
    sums = live.agg(F.sum(F.col("c") * F.col("p")).alias("whole"), F.sum(F.col("c") * F.col("p") * (N(1) - F.col("p"))).alias("own"))
    packed = total.withColumns({"_s": sums.select(F.struct("whole", "own")).scalar(), "_v": spread.scalar()})
    some = F.col("n").isNotNull()
    variance = F.greatest(F.coalesce(F.col("_s.own"), N(0)) + F.coalesce(F.col("_v"), N(0)), N(0))
    return packed.select(
        F.coalesce("n", F.lit(0)).alias("rows"), F.coalesce("units", F.lit(0)).alias("units"),
        F.when(some, F.col("units") - F.coalesce(F.col("_s.whole"), N(0))).alias("expected"), F.when(some, F.sqrt(variance)).alias("deviation"))


def variable_register(df: DataFrame, guidance: DataFrame, default: dict[str, str]) -> DataFrame:
    """Every column with its dictionary entry, or the default for unknown columns."""
    columns = df.sparkSession.createDataFrame([(c,) for c in df.columns], "variable string")
    joined = columns.join(guidance, "variable", "left")
    return joined.select("variable", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in default.items()])


def findings_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level").agg(F.count("*").alias("findings"))
