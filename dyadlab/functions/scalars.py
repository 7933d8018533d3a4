"""Column expressions for losses, codes, pair classes and keys. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRIMARY_CLIP = 1e-6
SENSITIVITY_CLIPS = (1e-5, 1e-7)
CLASS_THRESHOLD = 0.5
NORMAL, ABNORMAL = 1, 2
STATES = ("00", "11", "10", "01")
DIRECTIONAL_STRATA = (
    "both_satisfactory",
    "own_abnormal__fellow_satisfactory",
    "own_satisfactory__fellow_abnormal",
    "both_abnormal",
    "unevaluable",
)
AGE_EDGES = (40, 60, 80)
AGE_LABELS = ("under_40", "40_to_59", "60_to_79", "80_or_older")
AGE_MISSING = "missing_or_inconsistent"


def number(value: float) -> Column:
    return F.lit(float(value))


# -- probabilities and losses ------------------------------------------------------------------------------------


def clip_probability(p: Column, eps: float = PRIMARY_CLIP) -> Column:
    return F.greatest(number(eps), F.least(number(1.0 - eps), p))


def binary_nll(y: Column, p: Column, eps: float = PRIMARY_CLIP) -> Column:
    q = clip_probability(p, eps)
    return -(y * F.log(q) + (number(1) - y) * F.log1p(-q))


def logit(p: Column, eps: float = PRIMARY_CLIP) -> Column:
    q = clip_probability(p, eps)
    return F.log(q) - F.log1p(-q)


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow on either tail."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, number(1) / (number(1) + e)).otherwise(e / (number(1) + e))


def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def confidence(p: Column) -> Column:
    return F.greatest(p, number(1) - p)


def predicted_class(p: Column, threshold: float = CLASS_THRESHOLD) -> Column:
    return (p >= number(threshold)).cast("int")


def is_clipped(p: Column, eps: float = PRIMARY_CLIP) -> Column:
    return (p < number(eps)) | (p > number(1.0 - eps))


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null, never zero or an error, on a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


# -- codes -------------------------------------------------------------------------------------------------------


def lenient_number(value: Column) -> Column:
    return value.try_cast("double")


def in_domain(value: Column, allowed: Sequence[int]) -> Column:
    """False, not null, for a missing or unreadable code."""
    return F.coalesce(lenient_number(value.cast("string")).isin([float(v) for v in allowed]), F.lit(False))


def unevaluable(quality: Column) -> Column:
    return ~F.coalesce(quality.isin(NORMAL, ABNORMAL), F.lit(False))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def indicator_columns(q1: Column, q2: Column, side: Column, device: Column, second_device: str) -> dict[str, Column]:
    """The five categorical predictors of the loss models, in design order."""
    return {
        "q1_abnormal": flag(q1 == ABNORMAL),
        "q2_abnormal": flag(q2 == ABNORMAL),
        "q2_unevaluable": flag(unevaluable(q2)),
        "side_right": flag(side == 1),
        "device_second": flag(device == second_device),
    }


def code_label(value: Column, labels: dict[int, str]) -> Column:
    """Label of a code; an unmapped code stops the job."""
    chain = None
    for code, text in labels.items():
        chain = F.when(value == code, F.lit(text)) if chain is None else chain.when(value == code, F.lit(text))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unmapped code: "), F.coalesce(value.cast("string"), F.lit("null")))))


# -- pair classes ------------------------------------------------------------------------------------------------


def device_pair(right: Column, left: Column, first: str, second: str) -> Column:
    """Both on the first device, both on the second, or mixed (anything else, nulls included)."""
    return (
        F.when((right == first) & (left == first), F.lit(f"{first}/{first}"))
        .when((right == second) & (left == second), F.lit(f"{second}/{second}"))
        .otherwise(F.lit("mixed"))
    )


def _quality_word(q: Column, good: str) -> Column:
    return F.when(q == NORMAL, F.lit(good)).when(q == ABNORMAL, F.lit("abnormal"))


def quality_pattern_by_side(right: Column, left: Column) -> Column:
    """R_x__L_y where an unevaluable side is named on its own side."""
    missing = F.lit("unevaluable")
    return F.concat(
        F.lit("R_"), F.coalesce(_quality_word(right, "normal"), missing),
        F.lit("__L_"), F.coalesce(_quality_word(left, "normal"), missing),
    )


def quality_pattern_whole(right: Column, left: Column) -> Column:
    """R_x__L_y, or 'unevaluable' for the whole pair when either side is."""
    pattern = F.concat(
        F.lit("R_"), _quality_word(right, "satisfactory"), F.lit("__L_"), _quality_word(left, "satisfactory")
    )
    return F.coalesce(pattern, F.lit("unevaluable"))


def directional_stratum(own: Column, partner: Column) -> Column:
    """Own x partner quality in five levels."""
    both, own_bad, partner_bad, neither, unknown = map(F.lit, DIRECTIONAL_STRATA)
    return (
        F.when((own == NORMAL) & (partner == NORMAL), both)
        .when((own == ABNORMAL) & (partner == NORMAL), own_bad)
        .when((own == NORMAL) & (partner == ABNORMAL), partner_bad)
        .when((own == ABNORMAL) & (partner == ABNORMAL), neither)
        .otherwise(unknown)
    )


def pair_state(right: Column, left: Column) -> Column:
    return F.concat(right.cast("int").cast("string"), left.cast("int").cast("string"))


def reconciled_code(right: Column, left: Column, labels: dict[str, str], missing: str) -> Column:
    """Unit label of a code held by both sides; 'inconsistent' where the sides differ."""
    chain = F.when(~right.eqNullSafe(left), F.lit("inconsistent"))
    for code, text in labels.items():
        chain = chain.when(right == code, F.lit(text))
    return chain.otherwise(F.lit(missing))


def reconciled_number(right: Column, left: Column) -> Column:
    """The sides' common finite value, else null."""
    value = lenient_number(right.cast("string"))
    finite = ~F.isnan(value) & (F.abs(value) < number(float("inf")))
    return F.when(right.eqNullSafe(left) & finite, value)


def band(value: Column, edges: Sequence[float], labels: Sequence[str], missing: str) -> Column:
    chain = F.when(value.isNull(), F.lit(missing))
    for edge, text in zip(edges, labels):
        chain = chain.when(value < number(edge), F.lit(text))
    return chain.otherwise(F.lit(labels[-1]))


# -- keys and output ---------------------------------------------------------------------------------------------


def keyed_digest(seed: str | int, *parts: Column) -> Column:
    """sha256 hex of ``seed|part|part...``; the only source of randomness in the package."""
    return keyed_digest_of(F.lit(str(seed)), *parts)


def keyed_digest_of(*parts: Column) -> Column:
    return F.sha2(joined_parts(*parts), 256)


def joined_parts(*parts: Column, numbers: Sequence[int] = ()) -> Column:
    r"""``part|part...`` as a string that tells all lists of parts apart: ``\`` and ``|`` inside a part are preceded by ``\``,
    and null is ``\N``, which no part becomes. ``numbers``: places of parts that are numbers, in which nothing is looked for."""
    escaped = lambda p: F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *[F.coalesce(p.cast("string") if i in numbers else escaped(p), F.lit("\\N")) for i, p in enumerate(parts)])


def digest_int(digest: Column, start: int, digits: int = 15) -> Column:
    """Non-negative integer from ``digits`` hex digits; 15 digits keep modulo bias below n / 2**60."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def whole_number(key: Column) -> Column:
    """The id as a number, null if it is none. A failing cast costs an exception, so text with other characters is not cast."""
    text = key.cast("string")
    return F.when(text.rlike(r"^[0-9+\-\x00-\x20\x7f]+$"), text.try_cast("bigint"))


def numeric_first(key: Column) -> list[Column]:
    """Sort keys: numeric ids ascending, then the rest as text. Long tables should sort by a stored :func:`whole_number`, as a sort
    evaluates its keys at every comparison."""
    return [whole_number(key).asc_nulls_last(), key.cast("string").asc()]


def fixed_decimals(value: Column, places: int = 8) -> Column:
    return F.format_string(f"%.{places}f", value)
