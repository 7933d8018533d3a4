"""Pairing: rows to one line per unit and back, attaching attributes, join contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlab.session import dealt

UNIT, SIDE = "unit_id", "side"


def pair_wide(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = (), unit: str = UNIT, side: str = SIDE, strict: bool = False) -> DataFrame:
    """One line per unit that has exactly one row on each side; each value becomes ``value_r`` and ``value_l``.

    One aggregation with map-side partials instead of a self-join: a unit that holds a large share of the rows is
    folded before the shuffle, and repeated sides can never multiply. Numeric values keep it a hash aggregation.
    Other units are left out; with ``strict`` the first one met fails the query and is named.
    """
    right, left = F.col(side) == 1, F.col(side) == 2
    picks = []
    for value in values:
        picks += [F.max(F.when(right, F.col(value))).alias(f"{value}_r"), F.max(F.when(left, F.col(value))).alias(f"{value}_l")]
    counted = rows.groupBy(*keys, unit).agg(
        F.count("*").alias("_rows"), F.count_if(right).alias("_right"), F.count_if(left).alias("_left"), *picks
    )
    whole = (F.col("_rows") == 2) & (F.col("_right") == 1) & (F.col("_left") == 1)
    if strict:
        told = F.concat(F.lit("unit without exactly one row a side: "), F.coalesce(F.col(unit).cast("string"), F.lit("null")))
        whole = F.when(whole, True).otherwise(F.raise_error(told).cast("boolean"))
    return counted.filter(whole).drop("_rows", "_right", "_left")


def pair_sides(pairs: DataFrame, values: Sequence[str], carry: Sequence[str] = (UNIT,)) -> DataFrame:
    """The inverse of :func:`pair_wide`, with every value of the other side as ``partner_value``. No shuffle."""

    def one(code: int, own: str, other: str):
        return F.struct(
            F.lit(code).alias(SIDE),
            *[F.col(f"{v}_{own}").alias(v) for v in values],
            *[F.col(f"{v}_{other}").alias(f"partner_{v}") for v in values],
        )

    return pairs.select(*carry, F.explode(F.array(one(1, "r", "l"), one(2, "l", "r"))).alias("_s")).select(*carry, "_s.*")


def with_partner(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of complete pairs with the partner's ``values`` beside their own."""
    return pair_sides(pair_wide(rows, values, keys), values, [*keys, UNIT])


def attach_unit(rows: DataFrame, units: DataFrame, on: str | Sequence[str] = UNIT, required: str | None = None) -> DataFrame:
    """Left-join per-unit attributes onto rows. No broadcast hint: the unit table grows with the data, so the
    choice (and the splitting of a hot unit) is left to adaptive execution. ``required`` names a column that
    must be found for every row."""
    joined = rows.join(units, on, "left")
    if required:
        joined = joined.withColumn(
            required, F.when(F.col(required).isNull(), F.raise_error(F.lit(f"row without {required}"))).otherwise(F.col(required))
        )
    return joined


class CardinalityError(ValueError):
    """A join key that should be unique is not."""


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, validate: str) -> DataFrame:
    """Join after checking ``one_to_one`` or ``many_to_one`` on the constrained sides."""
    constrained = {"one_to_one": (left, right), "many_to_one": (right,)}[validate]
    for table in constrained:
        repeated = table.groupBy(*on).count().filter("count > 1")
        if not repeated.isEmpty():
            raise CardinalityError(f"{validate} join on {list(on)}: repeated keys")
    return left.join(right, list(on), how)


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str], both: bool = True) -> DataFrame:
    """Keys on one side only, labelled by where they are; null keys are equal. Both sides are folded in one exchange, whose
    partitions follow the number of rows."""
    sides = left.select(*on, F.lit(True).alias("_left")).unionByName(right.select(*on, F.lit(False).alias("_left")))
    found = dealt(sides, *on).groupBy(*on).agg(F.bool_or("_left").alias("_l"), F.bool_and("_left").alias("_only"))
    one = found.filter((F.col("_only") | ~F.col("_l")) if both else F.col("_only"))
    return one.select(*on, F.when(F.col("_l"), "left_only").otherwise("right_only").alias("found_in"))
