"""Weighted surveys: percent positive, shares of an answer, indices of indices, correlation across units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.operators.slices import with_slice


def weighted_share(answer: Column | str, hits: Sequence[str], base: Sequence[str], weight: Column | str = "w") -> Column:
    """100 times the weight of the hits over the weight of the base; answers outside the base count nowhere."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    weight = F.col(weight) if isinstance(weight, str) else weight
    part = F.sum(F.when(answer.isin(*hits), weight).otherwise(0.0))
    whole = F.sum(F.when(answer.isin(*base), weight).otherwise(0.0))
    return F.try_divide(100.0 * part, whole)


def percent_positive(item: str, weight: Column | str = "w") -> Column:
    return weighted_share(item, fixed.POSITIVE_ANSWERS, fixed.VALID_ANSWERS, weight)


def by_unit(responses: DataFrame, unit: str, aggregates: Sequence[Column], minimum: int = fixed.MIN_RESPONDENTS) -> DataFrame:
    """Aggregates per unit with at least `minimum` respondents."""
    return (
        responses.filter(F.col(unit).isNotNull() & (F.col(unit) != ""))
        .groupBy(unit)
        .agg(F.count(F.lit(1)).alias("n_resp"), *aggregates)
        .filter(F.col("n_resp") >= minimum)
    )


def with_total(responses: DataFrame, unit: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates per unit and for the whole. The total row is told apart by its grouping, not by a null unit."""
    return responses.groupingSets([[F.col(unit)], []], F.col(unit)).agg(
        F.grouping(unit).alias("_total"), F.count(F.lit(1)).alias("n_resp"), *aggregates
    ).withColumn(unit, F.when(F.col("_total") == 1, fixed.WHOLE_UNIT).otherwise(F.col(unit))).drop("_total")


def answer_meaning(responses: DataFrame, code: str, year: str, codes: DataFrame) -> DataFrame:
    """Attach the meaning of an answer code, which changes from year to year. `codes` is (year, code, meaning)."""
    return responses.join(
        codes.select(F.col("year").alias(year), F.col("code").alias(code), "meaning"), [year, code], "left"
    )


def missing_share(answer: Column | str, valid: Sequence[str] = fixed.LEAVING_ANSWERS) -> tuple[Column, Column]:
    """Number of valid answers, and the percentage of respondents without one."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    ok = F.coalesce(answer.isin(*valid), F.lit(False))
    return F.sum(F.when(ok, 1).otherwise(0)), 100.0 * F.sum(F.when(ok, 0).otherwise(1)) / F.count(F.lit(1))


def index_of_indices(items: DataFrame, keys: Sequence[str], members: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Mean of sub-index means. A sub-index lacking an item, or an index lacking a sub-index, does not exist.

    `items` is (keys, item, value); `members` is (item, subindex); `expected` is the number of items of each.
    """
    wanted = F.lit(None).cast("int")
    for name, count in expected.items():
        wanted = F.when(F.col("subindex") == name, count).otherwise(wanted)
    parts = (
        items.filter(F.col("value").isNotNull())
        .join(members, "item")
        .groupBy(*keys, "subindex")
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("found"))
        .filter(F.col("found") == wanted)
    )
    return parts.groupBy(*keys).agg(F.avg("mean").alias("index"), F.count(F.lit(1)).alias("parts")).filter(
        F.col("parts") == len(expected)
    ).drop("parts")


def top_two_box(options: Column | str) -> Column:
    """Percent positive from five option percentages; the sixth, 'do not know', is no part of the base."""
    options = F.col(options) if isinstance(options, str) else options
    five = F.slice(options, 1, 5)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return F.when((F.size(options) >= 6) & (total(five) > 0), 100.0 * total(F.slice(options, 4, 2)) / total(five))


def average_rank(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, value, rank): average ranks of the distinct values, computed without gathering a group in one task.

    Values are counted first, so ties are single rows. Quantile cut points split the value range into slices;
    ranks are running counts inside a slice plus the total of the slices before it. Cut points only balance the
    slices, the ranks are exact whatever they are.
    """
    group = list(group)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("times"))
    sliced = with_slice(counts, "value", "slice")
    totals = sliced.groupBy(*group, "slice").agg(F.sum("times").alias("in_slice"))
    # One row per slice, so this window is small for any input.
    whole = Window.partitionBy(*(group or [F.lit(0)])).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("in_slice").over(whole), F.lit(0))).drop("in_slice")
    inside = Window.partitionBy(*group, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.join(offsets, [*group, "slice"])
        .withColumn("below", F.coalesce(F.sum("times").over(inside), F.lit(0)) + F.col("offset"))
        .select(*group, "value", (F.col("below") + (F.col("times") + 1) / 2.0).alias("rank"))
    )


def correlations(units: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns across units, in one row."""
    rows = units.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = (
        rows.join(average_rank(rows, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx")), "x")
        .join(average_rank(rows, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry")), "y")
    )
    return ranked.agg(
        F.count(F.lit(1)).alias("units"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman")
    )
