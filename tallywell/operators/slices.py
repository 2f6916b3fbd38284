"""Order-preserving slices, for numbering and ranking without one long sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.session import materialise

SIDE = 16  # slices are SIDE * SIDE


def _number(value: Column, kind: str) -> Column:
    if kind == "date":
        return F.unix_date(value)
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    return value


def with_range(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the number of the range that a row falls into when all rows are cut into ranges of similar size.

    The cuts look at the whole order and at a hash of the row after it, so rows that are equal in the first columns, or
    in the whole order, are cut as well; only rows that are the same in every column stay together. Rows are written
    with their number, as a second run of the same sampling might cut elsewhere.
    """
    ranged = df.repartitionByRange(*order, F.xxhash64(*df.columns))
    return materialise(ranged.withColumn(name, F.spark_partition_id()), "ranges")


def with_slice(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the slice of a numeric, date or time column; nulls fall into slice 0.

    Cut points are approximate quantiles of the whole column, so a value range that holds most rows is cut most
    often. They come in as one small array, and a row finds its slice in two steps of SIDE comparisons.
    """
    value = _number(F.col(column), dict(df.dtypes)[column])
    points = [i / (SIDE * SIDE) for i in range(1, SIDE * SIDE)]
    cuts = df.select(F.percentile_approx(value, points, 2000)).scalar()
    coarse = F.transform(F.sequence(F.lit(SIDE), F.lit(SIDE * (SIDE - 1)), F.lit(SIDE)), lambda i: F.element_at("_cuts", i))

    def below(points: Column, at: Column) -> Column:
        return F.size(F.filter(points, lambda c: c < at))

    found = df.withColumn("_cuts", cuts).withColumn("_value", value).withColumn("_block", below(coarse, F.col("_value")) * SIDE)
    fine = F.slice("_cuts", F.col("_block") + 1, SIDE - 1)
    place = F.when(F.col("_cuts").isNotNull() & F.col("_value").isNotNull(), F.col("_block") + below(fine, F.col("_value")))
    return found.withColumn(name, F.coalesce(place, F.lit(0))).drop("_cuts", "_value", "_block")
