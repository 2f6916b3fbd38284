"""The value table: one row per measure, node, period and dimension value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywell import fixed_values as fixed

VALUE_SCHEMA = T.StructType(
    [
        T.StructField("measure", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("period_type", T.StringType()),
        T.StructField("period_start", T.DateType()),
        T.StructField("dim", T.StringType()),
        T.StructField("dim_value", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("notation", T.StringType()),
        T.StructField("source_ref", T.StringType()),
    ]
)
VALUE_COLUMNS = VALUE_SCHEMA.fieldNames()
KEY_COLUMNS = ["measure", "node", "period_type", "period_start", "dim", "dim_value"]


def as_values(df: DataFrame, **fixed: Column | str | None) -> DataFrame:
    """Shape a frame into the value table; columns it lacks become constants or typed nulls."""
    out = []
    for field in VALUE_SCHEMA:
        if field.name in fixed:
            given = fixed[field.name]
            column = given if isinstance(given, Column) else F.lit(given)
        elif field.name in df.columns:
            column = F.col(field.name)
        else:
            column = F.lit(None)
        out.append(column.cast(field.dataType).alias(field.name))
    return df.select(*out)


def flat(values: DataFrame) -> DataFrame:
    """Rows without a dimension, the only ones calculations use."""
    return values.filter(F.col("dim").isNull())


# Alphabetical, so that the highest rank is the greatest text. Ranks let a maximum of notations run in a hash
# aggregate; a maximum of strings would sort all rows first.
NOTATIONS = tuple(sorted((fixed.ESTIMATE, fixed.INCOMPLETE, fixed.NOT_AVAILABLE, fixed.SUPPRESSED)))


def notation_rank(notation: Column | str) -> Column:
    """Place of a notation in its closed vocabulary; any other text is an error."""
    notation = F.col(notation) if isinstance(notation, str) else notation
    out = F.when(notation.isNull(), F.lit(None).cast("int"))
    for rank, name in enumerate(NOTATIONS, 1):
        out = out.when(notation == name, rank)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown notation: "), notation)).cast("int"))


def notation_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for place, name in enumerate(NOTATIONS, 1):
        out = F.when(rank == place, name).otherwise(out)
    return out
