"""The value table stored by node: shelves of known size, read without a shuffle and node by node.

A shelf is a bucket of a stored table, sorted by node, with bloom filters on node and measure. The bucket of a row follows
from its `place`: the node, or for a node with more rows than fit a shelf the node and a slice number. The slice depends on
the series (measure, dimension and its value), so a crowded node stands on several shelves and a series never on two. A
series has one row per period, which the calendar bounds.

What groups by `place` and the columns of a series therefore needs no exchange, however the rows are spread; and one node is
read from the shelves of its places alone, of which the directory, a row per node, keeps the number of slices.

Defined results: a null node has a place of its own and is found by `node_rows(None)`; rows that repeat are stored each; an
empty table gives a store with one empty shelf; columns beside the value table's are not stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.schema import VALUE_COLUMNS, VALUE_SCHEMA
from tallywell.sources.sinks import SORT_COLUMNS

#: Rows of a shelf; a node with more is sliced.
ROWS = 4_000_000
#: Bytes of a row group, so that a node of ordinary size needs one or two.
ROW_GROUP = 16 << 20
#: The columns that a series is told apart by.
SERIES = ["place", "node", "measure", "period_type", "dim", "dim_value"]
#: What parts a name and a slice number; no node has it in its code.
_MARK = "\u0001"


def _place(slices: Column) -> Column:
    """The node's name, with a slice number where the node has several; a null node is the mark alone."""
    slice_of = F.pmod(F.xxhash64("measure", "dim", "dim_value"), slices).cast("string")
    name = F.coalesce("node", F.lit(_MARK))
    return F.when(slices > 1, F.concat(name, F.lit(_MARK), slice_of)).otherwise(name)


def _table(path: str) -> str:
    return "shelves_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def store(values: DataFrame, path: str, rows: int = ROWS) -> DataFrame:
    """Write all rows to `path`, which must be new, and return them as stored."""
    spark = values.sparkSession
    values.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).select(
        "node", "rows", F.ceil(F.col("rows") / rows).cast("int").alias("slices"),
    ).write.mode("errorifexists").parquet(path.rstrip("/") + "-directory")
    nodes = directory(spark, path)
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    shelves = max(1, -(-total // rows))
    # Only sliced nodes are looked up: no more of them than shelves. All other rows have their node for a place.
    sliced = nodes.filter("slices > 1").select(F.col("node").alias("_node"), "slices")
    kept = values.select(*VALUE_COLUMNS)
    if not sliced.isEmpty():
        kept = kept.join(sliced, F.col("node").eqNullSafe(F.col("_node")), "left").drop("_node")
    else:
        kept = kept.withColumn("slices", F.lit(None).cast("int"))
    placed = kept.withColumn("place", _place(F.coalesce("slices", F.lit(1)))).drop("slices")
    writer = placed.repartition(shelves, "place").write.mode("errorifexists").format("parquet").option("compression", "zstd")
    for column in ("node", "measure"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    (writer.option("parquet.block.size", ROW_GROUP).option("path", path)
     .bucketBy(shelves, "place").sortBy("place", *SORT_COLUMNS).saveAsTable(_table(path)))
    spark.createDataFrame([(shelves,)], "shelves int").coalesce(1).write.mode("errorifexists").parquet(path.rstrip("/") + "-size")
    return stored(spark, path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table of `path` with its `place`; a session that has not seen it is told where and how it lies."""
    name = _table(path)
    if not spark.catalog.tableExists(name):
        shelves = spark.read.parquet(path.rstrip("/") + "-size").first()["shelves"]
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VALUE_SCHEMA)
        order = ", ".join(["place", *SORT_COLUMNS])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, place string) USING parquet "
                  f"CLUSTERED BY (place) SORTED BY ({order}) INTO {shelves} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(node, rows, slices) of everything stored."""
    return spark.read.parquet(path.rstrip("/") + "-directory")


def node_rows(spark: SparkSession, path: str, node: str | None, measures: Sequence[str] | None = None) -> DataFrame:
    """The value rows of one node, read from its own shelves; none for a node that is not stored.

    The directory is asked for one row. A node has as many places as slices, so the list in the filter grows with the node's
    share of the table, a place for every full shelf that it takes up.
    """
    found = directory(spark, path).filter(F.col("node").eqNullSafe(F.lit(node).cast("string"))).first()
    name = _MARK if node is None else node
    slices = found["slices"] if found else 1
    places = [name] if slices == 1 else [f"{name}{_MARK}{i}" for i in range(slices)]
    rows = stored(spark, path).filter(F.col("place").isin(*places))
    rows = rows.filter(F.col("node").isNull() if node is None else F.col("node") == node)
    if measures is not None:
        rows = rows.filter(F.col("measure").isin(*measures))
    return rows.select(*VALUE_COLUMNS)


def series_summary(shelved: DataFrame) -> DataFrame:
    """Per series: periods with a value, first and last of them, the last value and the sum. Shelves are read as they lie."""
    return shelved.filter(F.col("value").isNotNull()).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("periods"), F.min("period_start").alias("since"), F.max("period_start").alias("until"),
        F.max_by("value", "period_start").alias("newest"), F.sum("value").alias("total"),
    ).drop("place")
