"""What the operators share: small Arrow batches, tables between steps, connected classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.session import materialise

#: Rows of an Arrow batch. Texts may be long, so a batch holds few of them.
BATCH_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python BATCH_ROWS at a time at most."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_batch(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run `work` on every Arrow batch; batches are small, so a task holds few texts at a time."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return rows.mapInArrow(run, schema)


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: merged by sorting at every size, never broadcast through the driver.

    The optimiser goes by the size of files, and a list of ids takes several times that of the driver's memory.
    """
    return side.hint("merge")


def classes_of_links(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component_id): the smallest id reachable, for every id that has a link.

    A round gives every id the smallest among itself and its neighbours, follows that once more, and then contracts the
    graph: links are renamed to the labels of their ends, and links within a label vanish. What is left shrinks quickly
    and its longest path by half at least. Tables are written between rounds; only a count reaches the driver, and no list of ids.
    """
    rest = materialise(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while labels is None or not rest.isEmpty():
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("up")), "near")
        step = materialise(near.join(merged(near.select(F.col("id").alias("up"), F.col("up").alias("top"))), "up", "left")
                           .select("id", F.coalesce("top", "up").alias("label")), "step")
        if labels is None:
            labels = step.withColumnRenamed("label", "component_id")
        else:
            labels = labels.join(merged(step.withColumnRenamed("id", "component_id")), "component_id", "left").select(
                "id", F.coalesce("label", "component_id").alias("component_id"))
        labels = materialise(labels, "labels")
        rest = materialise(
            rest.join(merged(step.select(F.col("id").alias("a"), F.col("label").alias("x"))), "a")
            .join(merged(step.select(F.col("id").alias("b"), F.col("label").alias("y"))), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return labels
