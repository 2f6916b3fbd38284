"""Storage by node: every row comes back, one node costs its own shelves, groupings need no exchange."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallywell.schema import VALUE_COLUMNS, VALUE_SCHEMA
from tallywell.sources import shelves


def rows(count=6000, seed=5):
    """A node with over a third of all rows, one whose rows are one dimension of one measure, small ones, none, and repeats."""
    r = random.Random(seed)
    out = []
    for i in range(count):
        node = "hot" if r.random() < 0.4 else "narrow" if r.random() < 0.2 else None if r.random() < 0.02 else f"n{r.randrange(60)}"
        narrow = node == "narrow"
        dim = "grade" if narrow or r.random() < 0.5 else None
        out.append(("headcount" if narrow else f"m{r.randrange(25)}", node, "month", datetime.date(2000 + r.randrange(9), 1 + r.randrange(12), 1),
                    dim, f"g{r.randrange(200)}" if dim else None, None if r.random() < 0.05 else float(r.randrange(99)), i, None, "s"))
    return out + out[:40]


@pytest.fixture(scope="module")
def shelved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shelves") / uuid.uuid4().hex)
    made = spark.createDataFrame(rows(), VALUE_SCHEMA)
    return made, path, shelves.store(made, path, rows=500)


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan(df):
    """Rows that the only scan of a frame hands on, and the tasks it takes."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    leaves = node.collectLeaves()
    assert leaves.size() == 1
    return leaves.apply(0).metrics().apply("numOutputRows").value(), df.rdd.getNumPartitions()


def test_every_row_is_stored_once(spark, shelved):
    made, path, stored = shelved
    assert same(stored.select(*VALUE_COLUMNS), made)
    crowded = stored.groupBy("place").count().agg(F.max("count")).first()[0]
    assert crowded < 1200 < made.filter("node = 'hot'").count()
    places = stored.filter("node = 'narrow'").select("place").distinct().count()
    assert places > 1, "one measure of one node is sliced by its dimension"


def test_series_stand_on_one_shelf(shelved):
    _, _, stored = shelved
    series = ["node", "measure", "dim", "dim_value"]
    assert stored.groupBy(*series).agg(F.countDistinct("place").alias("n")).filter("n > 1").isEmpty()


@pytest.mark.parametrize("node", ["hot", "narrow", "n7", None, "absent"])
def test_one_node(spark, shelved, node):
    made, path, _ = shelved
    wanted = made.filter(F.col("node").eqNullSafe(F.lit(node).cast("string")))
    assert same(shelves.node_rows(spark, path, node), wanted)
    some = shelves.node_rows(spark, path, node, ["m3", "m4"])
    assert same(some, wanted.filter("measure IN ('m3', 'm4')"))


def test_one_node_is_read_from_its_own_shelf(spark, shelved):
    made, path, _ = shelved
    read, tasks = scan(shelves.node_rows(spark, path, "n7"))
    assert tasks == 1 < shelves.stored(spark, path).filter("node = 'n7'").rdd.getNumPartitions() and read < 1200
    assert read < made.count() / 4


def test_grouping_needs_no_exchange(spark, shelved):
    made, _, stored = shelved
    summary = shelves.series_summary(stored)
    assert "Exchange" not in plan(summary)
    plain = made.withColumn("place", F.lit(""))
    assert "Exchange" in plan(shelves.series_summary(plain))
    assert same(summary.drop("newest"), shelves.series_summary(plain).drop("newest"))


def test_another_session_finds_the_shelves(spark, shelved):
    made, path, _ = shelved
    spark.sql(f"DROP TABLE {shelves._table(path)}")
    again = shelves.stored(spark, path)
    assert same(again.select(*VALUE_COLUMNS), made) and "Exchange" not in plan(shelves.series_summary(again))
    assert scan(shelves.node_rows(spark, path, "n7"))[0] < 1200


def test_bloom_filters_are_written(shelved):
    import glob

    import pyarrow.parquet as pq

    _, path, _ = shelved
    files = glob.glob(path + "/*.parquet")
    assert len(files) > 4
    with open(files[0], "rb") as f:
        f.seek(0, 2)
        size = f.tell()
    chunks = sum(pq.ParquetFile(files[0]).metadata.row_group(0).column(i).total_compressed_size for i in range(len(VALUE_COLUMNS) + 1))
    assert size - chunks > 1024, "the file holds more than its columns: filters and footer"


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    stored = shelves.store(spark.createDataFrame([], VALUE_SCHEMA), path)
    assert stored.count() == 0 and shelves.node_rows(spark, path, "x").count() == 0


def test_other_columns_are_not_stored(spark, tmp_path):
    made = spark.createDataFrame(rows(200), VALUE_SCHEMA).withColumn("place", F.lit("p")).withColumn("slices", F.lit(9)).withColumn("_node", F.lit("q"))
    stored = shelves.store(made, str(tmp_path / "more"), rows=50)
    assert same(stored.select(*VALUE_COLUMNS), made.select(*VALUE_COLUMNS))
