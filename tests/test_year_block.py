"""Full-time equivalents over the whole table of orders."""

from pyspark.sql import functions as F

from tallywell.queries import REGISTRY


def test_every_order_counts(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    by_year = {r["fy"]: 10 * r["n"] for r in orders.groupBy(F.year("o_orderdate").alias("fy")).agg(F.count("*").alias("n")).collect()}
    rows = REGISTRY["year_block_table"].run(spark, folder)
    assert {r["fy"]: r["fte"] for r in rows.groupBy("fy").agg(F.sum("fte").alias("fte")).collect()} == by_year
    assert {r["fy"] for r in rows.where("kind = 'estimate'").collect()} == set(sorted(by_year)[-2:])
    groups = REGISTRY["group_full_time_equivalents"].run(spark, folder)
    assert groups.agg(F.sum("value")).first()[0] == sum(by_year.values())


def test_no_orders_give_no_rows(spark, folder, tmp_path):
    for name in ("customer", "nation", "orders"):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        (rows.where("false") if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert REGISTRY["year_block_table"].run(spark, str(tmp_path)).count() == 0
