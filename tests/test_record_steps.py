"""What is worked out once per file or record, and not once more for every row that comes of it."""

import pytest
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.operators import facts
from tallywell.queries import gathering, locating
from tallywell.sources import records


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_file_name_is_taken_apart_once_per_file(spark, tmp_path):
    for name in ("employment_202401_1", "employment_202402_12", "with space/file=accessions_202403_3"):
        spark.range(2).selectExpr("cast(id as string) AS a").write.csv(str(tmp_path / name))
    read = spark.read.schema("a string").option("recursiveFileLookup", True).csv(str(tmp_path))
    named = records.with_file(read)
    found = {(r["dataset"], r["file_yyyymm"], r["version"], r["source_ref"]) for r in named.collect()}
    assert found == {("employment", "202401", 1, "fwd:employment_202401_1"), ("employment", "202402", 12, "fwd:employment_202402_12"),
                     ("accessions", "202403", 3, "fwd:accessions_202403_3")}
    # Every listed path is one of a record, so the way by the record's own path is never gone.
    paths = {r["p"] for r in read.select(F.col("_metadata.file_path").alias("p")).distinct().collect()}
    assert len(paths) >= 3 and paths <= set(records.listed_paths(read))
    assert "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()


def test_keys_are_worked_out_below_the_explode(spark):
    rows = spark.createDataFrame([("202401", "A", "B"), ("202402", "A", "C")], "month string, x string, y string")
    out = facts.by_dimensions(rows, {"period_start": F.to_date(F.concat("month", F.lit("01")), "yyyyMMdd")}, {"x": F.col("x"), "y": F.col("y")}, F.lit(1))
    assert {(r["dim"], r["dim_value"], r["value"]) for r in out.collect()} == {("x", "A", 1.0), ("y", "B", 1.0), ("y", "C", 1.0)}
    above, below = plan(out).split("Generate", 1)
    assert "gettimestamp" not in above and "gettimestamp" in below


def test_dimensions_fan_out_without_arrays_of_structs(spark):
    rows = spark.createDataFrame([("N", "A", ""), ("N", None, "C")], "node string, x string, y string")
    out = facts.by_dimensions(rows, {"node": F.col("node")}, {"x": F.col("x"), "y": F.col("y")}, F.lit(2))
    assert sorted((r["dim"], r["dim_value"], r["value"]) for r in out.collect()) == [
        ("x", "A", 2.0), ("x", fixed.BLANK, 2.0), ("y", "C", 2.0), ("y", fixed.BLANK, 2.0)]
    assert "Generate stack(" in plan(out) and "explode" not in plan(out)


def test_facts_of_some_dimensions_have_the_sums_of_all(spark, folder):
    def sums(df):
        return df.groupBy("org_code", "duty_station_code").agg(
            F.sum("n").alias("n"), F.round(F.sum("pay_sum"), 2).alias("pay_sum"), F.sum("pay_n").alias("pay_n"), F.sum("los_sum").alias("los_sum"))

    some = gathering.employment_facts(spark, folder, ("org_code", "duty_station_code"))
    assert some.columns == ["org_code", "duty_station_code", "n", "pay_sum", "pay_n", "los_sum"]
    assert some.count() == some.select("org_code", "duty_station_code").distinct().count()
    assert sorted(map(str, sums(some).collect())) == sorted(map(str, sums(gathering.employment_facts(spark, folder)).collect()))
    with pytest.raises(KeyError):
        gathering.employment_facts(spark, folder, ("no_such_code",))


def test_locations_read_no_dimension_but_unit_and_station(spark, folder):
    found = plan(locating.distribution(spark, folder))
    assert "l_suppkey" in found and "AS grade" not in found and "AS work_schedule_code" not in found
