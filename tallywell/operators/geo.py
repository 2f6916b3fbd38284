"""Where a unit's people are: per node by county, by state and in the remaining classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import classify


def station_counts(facts: DataFrame, unit: str = "org_code", code: str = "duty_station_code") -> DataFrame:
    """People per unit and station. Joining these instead of facts keeps the undisclosed station from being a hot key."""
    return facts.groupBy(unit, code).agg(F.sum("n").alias("n"))


def locate(facts: DataFrame, stations: DataFrame, code: str = "duty_station_code") -> DataFrame:
    """Counts with location class, county and state. `stations` is (code, name, cc, fips, st)."""
    lookup = stations.select(
        F.col("code").alias(code), F.col("name").alias("_name"), F.col("cc").alias("_cc"),
        F.col("fips").alias("_fips"), F.col("st").alias("_st"), F.lit(True).alias("_known"),
    )
    joined = facts.join(lookup, code, "left")
    kind = classify.location_class("_name", "_cc", "_fips", "_st", F.coalesce("_known", F.lit(False)))
    bucket = F.when(F.col(code) == fixed.NOT_DISCLOSED, "nds").otherwise(kind)
    return joined.withColumn("bucket", bucket).withColumn(
        "county", F.when(bucket == "county", F.col("_fips"))
    ).withColumn("state", F.when(bucket == "county", F.col("_st"))).drop("_name", "_cc", "_fips", "_st", "_known")


def node_targets(agency: Column, department: Column) -> Column:
    """Nodes a record counts in: the government, its agency, and its department if that is a different code."""
    distinct_department = F.when(department.isNotNull() & (department != agency), F.concat(F.lit("D:"), department))
    return F.filter(F.array(F.lit("gov"), agency, distinct_department), lambda t: t.isNotNull())


def distribution(located: DataFrame, targets: Column) -> DataFrame:
    """People per node, class, county and state, long.

    Records are summed before they fan out to their nodes, so the government row costs one partial sum per task.
    """
    small = located.withColumn("targets", targets).groupBy("targets", "bucket", "county", "state").agg(F.sum("n").alias("n"))
    return (
        small.select(F.explode("targets").alias("node"), "bucket", "county", "state", "n")
        .groupBy("node", "bucket", "county", "state")
        .agg(F.sum("n").alias("n"))
    )


def node_summary(dist: DataFrame) -> DataFrame:
    """Counters and disclosed share per node."""
    def total(*buckets: str) -> Column:
        return F.sum(F.when(F.col("bucket").isin(*buckets), F.col("n")).otherwise(0))

    disclosed = total("county", "abroad", "territory")
    return dist.groupBy("node").agg(
        F.sum("n").alias("n"), disclosed.alias("disclosed"),
        F.bround(F.try_divide(disclosed.cast("double"), F.sum("n")), 4).alias("disclosed_share"),
        total("abroad").alias("abroad"), total("territory").alias("territory"), total("invalid").alias("invalid"),
    )


def node_maps(dist: DataFrame) -> DataFrame:
    """County and state maps per node for output documents; their size is the number of counties."""
    located = dist.filter(F.col("bucket") == "county")
    counties = located.groupBy("node", "county").agg(F.sum("n").alias("n")).groupBy("node").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("county", "n")))).alias("counties"))
    states = located.groupBy("node", "state").agg(F.sum("n").alias("n")).groupBy("node").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("states"))
    return counties.join(states, "node")
