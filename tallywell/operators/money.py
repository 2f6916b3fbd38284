"""Obligations beside people: buckets, rolling four quarters, full-time equivalents, overview rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import classify, periods
from tallywell.schema import as_values
from tallywell.session import literal_table


def aggregate_obligations(lines: DataFrame) -> DataFrame:
    """Obligations per submission, agency, object class and funding; funding not stated counts as direct."""
    return lines.groupBy(
        "fy", "quarter", "submission_period",
        F.col("owning_agency_name").alias("agency_name"), "object_class_code", "object_class_name",
        F.coalesce("direct_or_reimbursable_funding_source", F.lit("D")).alias("funding_source"),
    ).agg(F.sum(F.col("obligations_incurred").cast("double")).alias("obligations"))


def classified(obligations: DataFrame, direct_only: bool = True) -> DataFrame:
    """Year-to-date obligations per agency, bucket and quarter.

    Reimbursable obligations are paid by other agencies' orders; leaving them out avoids counting them twice.
    """
    rows = obligations.filter(F.col("funding_source") == "D") if direct_only else obligations
    return rows.groupBy("agency_name", "fy", "quarter", classify.object_class("object_class_code").alias("bucket")).agg(
        F.coalesce(F.sum("obligations"), F.lit(0.0)).alias("ytd")
    )


def _uses(fy: Column, quarter: Column) -> Column:
    """Quarters a year-to-date figure serves, with its sign and role there."""
    def use(year: Column, q: Column, sign: int, role: int) -> Column:
        return F.struct(year.cast("int").alias("fy"), q.cast("int").alias("quarter"), F.lit(sign).alias("sign"), F.lit(role).alias("role"))

    own = F.array(use(fy, quarter, 1, 0), use(fy + 1, quarter, -1, 2))
    full_year = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: use(fy + 1, q, 1, 1))
    return F.concat(own, F.when(quarter == 4, full_year).otherwise(F.slice(full_year, 1, 0)))


def rolling_four_quarters(ytd: DataFrame, keys: Sequence[str] = ("agency_name", "bucket")) -> DataFrame:
    """YTD(Y,q) + YTD(Y-1,4) - YTD(Y-1,q), for quarters whose three submissions all exist.

    One explode and one sum replace two outer joins; an agency or bucket missing from a submission counts zero.
    """
    spread = ytd.select(*keys, "ytd", F.explode(_uses(F.col("fy"), F.col("quarter"))).alias("u"))
    submitted = ytd.select("fy", "quarter").distinct()
    complete = (
        submitted.select(F.explode(_uses(F.col("fy"), F.col("quarter"))).alias("u"))
        .groupBy("u.fy", "u.quarter")
        .agg(F.countDistinct("u.role").alias("roles"))
        .filter("roles = 3")
        .select("fy", "quarter")
    )
    return (
        spread.groupBy(*keys, "u.fy", "u.quarter")
        .agg(F.sum(F.col("ytd") * F.col("u.sign")).alias("obligations"))
        .join(complete, ["fy", "quarter"], "left_semi")
    )


def bucket_measures(
    rolling: DataFrame, group_names: DataFrame, parts: Mapping[str, Sequence[str]] = fixed.MONEY_MEASURES
) -> DataFrame:
    """Money measures per group. A bucket may feed several measures; a group may own several agency names."""
    spark = rolling.sparkSession
    feeds = literal_table(spark, "measure string, bucket string", [(m, b) for m, bs in parts.items() for b in bs])
    every = literal_table(spark, "measure string", [(m,) for m in parts])
    owned = (
        rolling.join(group_names.select("gid", "agency_name"), "agency_name")
        .groupBy("gid", "fy", "quarter", "bucket").agg(F.sum("obligations").alias("obligations"))
    )
    wide = owned.groupBy("gid", "fy", "quarter").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "obligations"))).alias("buckets")
    )
    specs = feeds.groupBy("measure").agg(F.collect_list("bucket").alias("parts")).join(every, "measure")
    listed = specs.agg(F.collect_list(F.struct("measure", "parts"))).scalar()
    rows = wide.withColumn("listed", listed).select("gid", "fy", "quarter", "buckets", F.explode("listed").alias("spec")).select(
        F.col("gid").alias("node"), F.col("spec.measure").alias("measure"),
        periods.fiscal_quarter_start("fy", "quarter").alias("period_start"),
        F.aggregate(
            F.transform("spec.parts", lambda b: F.coalesce(F.try_element_at("buckets", b), F.lit(0.0))),
            F.lit(0.0), lambda acc, x: acc + x,
        ).alias("value"),
        F.concat(F.lit("fileb:FY"), F.col("fy").cast("string"), F.lit("Q"), F.col("quarter").cast("string")).alias("source_ref"),
    )
    return as_values(rows, period_type="quarter")


def year_block(table: DataFrame, label: str, years: Mapping[str, tuple[int, str]]) -> DataFrame:
    """A table with one column per year, in thousands, as (label, fy, fte, kind) in persons."""
    spec = literal_table(table.sparkSession, "column string, fy int, kind string", [(c, y, k) for c, (y, k) in years.items()])
    numeric = table.select(
        F.trim(F.regexp_replace(label, r"\s+", " ")).alias("label"),
        *[F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double").alias(c) for c in years],
    ).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in years))
    return (
        numeric.unpivot(["label"], list(years), "column", "thousands")
        .join(F.broadcast(spec), "column")
        .select("label", "fy", F.bround(F.col("thousands") * 1000, 0).cast("int").alias("fte"), "kind")
    )


def fte_by_group(fte: DataFrame, group_labels: DataFrame, source: str = "omb") -> DataFrame:
    """Full-time equivalents per group and fiscal year; a group may own several labels."""
    summed = fte.join(group_labels.select("gid", "label"), "label").groupBy("gid", "fy").agg(
        F.sum("fte").cast("double").alias("value"), F.max("kind").alias("kind")
    )
    rows = summed.select(
        F.col("gid").alias("node"), periods.fiscal_year_start("fy").alias("period_start"), "value",
        F.when(F.col("kind") == fixed.ESTIMATE, fixed.ESTIMATE).alias("notation"),
    )
    return as_values(rows, measure="omb_fte", period_type="fiscal_year", source_ref=source)


def nearest_month(months: DataFrame, wanted: Column, month: str = "yyyymm") -> Column:
    """The last available month up to the wanted one, else the first there is."""
    picked = F.coalesce(F.max(F.when(F.col(month) <= wanted, F.col(month))), F.min(month))
    return months.select(picked).scalar()


def overview(
    groups: DataFrame,
    money: DataFrame,
    group_names: DataFrame,
    headcount: DataFrame,
    fte: DataFrame,
    fy: int,
    quarter: int,
) -> DataFrame:
    """One row per group: people beside money.

    `money` is rolling (agency_name, bucket, fy, quarter, obligations), `headcount` is (gid, yyyymm, headcount)
    and `fte` is (gid, fy, fte, kind).
    """
    period = money.filter((F.col("fy") == fy) & (F.col("quarter") == quarter))
    owned = group_names.groupBy("gid").agg(F.count(F.lit(1)).alias("names"))
    sums = period.join(group_names, "agency_name").groupBy("gid").agg(
        *[F.sum(F.when(F.col("bucket") == b, F.col("obligations")).otherwise(0.0)).alias(b)
          for b in ("personnel", "contracted", "federal_services", "administered", "operations_other", "other")],
        F.max(F.when(F.col("obligations") != 0, 1).otherwise(0)).alias("reported"),
    )
    months = headcount.select("yyyymm").distinct()
    end_code = F.date_format(F.add_months(periods.fiscal_quarter_start(F.lit(fy), F.lit(quarter)), 2), "yyyyMM")
    heads = (
        headcount.withColumn("qend", nearest_month(months, end_code))
        .withColumn("newest", months.select(F.max("yyyymm")).scalar())
        .withColumn("prior", periods.year_before("newest"))
        .groupBy("gid")
        .agg(
            F.max(F.when(F.col("yyyymm") == F.col("qend"), F.col("headcount"))).alias("headcount"),
            F.max(F.when(F.col("yyyymm") == F.col("newest"), F.col("headcount"))).alias("headcount_latest"),
            F.max(F.when(F.col("yyyymm") == F.col("prior"), F.col("headcount"))).alias("headcount_prior"),
        )
    )
    picked_fte = fte.filter(F.col("fy").isin(fy, fy - 1)).groupBy("gid").agg(
        F.max_by(F.struct("fy", "fte", "kind"), "fy").alias("fte")
    )
    row = (
        groups.join(owned, "gid", "left").join(sums, "gid", "left").join(heads, "gid", "left").join(picked_fte, "gid", "left")
        .withColumn("mapped", F.coalesce("names", F.lit(0)) > 0)
        .withColumn("has_money", F.col("mapped") & (F.coalesce("reported", F.lit(0)) == 1))
        .withColumn("operations", F.col("personnel") + F.col("contracted") + F.col("federal_services") + F.col("operations_other"))
    )

    def known(c: Column) -> Column:
        return F.when(F.col("has_money"), c)

    people = F.when(F.col("headcount") != 0, F.col("headcount"))
    return row.select(
        "gid", "name",
        F.lit(f"FY{fy}Q{quarter}").alias("period"),
        "headcount", "headcount_latest",
        (F.col("headcount_latest") - F.col("headcount_prior")).alias("headcount_change_12m"),
        F.col("fte.fte").alias("fte_omb"), F.col("fte.kind").alias("fte_omb_kind"), F.col("fte.fy").alias("fte_omb_fy"),
        known(F.col("personnel")).alias("personnel"),
        known(F.col("contracted")).alias("contracted_services"),
        known(F.col("federal_services")).alias("federal_services"),
        known(F.when(F.col("personnel") + F.col("contracted") > 0,
                     F.try_divide(F.col("personnel"), F.col("personnel") + F.col("contracted")))).alias("insourcing_ratio"),
        known(F.col("administered")).alias("administered"),
        known(F.col("operations")).alias("operations"),
        known(F.col("other")).alias("other"),
        known(F.col("administered") + F.col("operations") + F.col("other")).alias("total_obligations"),
        known(F.try_divide(F.col("personnel"), people)).alias("personnel_per_head"),
        classify.money_reason(F.col("mapped"), F.col("has_money")).alias("money_reason"),
    ).orderBy(F.coalesce("headcount_latest", F.lit(0)).desc(), "gid")
