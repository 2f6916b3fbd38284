"""Data-quality rules. Each returns the violating rows; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import periods
from tallywell.schema import flat

_VALUED = "dim IS NULL AND value IS NOT NULL"


class CheckFailed(RuntimeError):
    """A gate that must stop a build."""


# --- gates ------------------------------------------------------------------------------------------------------


def header_drift(found: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    """Missing, added and reordered columns; empty if the header is as committed."""
    if list(found) == list(expected):
        return {}
    missing = [c for c in expected if c not in found]
    added = [c for c in found if c not in expected]
    common = [c for c in found if c in expected]
    moved = common if common != [c for c in expected if c in found] else []
    return {k: v for k, v in (("missing", missing), ("added", added), ("reordered", moved)) if v}


def require_header(found: Sequence[str], expected: Sequence[str]) -> None:
    drift = header_drift(found, expected)
    if drift:
        raise CheckFailed(f"header changed: {drift}")


def unknown_measures(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Measures with rows but no catalog entry."""
    return values.select("measure").distinct().join(codes.select(F.col("code").alias("measure")), "measure", "left_anti")


def enough_inputs(found: Column, before: Column, share: float = fixed.INPUT_GUARD) -> Column:
    return F.coalesce(found >= before * share, F.lit(True))


def guard_inputs(found: int, before: int | None, share: float = fixed.INPUT_GUARD) -> None:
    """Refuse a build that sees far fewer inputs than the last one."""
    if before and found < before * share:
        raise CheckFailed(f"{found} inputs, the last build used {before}")


def require_empty(violations: DataFrame, rule: str) -> None:
    first = violations.take(5)
    if first:
        raise CheckFailed(f"{rule}: {[r.asDict() for r in first]}")


# --- generic rules ------------------------------------------------------------------------------------------------


def broken_dependency(df: DataFrame, key: Sequence[str], dependent: str) -> DataFrame:
    """Keys with more than one value of what should be a function of the key.

    Lowest and highest differ exactly when there are two values, so no set of values is built.
    """
    return (
        df.groupBy(*key).agg(F.min(dependent).alias("low"), F.max(dependent).alias("high"))
        .filter(F.col("low") != F.col("high"))
    )


def orphans(df: DataFrame, column: str, lookup: DataFrame, code: str = "code") -> DataFrame:
    """Codes used but not in the lookup, with their number of rows."""
    used = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("rows"))
    return used.join(lookup.select(F.col(code).alias("code")), "code", "left_anti")


def conservation(facts: DataFrame, records: DataFrame, people: Column) -> DataFrame:
    """People in the fact table and in the records, in one row, and whether they agree."""
    source = records.select(F.sum(people).alias("source")).scalar()
    return facts.agg(F.sum("n").alias("facts")).withColumn("source", source).withColumn(
        "equal", F.col("facts") == F.col("source")
    )


def more_than_one_group(members: DataFrame, member: str = "code", group: str = "gid") -> DataFrame:
    return members.groupBy(member).agg(F.countDistinct(group).alias("groups")).filter("groups > 1")


def entities_left(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that still hold an HTML entity."""
    dirty = None
    for c in columns:
        test = F.col(c).rlike(r"&(#\d+|[A-Za-z]+);")
        dirty = test if dirty is None else dirty | test
    return df.filter(dirty)


def unknown_weight(df: DataFrame, column: str, lookup: DataFrame, weight: str = "n", code: str = "code") -> DataFrame:
    """Share of the weight whose code the lookup does not know, in one row."""
    by_code = df.groupBy(F.col(column).alias("code")).agg(F.sum(weight).alias("n"))
    known = lookup.select(F.col(code).alias("code"), F.lit(True).alias("known"))
    return by_code.join(known, "code", "left").agg(
        F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("unknown"), F.sum("n").alias("total")
    ).withColumn("share", F.try_divide(F.col("unknown").cast("double"), F.col("total"))).withColumn(
        "ok", F.col("share") < fixed.UNKNOWN_CODE_SHARE
    )


def self_consistent(
    rows: DataFrame, source: str, cases: str, employees: str, rate: str,
    tolerance: float = fixed.RATE_TOLERANCE, agreement: float = fixed.RATE_AGREEMENT,
) -> DataFrame:
    """Rows of the sources whose published rates can be reproduced from their own parts.

    A row can be checked if it has all parts; a source passes if enough checked rows agree, otherwise all of its
    rows are rejected.
    """
    usable = rows.filter(F.col(employees).isNotNull() & (F.col(employees) != 0) & F.col(rate).isNotNull())
    passed = consistency(usable, source, cases, employees, rate, tolerance).filter(F.col("share") >= agreement)
    return usable.join(passed.select(source), source, "left_semi")


def consistency(rows: DataFrame, source: str, cases: str, employees: str, rate: str, tolerance: float = fixed.RATE_TOLERANCE) -> DataFrame:
    checked = F.col(cases).isNotNull()
    close = F.abs(F.try_divide(F.col(cases), F.col(employees)) * 100 - F.col(rate)) <= tolerance
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(checked, 1).otherwise(0)).alias("checked"),
        F.sum(F.when(checked & close, 1).otherwise(0)).alias("agreed"),
    ).withColumn("share", F.coalesce(F.try_divide(F.col("agreed").cast("double"), F.col("checked")), F.lit(0.0)))


# --- rules over the value table -------------------------------------------------------------------------------------


def children_sum(values: DataFrame, nodes: DataFrame, measure: str = "headcount", root: str = "gov") -> DataFrame:
    """Months in which agencies do not add up to the government."""
    rows = values.filter(_VALUED).filter(F.col("measure") == measure)
    kinds = nodes.select(F.col("code").alias("node"), "kind")
    sums = rows.join(kinds, "node").groupBy("period_start").agg(
        F.sum(F.when(F.col("node") == root, F.col("value"))).alias("whole"),
        F.sum(F.when(F.col("kind") == "agency", F.col("value"))).alias("parts"),
    )
    return sums.filter(F.abs(F.col("whole") - F.col("parts")) > fixed.SUM_TOLERANCE)


def flow_parts(values: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Node-months in which the parts of a flow differ from its total."""
    rows = values.filter(_VALUED).filter(F.col("measure").isin(total, *parts))
    wide = rows.groupBy("node", "period_start").agg(
        F.sum(F.when(F.col("measure") == total, F.col("value"))).alias("total"),
        F.sum(F.when(F.col("measure") != total, F.col("value")).otherwise(0.0)).alias("parts"),
    )
    return wide.filter(F.col("total").isNotNull() & (F.abs(F.col("total") - F.col("parts")) >= fixed.SUM_TOLERANCE))


def fte_against_headcount(values: DataFrame, band: tuple[float, float] = fixed.FTE_BAND) -> DataFrame:
    """Full-time equivalents against the September headcount of the same fiscal year."""
    rows = values.filter(_VALUED)
    fte = rows.filter(F.col("measure") == "omb_fte").select(
        "node", periods.fiscal_year("period_start").alias("fy"), F.col("value").alias("fte"))
    heads = rows.filter((F.col("measure") == "headcount") & (F.month("period_start") == 9)).groupBy(
        "node", F.year("period_start").alias("fy")).agg(F.max("value").alias("headcount"))
    ratio = F.try_divide("headcount", "fte")
    return fte.join(heads, ["node", "fy"]).withColumn("ratio", ratio).filter(~F.col("ratio").between(*band))


def positions_per_thousand(values: DataFrame, limit: float = fixed.POSITIONS_PER_1000) -> DataFrame:
    """Leadership positions per 1,000 people, each at the newest period of its measure."""
    rows = values.filter(_VALUED).filter(F.col("measure").isin("headcount", "plum_positions"))
    newest = rows.groupBy("measure").agg(F.max("period_start").alias("period_start"))
    wide = rows.join(newest, ["measure", "period_start"], "left_semi").groupBy("node").agg(
        F.max(F.when(F.col("measure") == "plum_positions", F.col("value"))).alias("positions"),
        F.max(F.when(F.col("measure") == "headcount", F.col("value"))).alias("headcount"),
    )
    return wide.withColumn("per_1000", F.try_divide(1000 * F.col("positions"), "headcount")).filter(F.col("per_1000") > limit)


def pay_per_head(values: DataFrame, band: tuple[float, float] = fixed.PAY_PER_HEAD_BAND) -> DataFrame:
    """Personnel obligations per head outside the plausible band, newest period."""
    rows = values.filter(_VALUED).filter(F.col("measure") == "personnel_per_head")
    newest = rows.select(F.max("period_start")).scalar()
    return rows.filter((F.col("period_start") == newest) & ~F.col("value").between(*band)).select("node", "period_start", "value")


def response_share(values: DataFrame, survey: str = "fevs_engagement", band: tuple[float, float] = fixed.RESPONSE_BAND) -> DataFrame:
    """Survey respondents against the last headcount of the survey year; more than all people is impossible."""
    surveys = flat(values).filter((F.col("measure") == survey) & (F.col("n") > 0)).select(
        "node", F.year("period_start").alias("year"), "n")
    heads = values.filter(_VALUED).filter(F.col("measure") == "headcount").groupBy(
        "node", F.year("period_start").alias("year")).agg(F.max_by("value", "period_start").alias("headcount"))
    share = F.try_divide(F.col("n").cast("double"), F.col("headcount"))
    return surveys.join(heads, ["node", "year"]).withColumn("share", share).filter(~F.col("share").between(*band))


def explain(flags: DataFrame, reasons: DataFrame, key: str = "node") -> DataFrame:
    """Flags with the known cause, if there is one. `reasons` is (node, reason)."""
    return flags.join(reasons, key, "left").withColumn("explained", F.col("reason").isNotNull())


def report(checks: dict[str, DataFrame], key: str = "node") -> DataFrame:
    """All violations in one table: rule, subject and the rest as a JSON text."""
    out = None
    for rule, rows in checks.items():
        subject = F.col(key).cast("string") if key in rows.columns else F.lit(None).cast("string")
        part = rows.select(F.lit(rule).alias("rule"), subject.alias("subject"), F.to_json(F.struct(*rows.columns)).alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


def report_counts(checks: dict[str, DataFrame]) -> DataFrame:
    """Number of violations per rule, zero included; one small aggregate per rule."""
    out = None
    for rule, rows in checks.items():
        part = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out
