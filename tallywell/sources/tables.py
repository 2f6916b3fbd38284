"""Small and slow sources as value rows: surveys, injury tables, year blocks, HTML tables, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, entities, names, periods
from tallywell.schema import as_values


def wide_survey(table: DataFrame, columns: Mapping[str, str] = fixed.SURVEY_COLUMNS, source: str = "prdf") -> DataFrame:
    """One row per agency and year, one column per measure, to value rows; the pooled unit is left out."""
    picked = table.filter(F.col("agency") != fixed.POOLED_UNIT).select(
        F.when(F.col("agency") == fixed.WHOLE_UNIT, "gov").otherwise(F.col("agency")).alias("node"),
        F.col("year").cast("int").alias("year"),
        F.col("n_resp").cast("string").try_cast("double").cast("long").alias("n"),
        *[F.col(c).cast("string").try_cast("double").alias(m) for m, c in columns.items() if c in table.columns],
    )
    measures = [m for m, c in columns.items() if c in table.columns]
    long = picked.unpivot(["node", "year", "n"], measures, "measure", "value").filter(F.col("value").isNotNull())
    return as_values(
        long, period_type="survey_year", period_start=periods.survey_year_start("year"),
        source_ref=F.concat(F.lit("fevs:"), F.col("year").cast("string"), F.lit(f"-{source}")),
    )


def long_table(table: DataFrame, period_type: str, notation: str | None = None) -> DataFrame:
    """Committed long rows (measure, node, period_start, value[, n], source_ref) to value rows.

    Values must be numbers, so the cast is strict; a blank count is no count.
    """
    n = F.col("n").cast("string").try_cast("double").cast("long") if "n" in table.columns else F.lit(None)
    return as_values(
        table, period_type=period_type, period_start=F.col("period_start").cast("date"),
        value=F.col("value").cast("double"), n=n, notation=notation, dim=None, dim_value=None,
    )


def html_rows(
    pages: DataFrame, html: str = "html", row: str = "tr", cells: Sequence[str] = ("td", "th"), least: int = 6
) -> DataFrame:
    """Table rows of HTML pages as arrays of clean cell texts; rows with few cells or an empty first one are left out.

    Extraction runs inside the scan's stage: rows are found by pattern and exploded, cells stay arrays.
    """
    kept = [c for c in pages.columns if c != html]
    cell_tags = "|".join(cells)
    found = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<{row}(?:\\s[^>]*)?>(.*?)</{row}>"), F.lit(1))
    each = F.regexp_extract_all(F.col("_row"), F.lit(f"(?s)<(?:{cell_tags})(?:\\s[^>]*)?>(.*?)</(?:{cell_tags})>"), F.lit(1))
    return (
        pages.select(*kept, F.posexplode(found).alias("row", "_row"))
        .select(*kept, "row", F.transform(each, cell_text).alias("cells"))
        .filter((F.size("cells") >= least) & (F.element_at("cells", 1) != ""))
    )


def cell_text(cell: Column) -> Column:
    """Tags removed, entities decoded, blanks squeezed."""
    text = entities.decode(F.regexp_replace(cell, "<[^>]+>", ""))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def injury_rows(rows: DataFrame) -> DataFrame:
    """Cells to (agency, employees, cases, rate, lt_cases, lt_rate); rows that are no figures are left out."""
    number = [clean.plain_number(F.try_element_at("cells", F.lit(i))) for i in range(2, 7)]
    kept = [c for c in rows.columns if c not in ("cells", "row")]
    out = rows.select(
        *kept, F.element_at("cells", 1).alias("agency"),
        *[n.alias(name) for n, name in zip(number, ("employees", "cases", "rate", "lt_cases", "lt_rate"))],
    )
    return out.filter((F.col("agency") != "") & (F.col("employees") != 0) & F.col("rate").isNotNull())


def injury_values(rows: DataFrame, aliases: DataFrame, year: str = "fy") -> DataFrame:
    """Injury rates as value rows; agencies are placed by name. `aliases` is (key, node)."""
    placed = rows.withColumn("key", names.footnoted_key("agency")).join(aliases, "key")
    pairs = F.array(
        F.struct(F.lit("osha_total_case_rate").alias("measure"), F.col("rate").alias("value")),
        F.struct(F.lit("osha_lost_time_case_rate").alias("measure"), F.col("lt_rate").alias("value")),
    )
    long = placed.select("node", year, F.col("employees").cast("long").alias("n"), F.explode(pairs).alias("p")).select(
        "node", "n", F.col(year).alias("fy"), "p.measure", "p.value"
    ).filter(F.col("value").isNotNull())
    return as_values(
        long, period_type="fiscal_year", period_start=periods.fiscal_year_start("fy"),
        source_ref=F.concat(F.lit("osha:fy"), F.col("fy").cast("string")),
    )


def group_members(groups: DataFrame) -> DataFrame:
    """Signed member edges from group definitions with arrays of agencies, units and excluded units."""
    def edges(column: str, kind: str, sign: int) -> Column:
        items = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(items, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code"), F.lit(sign).alias("sign")))

    every = F.concat(edges("agency_codes", "agency", 1), edges("org_codes", "org", 1), edges("exclude_org_codes", "org", -1))
    return groups.select("gid", F.explode(every).alias("e")).select("gid", "e.kind", "e.code", "e.sign")


def agency_departments(agencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(agency, dept) for agencies whose department is a node."""
    edges = agencies.select(F.col("code").alias("agency"), F.concat(F.lit("D:"), "department_code").alias("dept"))
    return edges.join(nodes.select(F.col("code").alias("dept")), "dept", "left_semi").select("agency", "dept")


def read_node(spark, path: str, node: str, measure: str | None = None) -> DataFrame:
    """The block of one node from the sorted value table; row groups of other nodes are skipped by statistics."""
    rows = spark.read.parquet(path).filter(F.col("node") == node)
    return rows if measure is None else rows.filter(F.col("measure") == measure)
