"""Weighted surveys on line items: the line number is the answer, the quantity the weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.operators import survey
from tallywell.queries.registry import query, rounded, table
from tallywell.session import literal_table

# Respondents: answers 1 to 5, 6 for "do not know", 7 for blank; further items from other columns.
_RESPONSES = {
    "unit": "CASE WHEN l_suppkey % 10 = 9 THEN NULL ELSE concat('S', cast(l_suppkey % 100 as string)) END",
    "year": "CASE WHEN year(l_shipdate) <= 1996 THEN 2019 WHEN year(l_shipdate) <= 1998 THEN 2021 ELSE 2023 END",
    "w": "l_quantity",
    "Q1": "CASE l_linenumber WHEN 6 THEN 'X' WHEN 7 THEN '' ELSE cast(l_linenumber as string) END",
    "Q2": "CASE WHEN l_partkey % 7 = 0 THEN 'X' ELSE cast(1 + l_partkey % 5 as string) END",
    "Q3": "cast(1 + l_orderkey % 6 as string)",
    "Q4": "CASE WHEN l_returnflag = 'N' THEN 'X' ELSE cast(1 + (l_orderkey + l_partkey) % 5 as string) END",
    "DLEAVING": "CASE l_orderkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'A' ELSE '' END",
}
_SQL = "resp AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _RESPONSES.items()) + " FROM lineitem)"
_ITEMS = ("Q1", "Q2", "Q3", "Q4")


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _RESPONSES.items()])


def _pp(item: str) -> str:
    return (f"100.0 * sum(CASE WHEN {item} IN ('4','5') THEN w ELSE 0 END) / "
            f"nullif(sum(CASE WHEN {item} IN ('1','2','3','4','5') THEN w ELSE 0 END), 0)")


_POSITIVE = ", ".join(f"round({_pp(i)}, 6) AS pp_{i.lower()}" for i in _ITEMS)
_DIGITS = {f"pp_{i.lower()}": 6 for i in _ITEMS}


def _aggregates() -> list:
    return [survey.percent_positive(i).alias(f"pp_{i.lower()}") for i in _ITEMS]


@query("A11 A13", f"WITH {_SQL} SELECT unit, count(*) AS n_resp, {_POSITIVE} FROM resp WHERE unit IS NOT NULL AND unit <> '' GROUP BY 1 HAVING count(*) >= 300")
def percent_positive(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted percent positive of every item in one pass, for units with at least 300 respondents."""
    return rounded(survey.by_unit(_responses(spark, folder), "unit", _aggregates()), **_DIGITS)


@query("A14 A11", f"""WITH {_SQL} SELECT CASE WHEN grouping(unit) = 1 THEN 'ALL' ELSE unit END AS unit, count(*) AS n_resp, {_POSITIVE}
FROM resp GROUP BY GROUPING SETS ((unit), ())""")
def units_and_total(spark: SparkSession, folder: str) -> DataFrame:
    """Units and the whole in one grouping; respondents without a unit stay apart from the whole."""
    return rounded(survey.with_total(_responses(spark, folder), "unit", _aggregates()), **_DIGITS)


@query("A12 A42", f"""WITH {_SQL}, codes AS (SELECT * FROM (VALUES {", ".join(f"({y}, '{c}', '{m}')" for y, cs in fixed.LEAVING_CODES.items() for m, c in cs.items())}) t(year, code, meaning)),
r AS (SELECT p.*, c.meaning FROM resp p LEFT JOIN codes c ON c.year = p.year AND c.code = p.DLEAVING)
SELECT year, {", ".join(f"round(100.0 * sum(CASE WHEN meaning = '{m}' THEN w ELSE 0 END) / nullif(sum(CASE WHEN meaning IN ('no','within','outside','other') THEN w ELSE 0 END), 0), 6) AS leave_{m}" for m in ('no', 'within', 'outside', 'other'))},
  cast(sum(CASE WHEN DLEAVING IN ('A','B','C','D') THEN 1 ELSE 0 END) AS BIGINT) AS n_valid,
  round(100.0 * sum(CASE WHEN DLEAVING IS NULL OR DLEAVING NOT IN ('A','B','C','D') THEN 1 ELSE 0 END) / count(*), 6) AS missing FROM r GROUP BY 1""")
def leaving_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of leaving reasons, whose codes mean different things in different years."""
    codes = literal_table(spark, "year int, code string, meaning string", [(y, c, m) for y, cs in fixed.LEAVING_CODES.items() for m, c in cs.items()])
    rows = survey.answer_meaning(_responses(spark, folder), "DLEAVING", "year", codes)
    kinds = ("no", "within", "outside", "other")
    valid, missing = survey.missing_share("DLEAVING")
    out = rows.groupBy("year").agg(
        *[survey.weighted_share("meaning", (k,), kinds).alias(f"leave_{k}") for k in kinds],
        valid.alias("n_valid"), missing.alias("missing"))
    return rounded(out, missing=6, **{f"leave_{k}": 6 for k in kinds})


@query("A15 A11", f"""WITH {_SQL}, u AS (SELECT unit, year, {", ".join(f"{_pp(i)} AS {i}" for i in _ITEMS)} FROM resp WHERE unit IS NOT NULL GROUP BY 1, 2),
s AS (SELECT unit, year, (Q1 + Q2) / 2 AS lead, (Q3 + Q4) / 2 AS intrinsic FROM u)
SELECT unit, year, round((lead + intrinsic) / 2, 6) AS "index" FROM s WHERE lead IS NOT NULL AND intrinsic IS NOT NULL""")
def index_of_indices(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of two sub-index means per unit and year; one missing item means no index."""
    units = _responses(spark, folder).filter("unit IS NOT NULL").groupBy("unit", "year").agg(*[survey.percent_positive(i).alias(i) for i in _ITEMS])
    items = units.unpivot(["unit", "year"], list(_ITEMS), "item", "value")
    members = literal_table(spark, "item string, subindex string", [("Q1", "lead"), ("Q2", "lead"), ("Q3", "intrinsic"), ("Q4", "intrinsic")])
    return rounded(survey.index_of_indices(items, ["unit", "year"], members, {"lead": 2, "intrinsic": 2}), index=6)


@query("A16", """WITH d AS (SELECT l_suppkey AS unit, [count(*) FILTER (l_linenumber = i) FOR i IN []] AS none,
  count(*) FILTER (l_linenumber = 1) AS a1, count(*) FILTER (l_linenumber = 2) AS a2, count(*) FILTER (l_linenumber = 3) AS a3,
  count(*) FILTER (l_linenumber = 4) AS a4, count(*) FILTER (l_linenumber = 5) AS a5 FROM lineitem GROUP BY 1)
SELECT unit, round(100.0 * (a4 + a5) / (a1 + a2 + a3 + a4 + a5), 6) AS positive FROM d WHERE a1 + a2 + a3 + a4 + a5 > 0""".replace("[count(*) FILTER (l_linenumber = i) FOR i IN []] AS none,\n  ", ""))
def top_two_box(spark: SparkSession, folder: str) -> DataFrame:
    """Percent positive from a distribution of answers, 'do not know' outside the base."""
    counts = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(
        F.array(*[F.sum(F.when(F.col("l_linenumber") == i, 1).otherwise(0)) for i in range(1, 7)]).alias("options"))
    out = counts.select("unit", survey.top_two_box("options").alias("positive")).filter(F.col("positive").isNotNull())
    return rounded(out, positive=6)


_UNITS_SQL = """u AS (SELECT l_suppkey, count(*) AS lines, round(sum(l_quantity), 0) AS quantity, cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY 1)"""


@query("A43", f"""WITH {_UNITS_SQL}, r AS (SELECT quantity, returned, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY returned) + (count(*) OVER (PARTITION BY returned) - 1) / 2.0 AS ry FROM u)
SELECT count(*) AS units, round(corr(quantity, returned), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def correlation_across_units(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum("l_quantity"), 0).alias("quantity"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("double").alias("returned"))
    return rounded(survey.correlations(units, "quantity", "returned"), pearson=6, spearman=6)


@query("A43", """WITH r AS (SELECT o_custkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rank FROM orders)
SELECT DISTINCT o_totalprice AS value, rank FROM r""")
def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Average ranks over a whole table without one global window."""
    return survey.average_rank(table(spark, folder, "orders"), "o_totalprice")
