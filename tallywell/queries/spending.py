"""Obligations beside people: line items as obligations of nations, part sizes as object classes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import classify, periods
from tallywell.operators import money
from tallywell.queries import standin
from tallywell.queries.registry import query, rounded, table

_CODES = ("11.1", "12.1", "11.7", "13.0", "25.1", "25.2", "25.3", "25.7", "41.0", "99.0", "21.0", "")
_CODE = "CASE l_partkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CODES)) + " END"
_FY = "year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END"
_FQ = "CASE WHEN month(l_shipdate) >= 10 THEN 1 WHEN month(l_shipdate) <= 3 THEN 2 WHEN month(l_shipdate) <= 6 THEN 3 ELSE 4 END"

_LINES = {
    "fy": f"cast({_FY} as int)", "quarter": f"cast({_FQ} as int)", "submission_period": "'P'",
    "owning_agency_name": "concat('AGENCY ', cast(l_suppkey % 25 as string))",
    "object_class_code": _CODE, "object_class_name": "concat('CLASS ', cast(l_partkey % 12 as string))",
    "direct_or_reimbursable_funding_source": "CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'D' END",
    "obligations_incurred": "cast(l_extendedprice as string)",
}
_LINES_SQL = standin.cte("lines", _LINES, "lineitem")
_BUCKET = """CASE WHEN trim(coalesce(object_class_code, '')) IN ('11.1','11.3','11.5','11.8','11.9','12.1') THEN 'personnel' WHEN object_class_code IN ('11.7','12.2') THEN 'military'
  WHEN object_class_code IN ('25.1','25.2') THEN 'contracted' WHEN object_class_code = '25.3' THEN 'federal_services'
  WHEN object_class_code IN ('41.0','42.0','43.0','44.0','33.0','94.0','13.0') THEN 'administered'
  WHEN substr(object_class_code, 1, 2) IN ('11','12','21','22','23','24','25','26','31','32') THEN 'operations_other' ELSE 'other' END"""
_AGG_SQL = f"""{_LINES_SQL}, agg AS (SELECT fy, quarter, submission_period, owning_agency_name AS agency_name, object_class_code, object_class_name,
  coalesce(direct_or_reimbursable_funding_source, 'D') AS funding_source, round(sum(cast(obligations_incurred AS DOUBLE)), 2) AS obligations FROM lines GROUP BY ALL)"""
# Submissions are cumulative within a fiscal year.
_YTD_SQL = f"""{_AGG_SQL}, q AS (SELECT agency_name, fy, quarter, {_BUCKET} AS bucket, round(sum(obligations), 2) AS v FROM agg WHERE funding_source = 'D' GROUP BY ALL),
ytd AS (SELECT a.agency_name, a.fy, a.bucket, p.quarter, round(sum(a.v), 2) AS ytd FROM q a JOIN (SELECT DISTINCT fy, quarter FROM q) p ON p.fy = a.fy AND a.quarter <= p.quarter GROUP BY 1, 2, 3, 4)"""


def _obligations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(money.aggregate_obligations(standin.select(table(spark, folder, "lineitem"), _LINES)), obligations=2)


def _year_to_date(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly amounts added up within each fiscal year, as the source submits them."""
    quarterly = money.classified(_obligations(spark, folder))
    submitted = quarterly.select("fy", "quarter").distinct().withColumnRenamed("quarter", "until")
    return rounded(
        quarterly.join(F.broadcast(submitted), "fy").filter("quarter <= until")
        .groupBy("agency_name", "fy", F.col("until").alias("quarter"), "bucket").agg(F.sum("ytd").alias("ytd")), ytd=2)


@query("A32", f"WITH {_AGG_SQL} SELECT * FROM agg")
def aggregated_obligations(spark: SparkSession, folder: str) -> DataFrame:
    return _obligations(spark, folder)


@query("A33 P10", f"WITH {_AGG_SQL} SELECT agency_name, fy, quarter, {_BUCKET} AS bucket, round(sum(obligations), 2) AS ytd FROM agg WHERE funding_source = 'D' GROUP BY ALL")
def classified_obligations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(money.classified(_obligations(spark, folder)), ytd=2)


_ROLLING_SQL = f"""{_YTD_SQL}, done AS (SELECT DISTINCT fy, quarter FROM ytd),
targets AS (SELECT d.fy, d.quarter FROM done d WHERE EXISTS (SELECT 1 FROM done p WHERE p.fy = d.fy - 1 AND p.quarter = 4) AND EXISTS (SELECT 1 FROM done p WHERE p.fy = d.fy - 1 AND p.quarter = d.quarter)),
names AS (SELECT DISTINCT t.fy, t.quarter, y.agency_name, y.bucket FROM targets t JOIN ytd y ON (y.fy = t.fy AND y.quarter = t.quarter) OR (y.fy = t.fy - 1 AND y.quarter IN (4, t.quarter))),
rolling AS (SELECT n.fy, n.quarter, n.agency_name, n.bucket, round(coalesce(c.ytd, 0) + coalesce(f.ytd, 0) - coalesce(s.ytd, 0), 2) AS obligations FROM names n
  LEFT JOIN ytd c ON c.agency_name = n.agency_name AND c.bucket = n.bucket AND c.fy = n.fy AND c.quarter = n.quarter
  LEFT JOIN ytd f ON f.agency_name = n.agency_name AND f.bucket = n.bucket AND f.fy = n.fy - 1 AND f.quarter = 4
  LEFT JOIN ytd s ON s.agency_name = n.agency_name AND s.bucket = n.bucket AND s.fy = n.fy - 1 AND s.quarter = n.quarter)"""


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(money.rolling_four_quarters(_year_to_date(spark, folder)), obligations=2)


@query("A17 J12 U4", f"WITH {_ROLLING_SQL} SELECT * FROM rolling")
def rolling_four_quarters(spark: SparkSession, folder: str) -> DataFrame:
    return _rolling(spark, folder)


_NAMES_SQL = "group_names AS (SELECT 'r' || cast(n_regionkey AS VARCHAR) AS gid, 'AGENCY ' || cast(n_nationkey AS VARCHAR) AS agency_name FROM nation)"


def _group_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr("concat('r', n_regionkey) AS gid", "concat('AGENCY ', n_nationkey) AS agency_name")


_PARTS = ", ".join(f"('{m}', '{b}')" for m, bs in fixed.MONEY_MEASURES.items() for b in bs)


@query("A18 J22 P18", f"""WITH {_ROLLING_SQL}, {_NAMES_SQL}, parts AS (SELECT * FROM (VALUES {_PARTS}) t(measure, bucket)),
g AS (SELECT gid, fy, quarter, bucket, round(sum(obligations), 2) AS v FROM rolling JOIN group_names USING (agency_name) GROUP BY 1, 2, 3, 4),
k AS (SELECT DISTINCT gid, fy, quarter FROM g), m AS (SELECT DISTINCT measure FROM parts)
SELECT m.measure, k.gid AS node, cast(make_date(k.fy - 1, 10, 1) + INTERVAL (3 * (k.quarter - 1)) MONTH AS DATE) AS period_start, round(coalesce(sum(g.v), 0), 2) AS value
FROM k CROSS JOIN m JOIN parts p ON p.measure = m.measure LEFT JOIN g ON g.gid = k.gid AND g.fy = k.fy AND g.quarter = k.quarter AND g.bucket = p.bucket GROUP BY 1, 2, 3""")
def money_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Six money measures per group; one bucket may feed several, one group owns several agency names."""
    rows = money.bucket_measures(_rolling(spark, folder), _group_names(spark, folder))
    return rounded(rows.select("measure", "node", "period_start", "value"), value=2)


# The block has a column for every year of the orders; the last two are estimates.
_FTE_SQL = """span AS (SELECT min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders),
counted AS (SELECT n_name, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
fte AS (SELECT b.n_name AS label, cast(a.y AS INTEGER) AS fy, cast(coalesce(c.n, 0) * 10 AS INTEGER) AS fte, CASE WHEN a.y > high - 2 THEN 'estimate' ELSE 'actual' END AS kind
  FROM (SELECT DISTINCT n_name FROM counted) b CROSS JOIN span CROSS JOIN LATERAL (SELECT unnest(range(low, high + 1)) AS y) a LEFT JOIN counted c ON c.n_name = b.n_name AND c.y = a.y)"""


def _orders_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """(n_name, n_regionkey, y, n): orders of each nation and calendar year."""
    joined = (
        table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
        .join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_nationkey", "y").agg(F.sum("n").alias("n"))
        .join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    return joined.select("n_name", "n_regionkey", "y", "n")


def _year_sum(y: int) -> F.Column:
    return F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).cast("double") / 100


def _fte(spark: SparkSession, folder: str) -> DataFrame:
    """A block with a column for every year of the orders and a row for every nation, so that every order counts."""
    span = table(spark, folder, "orders").agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high")).first()
    if span["low"] is None:
        return spark.sql("SELECT '' AS label, 0 AS fy, 0 AS fte, '' AS kind WHERE false")
    years = {f"y{y}": (y, "estimate" if y > span["high"] - 2 else "actual") for y in range(span["low"], span["high"] + 1)}
    block = _orders_by_year(spark, folder).groupBy(F.concat(F.lit("  "), "n_name", F.lit("  ")).alias("label")).agg(
        *[_year_sum(y).alias(c) for c, (y, _) in years.items()])
    return money.year_block(block, "label", years)


@query("S9 M3", f"WITH {_FTE_SQL} SELECT * FROM fte")
def year_block_table(spark: SparkSession, folder: str) -> DataFrame:
    """A label with a column in thousands for each year to one row per year, actual or estimate by position."""
    return _fte(spark, folder)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr("concat('r', n_regionkey) AS gid", "n_name AS label")


@query("J22 P42", f"""WITH {_FTE_SQL} SELECT 'r' || cast(n_regionkey AS VARCHAR) AS node, make_date(fy - 1, 10, 1) AS period_start, cast(sum(fte) AS DOUBLE) AS value,
  CASE WHEN max(kind) = 'estimate' THEN 'estimate' END AS notation FROM fte JOIN nation ON n_name = label GROUP BY n_regionkey, fy""")
def group_full_time_equivalents(spark: SparkSession, folder: str) -> DataFrame:
    return money.fte_by_group(_fte(spark, folder), _labels(spark, folder)).select("node", "period_start", "value", "notation")


# The overview's day is fixed, as a published table has one.
_TODAY = date(2001, 8, 10)
_OFY, _OQ = periods.latest_closed_quarter(_TODAY)
_OVERVIEW_SQL = f"""WITH {_ROLLING_SQL}, {_FTE_SQL}, {_NAMES_SQL},
heads AS (SELECT 'r' || cast(n_regionkey AS VARCHAR) AS gid, strftime(o_orderdate, '%Y%m') AS yyyymm, count(*) AS headcount FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
months AS (SELECT max(CASE WHEN yyyymm <= '200106' THEN yyyymm END) AS qend, max(yyyymm) AS newest FROM heads),
m AS (SELECT gid, {", ".join(f"round(sum(CASE WHEN bucket = '{b}' THEN obligations ELSE 0 END), 2) AS {b}" for b in ("personnel", "contracted", "federal_services", "administered", "operations_other", "other"))}
  FROM rolling JOIN group_names USING (agency_name) WHERE fy = {_OFY} AND quarter = {_OQ} GROUP BY 1),
f AS (SELECT 'r' || cast(n_regionkey AS VARCHAR) AS gid, fy, cast(sum(fte) AS BIGINT) AS fte, max(kind) AS kind FROM fte JOIN nation ON n_name = label WHERE fy IN ({_OFY}, {_OFY - 1}) GROUP BY 1, 2),
ff AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY fy DESC) AS rn FROM f) WHERE rn = 1),
groups AS (SELECT 'r' || cast(r_regionkey AS VARCHAR) AS gid, r_name AS name FROM region UNION ALL SELECT 'empty', 'No agency')
SELECT g.gid, g.name, 'FY{_OFY}Q{_OQ}' AS period, h.headcount, l.headcount AS headcount_latest, l.headcount - p.headcount AS headcount_change_12m,
  ff.fte AS fte_omb, ff.kind AS fte_omb_kind, ff.fy AS fte_omb_fy, personnel, contracted AS contracted_services,
  round(personnel / (personnel + contracted), 6) AS insourcing_ratio, administered, round(personnel + contracted + federal_services + operations_other, 2) AS operations,
  round(administered + personnel + contracted + federal_services + operations_other + other, 2) AS total_obligations, round(personnel / h.headcount, 4) AS personnel_per_head,
  CASE WHEN g.gid = 'empty' THEN 'no agency mapped' WHEN personnel IS NULL THEN 'no obligations reported' END AS money_reason
FROM groups g LEFT JOIN m ON m.gid = g.gid LEFT JOIN ff ON ff.gid = g.gid
LEFT JOIN heads h ON h.gid = g.gid AND h.yyyymm = (SELECT qend FROM months) LEFT JOIN heads l ON l.gid = g.gid AND l.yyyymm = (SELECT newest FROM months)
LEFT JOIN heads p ON p.gid = g.gid AND p.yyyymm = '200008'"""


@query("A34 P41 T7 J23 P17", _OVERVIEW_SQL)
def money_overview(spark: SparkSession, folder: str) -> DataFrame:
    """People beside money per group at the last closed quarter, with the reason where there is no money."""
    joined = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("yyyymm")).agg(F.count(F.lit(1)).alias("n"))
        .join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    heads = joined.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("gid"), "yyyymm").agg(F.sum("n").alias("headcount"))
    groups = table(spark, folder, "region").selectExpr("concat('r', r_regionkey) AS gid", "r_name AS name").unionByName(
        spark.sql("SELECT 'empty' AS gid, 'No agency' AS name"))
    fte = _fte(spark, folder).join(_labels(spark, folder), "label").groupBy("gid", "fy").agg(F.sum("fte").alias("fte"), F.max("kind").alias("kind"))
    rows = money.overview(groups, _rolling(spark, folder), _group_names(spark, folder), heads, fte, _OFY, _OQ)
    return rounded(rows.drop("federal_services", "other"), personnel=2, contracted_services=2, insourcing_ratio=6, administered=2, operations=2,
                   total_obligations=2, personnel_per_head=4)


@query("P10", """SELECT p_partkey, CASE WHEN code IN ('11.1','11.3','11.5','11.8','11.9','12.1') THEN 'personnel' WHEN code IN ('11.7','12.2') THEN 'military' WHEN code IN ('25.1','25.2') THEN 'contracted'
  WHEN code = '25.3' THEN 'federal_services' WHEN code IN ('41.0','42.0','43.0','44.0','33.0','94.0','13.0') THEN 'administered'
  WHEN left(code, 2) IN ('11','12','21','22','23','24','25','26','31','32') THEN 'operations_other' ELSE 'other' END AS bucket
FROM (SELECT p_partkey, cast(10 + p_size AS VARCHAR) || '.' || cast(p_partkey % 10 AS VARCHAR) AS code FROM part)""")
def object_classes(spark: SparkSession, folder: str) -> DataFrame:
    code = F.concat((F.col("p_size") + 10).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"))
    return table(spark, folder, "part").select("p_partkey", classify.object_class(code).alias("bucket"))
