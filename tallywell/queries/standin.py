"""Inputs of the registered queries: the given tables in the shape of the sources the library reads.

Each stand-in is a list of expressions in the SQL both engines share, so the same text defines the input on both
sides and only the work on it differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywell.queries.registry import table

_AGENCY = "lpad(cast({key} % 25 as string), 2, '0')"
_UNIT = "CASE WHEN {key} % 8 = 7 THEN '' ELSE concat(lpad(cast({key} % 25 as string), 2, '0'), lpad(cast({key} % 8 as string), 2, '0')) END"
_MONTH = "cast(year({day}) * 100 + month({day}) as string)"
_AGE = (
    "CASE {key} % 12 WHEN 0 THEN 'LESS THAN 20' WHEN 1 THEN '20-24' WHEN 2 THEN '25-29' WHEN 3 THEN '30-34' "
    "WHEN 4 THEN '35-39' WHEN 5 THEN '40-44' WHEN 6 THEN '45-49' WHEN 7 THEN '50-54' WHEN 8 THEN '55-59' "
    "WHEN 9 THEN '60-64' WHEN 10 THEN '65 OR MORE' ELSE 'UNSPECIFIED' END"
)

# One record per line item: a person on the rolls in the month of shipping.
EMPLOYMENT = {
    "snapshot_yyyymm": _MONTH.format(day="l_shipdate"),
    "agency_code": _AGENCY.format(key="l_suppkey"),
    "agency_subelement_code": _UNIT.format(key="l_suppkey"),
    "agency_subelement": "concat('UNIT ', cast(l_suppkey % 8 as string), CASE WHEN l_returnflag = 'A' THEN ' OLD' ELSE '' END)",
    "department_code": "concat('R', cast(l_suppkey % 25 % 5 as string))",
    "count": "'1'",
    "age_bracket": _AGE.format(key="l_partkey"),
    "grade": "lpad(cast(8 + l_linenumber as string), 2, '0')",
    "step_or_rate_type_code": "cast(l_orderkey % 10 as string)",
    "pay_plan_code": "CASE WHEN l_linestatus = 'O' THEN 'GS' ELSE 'ES' END",
    "occupational_series_code": "lpad(cast(l_partkey % 300 as string), 4, '0')",
    "supervisory_status_code": "cast(1 + l_partkey % 8 as string)",
    "work_schedule_code": "CASE l_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'G' WHEN 2 THEN 'P' ELSE '' END",
    "appointment_type_code": "CASE l_linenumber WHEN 1 THEN '10' WHEN 2 THEN '15' WHEN 3 THEN '30' WHEN 4 THEN '20' WHEN 5 THEN '40' WHEN 6 THEN '38' ELSE '99' END",
    "position_occupied_code": "cast(1 + l_orderkey % 2 as string)",
    "tenure_code": "cast(l_orderkey % 4 as string)",
    "education_level_code": "lpad(cast(l_partkey % 23 as string), 2, '0')",
    "education_level_bracket": "CASE WHEN l_partkey % 23 >= 13 THEN 'DEGREE' ELSE 'NO DEGREE' END",
    "length_of_service_years": "CASE WHEN l_discount = 0.0 THEN '' ELSE cast(l_quantity as string) END",
    "annualized_adjusted_basic_pay": "CASE WHEN l_returnflag = 'R' THEN 'REDACTED' WHEN l_tax = 0.0 THEN '' ELSE cast(l_extendedprice as string) END",
    "duty_station_code": "CASE WHEN l_returnflag = 'R' THEN 'REDACTED' WHEN l_tax = 0.08 THEN '' ELSE lpad(cast(l_partkey % 1000 as string), 4, '0') END",
    "veteran_indicator": "CASE WHEN l_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END",
    "stem_occupation": "CASE WHEN l_partkey % 3 = 0 THEN 'STEM OCCUPATIONS' ELSE 'ALL OTHER OCCUPATIONS' END",
    "bargaining_unit_status": "CASE WHEN l_orderkey % 5 = 0 THEN 'REDACTED' WHEN l_orderkey % 5 = 1 THEN '' WHEN l_orderkey % 5 = 2 THEN 'NOT_IN_BU' ELSE 'ELIGIBLE_IN_BU' END",
    "flsa_category_code": "CASE WHEN l_linestatus = 'O' THEN 'E' ELSE 'N' END",
    "pay_basis_code": "CASE WHEN l_linestatus = 'O' THEN 'PA' ELSE 'PH' END",
}

# One record per order: open orders are accessions, the others separations, dated by the order.
_ACTION = {
    "personnel_action_effective_date_yyyymm": "CASE WHEN o_totalprice < 2000 THEN '' ELSE " + _MONTH.format(day="o_orderdate") + " END",
    "agency_code": _AGENCY.format(key="o_custkey"),
    "agency_subelement_code": _UNIT.format(key="o_custkey"),
    "department_code": "concat('R', cast(o_custkey % 25 % 5 as string))",
    "count": "'1'",
    "age_bracket": _AGE.format(key="o_custkey"),
    "grade": "lpad(cast(1 + o_orderkey % 15 as string), 2, '0')",
    "step_or_rate_type_code": "cast(o_orderkey % 10 as string)",
    "pay_plan_code": "CASE WHEN o_orderkey % 3 = 0 THEN 'ES' ELSE 'GS' END",
    "occupational_series_code": "lpad(cast(o_custkey % 300 as string), 4, '0')",
    "supervisory_status_code": "cast(1 + o_custkey % 8 as string)",
    "work_schedule_code": "CASE o_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'G' ELSE 'P' END",
    "appointment_type_code": "CASE o_orderkey % 3 WHEN 0 THEN '10' WHEN 1 THEN '20' ELSE '38' END",
    "position_occupied_code": "cast(1 + o_orderkey % 2 as string)",
    "tenure_code": "cast(o_orderkey % 4 as string)",
    "education_level_bracket": "CASE WHEN o_custkey % 23 >= 13 THEN 'DEGREE' ELSE 'NO DEGREE' END",
    "length_of_service_years": "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE cast(o_orderkey % 40 as string) END",
    "annualized_adjusted_basic_pay": "cast(o_totalprice as string)",
    "duty_station_code": "lpad(cast(o_custkey % 1000 as string), 4, '0')",
    "veteran_indicator": "CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END",
    "flsa_category_code": "'E'",
    "pay_basis_code": "'PA'",
    "pathways_group": "CASE WHEN o_orderkey % 11 = 0 THEN 'INTERN' ELSE '' END",
}
ACCESSIONS = {
    **_ACTION,
    "accession_category_code": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'AA' WHEN '2' THEN 'AB' WHEN '3' THEN 'AC' WHEN '4' THEN 'AD' ELSE '' END",
}
SEPARATIONS = {
    **_ACTION,
    "separation_category_code": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'SC' WHEN '2' THEN 'SD' WHEN '3' THEN 'SH' WHEN '4' THEN 'SA' ELSE 'SJ' END",
    "drp_indicator": "CASE WHEN o_orderkey % 7 = 0 THEN 'Y' ELSE 'N' END",
}
IS_ACCESSION, IS_SEPARATION = "o_orderstatus = 'O'", "o_orderstatus <> 'O'"


def select(df: DataFrame, columns: dict[str, str], where: str | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


def cte(name: str, columns: dict[str, str], source: str, where: str | None = None) -> str:
    body = ", ".join(f'{e} AS "{n}"' for n, e in columns.items())
    return f"{name} AS (SELECT {body} FROM {source}{' WHERE ' + where if where else ''})"


def employment(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "lineitem"), EMPLOYMENT)


def accessions(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "orders"), ACCESSIONS, IS_ACCESSION)


def separations(spark: SparkSession, folder: str) -> DataFrame:
    return select(table(spark, folder, "orders"), SEPARATIONS, IS_SEPARATION)


EMPLOYMENT_SQL = cte("employment", EMPLOYMENT, "lineitem")
ACCESSIONS_SQL = cte("accessions", ACCESSIONS, "orders", IS_ACCESSION)
SEPARATIONS_SQL = cte("separations", SEPARATIONS, "orders", IS_SEPARATION)

# Oracle expressions for the fields records are cleaned into.
UNIT_SQL = "CASE WHEN coalesce(agency_subelement_code, '') = '' THEN agency_code || '__' ELSE agency_subelement_code END"
AGE_SQL = "CASE age_bracket WHEN 'LESS THAN 20' THEN 15 WHEN '65 OR MORE' THEN 65 WHEN 'UNSPECIFIED' THEN NULL ELSE try_cast(substr(age_bracket, 1, 2) AS INTEGER) END"
SERVICE_SQL = "try_cast(length_of_service_years AS DOUBLE)"
PAY_SQL = "try_cast(annualized_adjusted_basic_pay AS DOUBLE)"
BAND_SQL = f"coalesce(cast(cast(floor({PAY_SQL} / 10000) * 10 AS INTEGER) AS VARCHAR), 'R')"


def month_sql(code: str) -> str:
    return f"cast(substr({code}, 1, 4) || '-' || substr({code}, 5, 2) || '-01' AS DATE)"



# Monthly measures per nation, region and the whole: orders placed (flow), customers active (stock), revenue.
def node_values_sql(late: int = 0) -> str:
    return f"""
placed_rows AS (
  SELECT 'N' || lpad(cast(c_nationkey AS VARCHAR), 2, '0') AS nation, 'R' || cast(n_regionkey AS VARCHAR) AS region,
         cast(date_trunc('month', o_orderdate - INTERVAL {late} DAY) AS DATE) AS period_start, o_custkey, o_totalprice
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
spread AS (
  SELECT nation AS node, period_start, o_custkey, o_totalprice FROM placed_rows
  UNION ALL SELECT region, period_start, o_custkey, o_totalprice FROM placed_rows
  UNION ALL SELECT 'gov', period_start, o_custkey, o_totalprice FROM placed_rows),
sums AS (
  SELECT node, period_start, cast(count(*) AS DOUBLE) AS placed, cast(count(DISTINCT o_custkey) AS DOUBLE) AS headcount,
         round(sum(o_totalprice), 2) AS revenue FROM spread GROUP BY ALL),
vals AS (
  SELECT 'placed' AS measure, node, 'month' AS period_type, period_start, placed AS value FROM sums
  UNION ALL SELECT 'headcount', node, 'month', period_start, headcount FROM sums
  UNION ALL SELECT 'revenue', node, 'month', period_start, revenue FROM sums),
nodes AS (
  SELECT 'gov' AS code, 'gov' AS kind, NULL AS parent
  UNION ALL SELECT 'R' || cast(r_regionkey AS VARCHAR), 'department', 'gov' FROM region
  UNION ALL SELECT 'N' || lpad(cast(n_nationkey AS VARCHAR), 2, '0'), 'agency', 'R' || cast(n_regionkey AS VARCHAR) FROM nation)
"""


NODE_VALUES_SQL = node_values_sql()


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "region").selectExpr(
        "concat('R', r_regionkey) AS code", "'department' AS kind", "r_name AS name", "'gov' AS parent")
    nations = table(spark, folder, "nation").selectExpr(
        "concat('N', lpad(n_nationkey, 2, '0')) AS code", "'agency' AS kind", "n_name AS name", "concat('R', n_regionkey) AS parent")
    root = spark.sql("SELECT 'gov' AS code, 'gov' AS kind, 'Whole' AS name, CAST(NULL AS string) AS parent")
    return root.unionByName(regions).unionByName(nations)


def node_values(spark: SparkSession, folder: str, late: int = 0) -> DataFrame:
    """Value rows of placed, headcount and revenue. Months begin `late` days after the calendar's.

    Orders are first reduced to one row per customer and month, so the fan-out to three nodes and the distinct
    count work on that, not on orders.
    """
    from pyspark.sql import functions as F

    from tallywell.operators.facts import wide_to_long
    from tallywell.schema import as_values

    orders = table(spark, folder, "orders").groupBy(
        "o_custkey", F.trunc(F.date_sub("o_orderdate", late), "month").alias("period_start")
    ).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    placed = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", "period_start").agg(
        F.sum("orders").cast("double").alias("placed"), F.count(F.lit(1)).cast("double").alias("headcount"),
        F.sum("spent").alias("revenue"),
    ).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    targets = F.array(
        F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit("gov"),
    )
    # A customer belongs to one nation, so distinct customers add up over nations.
    wide = placed.withColumn("node", F.explode(targets)).groupBy("node", "period_start").agg(
        F.sum("placed").alias("placed"), F.sum("headcount").alias("headcount"), F.round(F.sum("revenue"), 2).alias("revenue"))
    return as_values(wide_to_long(wide, ["node", "period_start"], ["placed", "headcount", "revenue"]), period_type="month", source_ref="orders")
