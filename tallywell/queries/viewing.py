"""Questions over the value table and the monthly facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import classify, periods
from tallywell.operators import facts, views
from tallywell.plans import registry
from tallywell.queries import gathering, standin
from tallywell.queries.registry import query, rounded, table
from tallywell.session import literal_table, materialise, scratch_path
from tallywell.sources import sinks, tables

_VALS = f"WITH {standin.NODE_VALUES_SQL}"
_LATEST = "(SELECT max(period_start) FROM vals WHERE measure = 'headcount')"


@query("W1 P31", f"""{_VALS}, r AS (SELECT *, row_number() OVER (PARTITION BY node, measure ORDER BY period_start DESC) AS rn FROM vals)
SELECT node, measure, period_type, period_start, round(value, 2) AS value FROM r WHERE rn = 1""")
def current_values(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(views.current(standin.node_values(spark, folder)).drop("n", "notation"), value=2)


# The orders end on the first of a month. With months that begin on the second, the newest month is a whole one.
_LATE = 1
_WHOLE = f"WITH {standin.node_values_sql(_LATE)}"


def _whole_months(spark: SparkSession, folder: str) -> DataFrame:
    return materialise(standin.node_values(spark, folder, _LATE), "values")


def _movers_sql(order: str) -> str:
    windows = " UNION ALL ".join(
        f"SELECT '{label}' AS label, (SELECT min(period_start) FROM vals WHERE period_start >= {_LATEST} - INTERVAL {months or 1200} MONTH) AS start"
        for label, months in fixed.MOVER_WINDOWS.items())
    return f"""{_WHOLE}, windows AS (SELECT * FROM ({windows}) WHERE start < {_LATEST}),
ch AS (SELECT w.label, a.measure, a.node, a.value AS v0, b.value AS v1, b.value - a.value AS delta,
    CASE WHEN a.value = 0 THEN NULL ELSE 100.0 * (b.value - a.value) / abs(a.value) END AS pct
  FROM windows w JOIN vals a ON a.period_start = w.start JOIN vals b ON b.period_start = {_LATEST} AND b.measure = a.measure AND b.node = a.node
  JOIN nodes g ON g.code = a.node AND g.kind = 'agency'
  JOIN vals s ON s.measure = 'headcount' AND s.node = a.node AND s.period_start = w.start AND s.value >= 5
  WHERE a.measure IN ('placed', 'revenue')),
enough AS (SELECT label, measure FROM ch GROUP BY 1, 2 HAVING count(*) >= 4),
r AS (SELECT c.*, row_number() OVER (PARTITION BY label, measure ORDER BY {order}, node) AS lo,
  row_number() OVER (PARTITION BY label, measure ORDER BY {order} DESC, node DESC) AS hi FROM ch c JOIN enough USING (label, measure) WHERE {order} IS NOT NULL),
both_ways AS (SELECT *, 'down' AS direction, lo AS place FROM r WHERE lo <= 12 UNION ALL SELECT *, 'up', hi FROM r WHERE hi <= 12)
SELECT label, measure, direction, cast(place AS INTEGER) AS place, node, round(v0, 2) AS v0, round(v1, 2) AS v1, round(delta, 2) AS delta, round_even(pct, 1) AS pct FROM both_ways"""


def _movers(spark: SparkSession, folder: str, by: str) -> DataFrame:
    # The stand-in's agencies are small, so its floor is 5 people instead of 250.
    values = _whole_months(spark, folder)
    rows = views.movers(values, standin.nodes(spark, folder), ["placed", "revenue"], floor=5, by=by)
    return rounded(rows, v0=2, v1=2, delta=2)


@query("W9 J8 J4 M5", _movers_sql("delta"))
def movers(spark: SparkSession, folder: str) -> DataFrame:
    return _movers(spark, folder, "delta")


@query("W10 W9", _movers_sql("pct"))
def movers_by_percent(spark: SparkSession, folder: str) -> DataFrame:
    return _movers(spark, folder, "pct")


@query("W8 K4", f"""{_WHOLE}, s AS (SELECT (SELECT min(period_start) FROM vals WHERE period_start >= {_LATEST} - INTERVAL 12 MONTH) AS s12,
  (SELECT min(period_start) FROM vals WHERE period_start >= {_LATEST} - INTERVAL 60 MONTH) AS s60),
shown AS (SELECT * FROM vals WHERE node IN (SELECT code FROM nodes WHERE kind IN ('gov', 'agency', 'group'))),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, measure ORDER BY period_start DESC) AS rn FROM shown) WHERE rn = 1)
SELECT n.node, n.measure, n.period_start, round(n.value, 2) AS value, round(n.value - a.value, 2) AS d12, round(n.value - b.value, 2) AS d60,
  round_even(100.0 * (n.value - a.value) / nullif(abs(a.value), 0), 2) AS p12, round_even(100.0 * (n.value - b.value) / nullif(abs(b.value), 0), 2) AS p60
FROM now n LEFT JOIN shown a ON a.node = n.node AND a.measure = n.measure AND a.period_start = (SELECT s12 FROM s)
LEFT JOIN shown b ON b.node = n.node AND b.measure = n.measure AND b.period_start = (SELECT s60 FROM s)""")
def change_table(spark: SparkSession, folder: str) -> DataFrame:
    values = _whole_months(spark, folder)
    rows = views.change_table(values, standin.nodes(spark, folder))
    return rounded(rows.select("node", "measure", "period_start", "value", "d12", "d60", "p12", "p60"), value=2, d12=2, d60=2)


_SEGMENTS = """seg AS (SELECT cast(c_nationkey AS VARCHAR) AS node, p_brand AS item, cast(date_trunc('month', o_orderdate) AS DATE) AS period_start, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return (
        line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("c_nationkey").cast("string").alias("node"), F.col("p_brand").alias("item"), F.trunc("o_orderdate", "month").alias("period_start"))
        .agg(F.sum("l_quantity").alias("value"))
    )


@query("A23 A31", f"""WITH {_SEGMENTS}, newest AS (SELECT node, max(period_start) AS d FROM seg GROUP BY 1),
last AS (SELECT s.node, s.item, coalesce(sum(CASE WHEN s.period_start = n.d THEN s.value END), 0) AS v FROM seg s JOIN newest n ON n.node = s.node GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY v DESC, item) AS rn FROM last)
SELECT s.node, s.period_start, CASE WHEN r.rn <= 8 THEN s.item ELSE '_other' END AS item, sum(s.value) AS value
FROM seg s JOIN r ON r.node = s.node AND r.item = s.item GROUP BY 1, 2, 3""")
def top_values_and_other(spark: SparkSession, folder: str) -> DataFrame:
    """The eight largest values in the last month per node, over all months, the rest merged."""
    return views.top_and_other(_segments(spark, folder), ["node"], "item", "value", fixed.TREND_TOP, "period_start")


_NOW_DIMS = {"grade": "grade", "age_bracket": "age_bracket", "supervisory": "supervisory_code", "appointment_type": "appointment_type_code",
             "pay_band": "pay_band", "work_schedule": "work_schedule_code", "series": "series_code", "step": "step_code"}
_NOW_SQL = " UNION ALL ".join(
    f"SELECT org_code AS node, '{dim}' AS dim, CASE WHEN coalesce({c}, '') = '' THEN '_blank' ELSE {c} END AS dim_value, sum(n) AS value FROM facts, latest WHERE snapshot_yyyymm = m GROUP BY 1, 2, 3"
    for dim, c in _NOW_DIMS.items())


@query("A23 A41 A3", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}, latest AS (SELECT max(snapshot_yyyymm) AS m FROM facts), long AS ({_NOW_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY node, dim ORDER BY value DESC, dim_value) AS rn FROM long)
SELECT node, dim, CASE WHEN rn <= 14 THEN dim_value ELSE '_other' END AS dim_value, cast(sum(value) AS DOUBLE) AS value FROM r GROUP BY 1, 2, 3""")
def composition_now(spark: SparkSession, folder: str) -> DataFrame:
    monthly = materialise(gathering.employment_facts(spark, folder), "facts")
    latest = monthly.select(F.max(periods.month_start("snapshot_yyyymm"))).scalar()
    units = monthly.select(F.col("org_code").alias("code")).distinct().withColumn("kind", F.lit("subelement"))
    rows = registry.latest_composition(monthly, units, latest, "fact")
    return views.top_and_other(rows, ["node", "dim"], "dim_value", "value", fixed.NOW_TOP)


@query("A29 A10", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}
SELECT substr(org_code, 1, 2) AS node, cast(sum(n) AS BIGINT) AS n,
  round_even(sum(CASE WHEN duty_station_code <> 'NDS' THEN n ELSE 0 END) / sum(n), 4) AS disclosed_location_share, round_even(sum(pay_n) / sum(n), 4) AS pay_disclosed_share,
  round(sum(pay_sum) / nullif(sum(pay_n), 0), 0) AS avg_pay, round(sum(los_sum) / sum(n), 1) AS avg_los FROM facts GROUP BY 1""")
def mix_summary(spark: SparkSession, folder: str) -> DataFrame:
    return views.mix_summary(gathering.employment_facts(spark, folder), F.substring("org_code", 1, 2))


@query("A30 U1", f"""WITH {standin.SEPARATIONS_SQL}, sf AS ({gathering._fact_sql('separations', 'separations')}),
dept AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS a, 'D:' || cast(n_regionkey AS VARCHAR) AS d FROM nation),
spread AS (SELECT 'gov' AS node, * FROM sf UNION ALL SELECT substr(org_code, 1, 2), * FROM sf UNION ALL SELECT org_code, * FROM sf
  UNION ALL SELECT d.d, sf.* FROM sf JOIN dept d ON d.a = substr(org_code, 1, 2)),
cats AS (SELECT node, effective_yyyymm, separation_category_code AS category, n FROM spread UNION ALL SELECT node, effective_yyyymm, 'DRP', n FROM spread WHERE drp_indicator = 'Y')
SELECT node, effective_yyyymm, category, cast(sum(n) AS BIGINT) AS n FROM cats GROUP BY 1, 2, 3""")
def flow_series(spark: SparkSession, folder: str) -> DataFrame:
    """Separations per node, month and category, with the flagged programme counted again as its own category."""
    rows = facts.fact_rollup(standin.separations(spark, folder), "separations", "personnel_action_effective_date_yyyymm")
    dept = table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS agency", "concat('D:', n_regionkey) AS dept")
    placed = rows.withColumn("agency", F.substring("org_code", 1, 2)).join(dept, "agency", "left")
    targets = F.array(F.lit("gov"), F.col("agency"), F.col("org_code"), F.col("dept"))
    return views.flow_series(placed, "separation_category_code", targets, ("DRP", F.col("drp_indicator") == "Y"))


@query("A31 P7", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}, spread AS (SELECT 'gov' AS node, * FROM facts UNION ALL SELECT substr(org_code, 1, 2), * FROM facts
  UNION ALL SELECT org_code, * FROM facts WHERE org_code IN (SELECT org_code FROM facts GROUP BY 1 HAVING sum(n) >= 500))
SELECT node, snapshot_yyyymm, 'age_bracket' AS dim, CASE WHEN coalesce(age_bracket, '') = '' THEN '_blank' ELSE age_bracket END AS dim_value, cast(sum(n) AS BIGINT) AS n FROM spread GROUP BY 1, 2, 4
UNION ALL SELECT node, snapshot_yyyymm, 'work_schedule_code', CASE WHEN coalesce(work_schedule_code, '') = '' THEN '_blank' ELSE work_schedule_code END, cast(sum(n) AS BIGINT) FROM spread GROUP BY 1, 2, 4""")
def dimension_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly headcount by dimension for government, agencies and sub-elements with at least 500 people."""
    monthly = gathering.employment_facts(spark, folder)
    large = monthly.groupBy("org_code").agg(F.sum("n").alias("heads")).filter(F.col("heads") >= fixed.MIN_TREND_HEADCOUNT).select(
        "org_code", F.lit(True).alias("large"))
    placed = monthly.join(large, "org_code", "left")
    # The flag rides inside the unit code, so the totals it is grouped by still know it.
    flagged = placed.withColumn("org_code", F.struct("org_code", "large"))
    targets = F.array(F.lit("gov"), F.substring("org_code.org_code", 1, 2), F.when(F.col("org_code.large"), F.col("org_code.org_code")))
    return views.dimension_trend(flagged, ["age_bracket", "work_schedule_code"], targets)


@query("W5", f"""WITH {_SEGMENTS} SELECT node, item, period_start, value, round(value / sum(value) OVER (PARTITION BY node, period_start), 6) AS share FROM seg""")
def share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(views.share_of_total(_segments(spark, folder), ["node", "period_start"]), share=6)


@query("W6", f"""{_VALS}, b AS (SELECT node, measure, arg_min(value, period_start) AS base FROM vals GROUP BY 1, 2)
SELECT v.node, v.measure, v.period_start, round(100 * v.value / CASE WHEN coalesce(b.base, 0) = 0 THEN 1 ELSE b.base END, 5) AS "index"
FROM vals v JOIN b ON b.node = v.node AND b.measure = v.measure""")
def index_to_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = standin.node_values(spark, folder)
    return rounded(views.index_to_first(rows, ["node", "measure"]).select("node", "measure", "period_start", "index"), index=5)


@query("W7", f"""{_VALS} SELECT node, measure, min(period_start) AS since, max(period_start) AS until,
  round(arg_max(value, period_start) - arg_min(value, period_start), 2) AS change FROM vals GROUP BY 1, 2""")
def change_since_first(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(views.change_since_first(standin.node_values(spark, folder), ["node", "measure"]), change=2)


@query("W11 W7 M4", f"""WITH {gathering.EXTRACTS_SQL}
SELECT node, period_start, sum(CASE WHEN measure = 'new_hires' THEN value END) AS new_hires, sum(CASE WHEN measure = 'transfers_in' THEN value END) AS transfers_in,
  sum(CASE WHEN measure = 'quits' THEN value END) AS quits, sum(CASE WHEN measure = 'retirements' THEN value END) AS retirements,
  sum(CASE WHEN measure IN ('new_hires', 'transfers_in') THEN value ELSE -value END) AS net
FROM raw_facts WHERE dim IS NULL AND measure IN ('new_hires', 'transfers_in', 'quits', 'retirements') GROUP BY 1, 2""")
def flows_by_period(spark: SparkSession, folder: str) -> DataFrame:
    return views.flows_wide(gathering.stored_extracts(spark, folder), None, ["new_hires", "transfers_in"], ["quits", "retirements"])


@query("A44", f"""{_VALS} SELECT period_type, count(DISTINCT period_start) AS periods, min(period_start) AS first_period, max(period_start) AS last_period FROM vals GROUP BY 1""")
def period_axis(spark: SparkSession, folder: str) -> DataFrame:
    axis = periods.axis(standin.node_values(spark, folder))
    return axis.select("period_type", F.size("axis").cast("long").alias("periods"), F.element_at("axis", 1).alias("first_period"), F.element_at("axis", -1).alias("last_period"))


@query("M1 A44 K3", f"""{_VALS}, ax AS (SELECT period_start, row_number() OVER (ORDER BY period_start) - 1 AS pos FROM (SELECT DISTINCT period_start FROM vals)),
p AS (SELECT v.*, a.pos FROM vals v JOIN ax a USING (period_start))
SELECT node, measure, 'month' AS t, cast(min(pos) AS INTEGER) AS i, max(pos) - min(pos) + 1 AS span, count(*) AS points, round(sum(value), 2) AS total,
  round(sum(value * (pos + 1)), 2) AS weighted FROM p GROUP BY 1, 2""")
def packed_series(spark: SparkSession, folder: str) -> DataFrame:
    """Series against the shared axis; position-weighted totals show that every value sits at its place."""
    packed = views.pack(views.valued(standin.node_values(spark, folder)))

    def total(column: F.Column) -> F.Column:
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    weighted = F.transform("v", lambda x, k: x * (F.col("i") + k + 1))
    return rounded(packed.select(
        "node", "measure", "t", "i", F.size("v").cast("long").alias("span"),
        F.size(F.filter("v", lambda x: x.isNotNull())).cast("long").alias("points"),
        total(F.col("v")).alias("total"), total(weighted).alias("weighted")), total=2, weighted=2)


@query("M2 M1", f"""{_VALS} SELECT node, measure, period_type, period_start, value FROM vals""")
def unpacked_series(spark: SparkSession, folder: str) -> DataFrame:
    values = views.valued(standin.node_values(spark, folder))
    return views.unpack(views.pack(values), periods.axis(values)).drop("n", "notation")


@query("M7 K3 K4", f"""{_VALS} SELECT node, count(DISTINCT measure) AS measures FROM vals GROUP BY 1""")
def node_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per node, written and read back."""
    documents = views.node_documents(standin.node_values(spark, folder))
    path = scratch_path(spark, "documents")
    sinks.write_node_documents(documents, path)
    back = spark.read.schema(documents.schema).json(path)
    return back.select("node", F.size(F.map_keys("measures")).cast("long").alias("measures"))


@query("K2 S14 K1", f"""WITH {gathering.EXTRACTS_SQL} SELECT measure, period_start, dim, dim_value, round(value, 2) AS value FROM raw_facts WHERE node = '03'""")
def node_block(spark: SparkSession, folder: str) -> DataFrame:
    """One node's rows from the value table written in node order; other row groups are skipped by statistics."""
    path = scratch_path(spark, "sorted")
    sinks.write_values(gathering.extracts(spark, folder), path)
    return rounded(tables.read_node(spark, path, "03").select("measure", "period_start", "dim", "dim_value", "value"), value=2)


_EXPLORE = f"""{_VALS}, picked AS (SELECT * FROM vals WHERE node IN ('N03', 'R1') AND measure IN ('placed', 'headcount') AND period_start >= DATE '1997-01-01')"""


@query("P29 P15 S14", f"""{_EXPLORE} SELECT node, measure, period_start, strftime(period_start, '%b %Y') AS label, value FROM picked""")
def explored_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.explore(standin.node_values(spark, folder), ["N03", "R1"], ["placed", "headcount"], "1997-01-01")
    return rows.select("node", "measure", "period_start", "label", "value")


@query("W6 P29", f"""{_EXPLORE}, b AS (SELECT node, measure, arg_min(value, period_start) AS base FROM picked GROUP BY 1, 2)
SELECT p.node, p.measure, p.period_start, round(100 * p.value / CASE WHEN coalesce(b.base, 0) = 0 THEN 1 ELSE b.base END, 5) AS "index" FROM picked p JOIN b USING (node, measure)""")
def explored_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.explore(standin.node_values(spark, folder), ["N03", "R1"], ["placed", "headcount"], "1997-01-01", "index")
    return rounded(rows.select("node", "measure", "period_start", "index"), index=5)


@query("T2 P27 A10 W5", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}, picked AS (SELECT * FROM facts WHERE org_code LIKE '03%' AND pay_plan_code = 'GS')
SELECT series_code AS k, cast(sum(n) AS BIGINT) AS n, round(sum(pay_sum) / nullif(sum(pay_n), 0), 2) AS avg_pay, round(sum(n) / (SELECT sum(n) FROM picked), 6) AS share
FROM picked GROUP BY 1 ORDER BY n DESC, k LIMIT 40""")
def breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """A user's question: one unit, one dimension, one filter, the forty largest values."""
    rows = views.breakdown(gathering.employment_facts(spark, folder), "03", "series_code", ("pay_plan_code", "GS"))
    return rounded(rows, avg_pay=2, share=6)


@query("T3 T7", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance DESC NULLS LAST")
def sorted_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return views.sort_nulls_last(rows, "balance", descending=True)


@query("T5", """SELECT nation, c_custkey, total, place FROM (SELECT c_nationkey AS nation, c_custkey, round(sum(o_totalprice), 2) AS total,
  cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey) AS INTEGER) AS place
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) WHERE place <= 15""")
def largest_per_group(spark: SparkSession, folder: str) -> DataFrame:
    spent = table(spark, folder, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    rows = spent.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("nation", "c_custkey", "total")
    return views.largest(rows, ["nation"], [F.desc("total"), "c_custkey"], fixed.PLACES_TOP)


@query("P37 P38 J21", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}, long AS (
  SELECT 'pay_band' AS dim, pay_band AS v, cast(sum(n) AS BIGINT) AS n FROM facts WHERE pay_band IS NOT NULL GROUP BY 2 UNION ALL SELECT 'grade', grade, cast(sum(n) AS BIGINT) FROM facts GROUP BY 2
  UNION ALL SELECT 'work_schedule', CASE WHEN coalesce(work_schedule_code, '') = '' THEN '_blank' ELSE work_schedule_code END, cast(sum(n) AS BIGINT) FROM facts GROUP BY 2),
labels AS (SELECT 'work_schedule' AS dim, 'F' AS v, 'Full-time' AS label UNION ALL SELECT 'work_schedule', 'P', 'Part-time')
SELECT l.dim, l.v, l.n, CASE WHEN l.v = '_blank' THEN 'Not reported' WHEN l.dim = 'pay_band' AND l.v = 'R' THEN 'Redacted' WHEN l.dim = 'pay_band' THEN '$' || l.v || 'k' ELSE coalesce(b.label, l.v) END AS label,
  row_number() OVER (PARTITION BY l.dim ORDER BY CASE WHEN l.v = 'R' THEN 2 WHEN regexp_matches(l.v, '^\\d') THEN 0 ELSE 1 END, try_cast(regexp_extract(l.v, '^(\\d+)', 1) AS INTEGER), l.v) AS place
FROM long l LEFT JOIN labels b ON b.dim = l.dim AND b.v = l.v""")
def labelled_values(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension values with labels and their place in display order."""
    from pyspark.sql import Window

    monthly = gathering.employment_facts(spark, folder)
    totals = facts.by_dimensions(monthly, {}, {"pay_band": F.coalesce("pay_band", F.lit("drop")), "grade": F.col("grade"), "work_schedule": F.col("work_schedule_code")}, F.col("n")).filter("dim_value <> 'drop'")
    labels = literal_table(spark, "dim string, dim_value string, label string", [("work_schedule", "F", "Full-time"), ("work_schedule", "P", "Part-time")])
    # The window runs over the few values of a dimension.
    place = F.row_number().over(Window.partitionBy("dim").orderBy(classify.dim_order("dim_value")))
    return totals.join(labels, ["dim", "dim_value"], "left").select(
        "dim", F.col("dim_value").alias("v"), F.col("value").cast("long").alias("n"),
        classify.dim_label("dim", "dim_value", "label").alias("label"), place.cast("long").alias("place"))
