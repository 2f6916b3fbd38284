"""Data-quality rules on the tables; each query returns the violations or the figures a gate decides on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean
from tallywell.operators import checks
from tallywell.plans import catalog as full
from tallywell.queries import gathering, rostering, standin
from tallywell.queries.registry import query, rounded, table
from tallywell.schema import as_values
from tallywell.session import literal_table, scratch_path
from tallywell.sources import records, sinks, tables

_VALS = f"WITH {standin.NODE_VALUES_SQL}"


@query("Q5 J5", f"""WITH {gathering.EXTRACTS_SQL} SELECT DISTINCT measure FROM raw_facts WHERE measure IN ('quits', 'headcount')""")
def measures_not_in_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Two measures are taken out of the catalog; they must be reported."""
    known = full.as_table(spark).select("code").filter(~F.col("code").isin("quits", "headcount"))
    return checks.unknown_measures(gathering.stored_extracts(spark, folder), known)


@query("Q7", """SELECT l_suppkey, min(l_returnflag) AS low, max(l_returnflag) AS high FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def broken_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return checks.broken_dependency(table(spark, folder, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("Q8 J5", """SELECT l_orderkey % 17 AS code, count(*) AS rows FROM lineitem WHERE l_orderkey % 17 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 3) GROUP BY 1""")
def orphan_codes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 17).alias("nation"))
    return checks.orphans(rows, "nation", table(spark, folder, "nation").filter("n_regionkey <> 3"), "n_nationkey")


@query("Q9 J9", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL} SELECT cast(sum(n) AS BIGINT) AS facts, (SELECT count(*) FROM lineitem) AS source, sum(n) = (SELECT count(*) FROM lineitem) AS equal FROM facts""")
def people_conserved(spark: SparkSession, folder: str) -> DataFrame:
    return checks.conservation(gathering.employment_facts(spark, folder), standin.employment(spark, folder), clean.multiplicity())


_INJURIES = """inj AS (SELECT year(o_orderdate) AS fy, c_nationkey AS agency, count(DISTINCT o_custkey) AS employees, count(*) FILTER (o_orderpriority = '1-URGENT') AS cases FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
rated AS (SELECT *, CASE WHEN employees = 0 THEN NULL ELSE round(cases * 100.0 / employees, 2) + CASE WHEN fy IN (1996, 1999) AND agency < 3 THEN 1.0 ELSE 0.0 END END AS rate FROM inj)"""


def _injuries(spark: SparkSession, folder: str) -> DataFrame:
    per_customer = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("fy")).agg(
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"))
    rows = per_customer.join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("fy", F.col("c_nationkey").alias("agency")).agg(
        F.count(F.lit(1)).alias("employees"), F.sum("urgent").alias("cases"))
    wrong = F.col("fy").isin(1996, 1999) & (F.col("agency") < 3)
    return rows.withColumn("rate", F.round(F.col("cases") * 100.0 / F.col("employees"), 2) + F.when(wrong, 1.0).otherwise(0.0))


@query("Q10", f"""WITH {_INJURIES} SELECT fy, count(*) AS rows, count(*) AS checked, cast(sum(CASE WHEN abs(cases / employees * 100 - rate) <= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS agreed,
  round(sum(CASE WHEN abs(cases / employees * 100 - rate) <= 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS share FROM rated GROUP BY 1""")
def rate_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Share of published rates that follow from their own parts, per source year."""
    return rounded(checks.consistency(_injuries(spark, folder), "fy", "cases", "employees", "rate"), share=6)


@query("Q10 S10 P32", f"""WITH {_INJURIES}, good AS (SELECT fy FROM rated GROUP BY 1 HAVING sum(CASE WHEN abs(cases / employees * 100 - rate) <= 0.05 THEN 1 ELSE 0 END) / count(*) >= 0.95)
SELECT 'N' || cast(agency AS VARCHAR) AS node, make_date(fy - 1, 10, 1) AS period_start, rate AS value, cast(employees AS BIGINT) AS n FROM rated WHERE fy IN (SELECT fy FROM good)""")
def injury_rates(spark: SparkSession, folder: str) -> DataFrame:
    """HTML tables of rates, read back, gated by their own consistency and placed on nodes."""
    cell = [F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in (
        F.concat(F.lit("NATION "), F.col("agency").cast("string"), F.lit("X7")), F.format_number("employees", 0), F.format_number("cases", 0),
        F.format_string("%.2f", F.col("rate")), F.lit("n/a"), F.lit("&nbsp;"))]
    pages = _injuries(spark, folder).select("fy", F.concat(F.lit("<table><tr class='r'>"), *cell, F.lit("</tr></table>")).alias("html"))
    rows = tables.injury_rows(tables.html_rows(pages))
    aliases = table(spark, folder, "nation").selectExpr("concat('NATION ', n_nationkey, 'X') AS key", "concat('N', n_nationkey) AS node")
    passed = checks.self_consistent(rows, "fy", "cases", "employees", "rate")
    return tables.injury_values(passed, aliases).select("node", "period_start", "value", "n")


@query("Q12 J10", f"""{_VALS}, fte AS (SELECT node, year(period_start) AS fy, avg(value) * 1.2 AS fte FROM vals WHERE measure = 'headcount' GROUP BY 1, 2),
s AS (SELECT node, year(period_start) AS fy, value AS headcount FROM vals WHERE measure = 'headcount' AND month(period_start) = 9)
SELECT node, fy, round(fte, 4) AS fte, headcount, round(headcount / fte, 6) AS ratio FROM fte JOIN s USING (node, fy) WHERE headcount / fte < 0.75 OR headcount / fte > 1.35""")
def fte_against_headcount(spark: SparkSession, folder: str) -> DataFrame:
    values = standin.node_values(spark, folder)
    fte = values.filter("measure = 'headcount'").groupBy("node", F.year("period_start").alias("y")).agg((F.avg("value") * 1.2).alias("value"))
    rows = as_values(fte, measure="omb_fte", period_type="fiscal_year", period_start=F.make_date(F.col("y") - 1, F.lit(10), F.lit(1)), source_ref="omb")
    return rounded(checks.fte_against_headcount(values.unionByName(rows)), fte=4, ratio=6)


@query("Q13", f"""{_VALS}, p AS (SELECT node, max(CASE WHEN period_start = (SELECT max(period_start) FROM vals) THEN value END) AS headcount FROM vals WHERE measure = 'headcount' GROUP BY 1),
q AS (SELECT node, cast(length(node) AS DOUBLE) / 50 AS positions FROM (SELECT DISTINCT node FROM vals))
SELECT node, positions, headcount, round(1000 * positions / headcount, 6) AS per_1000 FROM q JOIN p USING (node) WHERE headcount > 0 AND 1000 * positions / headcount > 40""")
def positions_per_thousand(spark: SparkSession, folder: str) -> DataFrame:
    values = standin.node_values(spark, folder)
    posts = values.groupBy("node").agg(F.max(F.lit("2001-09-01").cast("date")).alias("period_start")).withColumn("value", F.length("node").cast("double") / 50)
    both = values.unionByName(as_values(posts, measure="plum_positions", period_type="month", source_ref="plum"))
    return rounded(checks.positions_per_thousand(both), per_1000=6)


@query("Q14 J9", f"""{_VALS}, pph AS (SELECT r.node, r.period_start, r.value / h.value AS value FROM vals r JOIN vals h ON h.node = r.node AND h.period_start = r.period_start AND h.measure = 'headcount' WHERE r.measure = 'revenue')
SELECT node, period_start, round(value, 4) AS value FROM pph WHERE period_start = (SELECT max(period_start) FROM pph) AND (value < 40000 OR value > 400000)""")
def pay_per_head(spark: SparkSession, folder: str) -> DataFrame:
    wide = standin.node_values(spark, folder).groupBy("node", "period_start").agg(
        F.max(F.when(F.col("measure") == "revenue", F.col("value"))).alias("r"), F.max(F.when(F.col("measure") == "headcount", F.col("value"))).alias("h"))
    rows = as_values(wide.withColumn("value", F.try_divide("r", "h")), measure="personnel_per_head", period_type="quarter", source_ref="derived")
    return rounded(checks.pay_per_head(rows), value=4)


@query("Q15 J10", f"""{_VALS}, s AS (SELECT node, year(period_start) AS year, cast(sum(value) AS BIGINT) AS n FROM vals WHERE measure = 'placed' GROUP BY 1, 2),
h AS (SELECT node, year(period_start) AS year, arg_max(value, period_start) AS headcount FROM vals WHERE measure = 'headcount' GROUP BY 1, 2)
SELECT node, year, n, headcount, round(n / headcount, 6) AS share FROM s JOIN h USING (node, year) WHERE n > 0 AND (n / headcount > 1.0 OR n / headcount < 0.02)""")
def response_shares(spark: SparkSession, folder: str) -> DataFrame:
    values = standin.node_values(spark, folder)
    answered = values.filter("measure = 'placed'").groupBy("node", F.trunc("period_start", "year").alias("period_start")).agg(F.sum("value").cast("long").alias("n"))
    rows = as_values(answered, measure="fevs_engagement", period_type="survey_year", source_ref="survey")
    return rounded(checks.response_share(values.unionByName(rows)), share=6)


@query("Q16", f"""{_VALS}, f AS (SELECT DISTINCT node FROM vals WHERE measure = 'placed' AND value > 8), r AS (SELECT 'N' || lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS node, 'known: ' || n_name AS reason FROM nation WHERE n_regionkey = 1)
SELECT f.node, r.reason, r.reason IS NOT NULL AS explained FROM f LEFT JOIN r ON r.node = f.node""")
def explained_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = standin.node_values(spark, folder).filter("measure = 'placed' AND value > 8").select("node").distinct()
    reasons = table(spark, folder, "nation").filter("n_regionkey = 1").selectExpr("concat('N', lpad(n_nationkey, 2, '0')) AS node", "concat('known: ', n_name) AS reason")
    return checks.explain(flags, reasons)


@query("Q17", f"""WITH {gathering.EXTRACTS_SQL}, w AS (SELECT node, period_start, sum(CASE WHEN measure = 'separations' THEN value END) AS total,
  sum(CASE WHEN measure IN ('quits', 'retirements', 'rifs', 'transfers_out', 'deferred_resignations') THEN value ELSE 0 END) AS parts FROM raw_facts
  WHERE dim IS NULL AND measure IN ('separations', 'quits', 'retirements', 'rifs', 'transfers_out', 'deferred_resignations') GROUP BY 1, 2)
SELECT node, period_start, total, parts FROM w WHERE total IS NOT NULL AND abs(total - parts) >= 0.5""")
def flow_parts_against_total(spark: SparkSession, folder: str) -> DataFrame:
    """Parts chosen so that they overlap or miss something; the true parts would give no rows."""
    return checks.flow_parts(gathering.stored_extracts(spark, folder), "separations", ["quits", "retirements", "rifs", "transfers_out", "deferred_resignations"])


@query("Q20", f"""WITH {rostering.COLLAPSED_SQL}, named AS (SELECT title FROM pos WHERE status = 'Filled' AND (first_name <> '' OR last_name <> ''))
SELECT 'directory' AS output, count(*) AS documents, 0 AS leaking FROM named
UNION ALL SELECT 'joined', count(*), count(*) FILTER (title = 'Director') FROM named""")
def leaked_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of two roster outputs that name what only workforce records may carry; the second is a deliberate mistake."""
    good = rostering.people_directory(spark, folder)
    bad = good.withColumn("grade", F.when(F.col("title") == "Director", "15"))
    documents = [df.select(F.lit(name).alias("output"), F.to_json(F.struct(*df.columns)).alias("document")) for name, df in (("directory", good), ("joined", bad))]
    return rostering.roster.leaks(documents[0].unionByName(documents[1]))


@query("Q23 P19", """SELECT page_id FROM pages WHERE regexp_matches(html, '&(#\\d+|[A-Za-z]+);')""")
def entities_left(spark: SparkSession, folder: str) -> DataFrame:
    return checks.entities_left(table(spark, folder, "pages"), ["html"]).select("page_id")


@query("K6 Q11 Q14 Q15", f"""{_VALS}, s AS (SELECT node, year(period_start) AS year, cast(sum(value) AS BIGINT) AS n FROM vals WHERE measure = 'placed' GROUP BY 1, 2),
h AS (SELECT node, year(period_start) AS year, arg_max(value, period_start) AS headcount FROM vals WHERE measure = 'headcount' GROUP BY 1, 2),
a AS (SELECT period_start, sum(CASE WHEN node = 'gov' THEN value END) AS whole, sum(CASE WHEN node LIKE 'N%' THEN value END) AS parts FROM vals WHERE measure = 'headcount' GROUP BY 1)
SELECT 'children add up' AS rule, count(*) AS violations FROM a WHERE abs(whole - parts) > 0.5
UNION ALL SELECT 'response share', count(*) FROM s JOIN h USING (node, year) WHERE n > 0 AND (n / headcount > 1.0 OR n / headcount < 0.02)""")
def check_report(spark: SparkSession, folder: str) -> DataFrame:
    return checks.report_counts(_findings(spark, folder))


def _findings(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    values = standin.node_values(spark, folder)
    answered = values.filter("measure = 'placed'").groupBy("node", F.trunc("period_start", "year").alias("period_start")).agg(F.sum("value").cast("long").alias("n"))
    rows = as_values(answered, measure="fevs_engagement", period_type="survey_year", source_ref="survey")
    return {
        "children add up": checks.children_sum(values, standin.nodes(spark, folder)),
        "response share": checks.response_share(values.unionByName(rows)),
    }


@query("K6 Q11 Q15", f"""{_VALS}, s AS (SELECT node, year(period_start) AS year, cast(sum(value) AS BIGINT) AS n FROM vals WHERE measure = 'placed' GROUP BY 1, 2),
h AS (SELECT node, year(period_start) AS year, arg_max(value, period_start) AS headcount FROM vals WHERE measure = 'headcount' GROUP BY 1, 2),
a AS (SELECT period_start, sum(CASE WHEN node = 'gov' THEN value END) AS whole, sum(CASE WHEN node LIKE 'N%' THEN value END) AS parts FROM vals WHERE measure = 'headcount' GROUP BY 1)
SELECT 'response share' AS rule, node AS subject, cast(year AS INTEGER) AS year, n, headcount FROM s JOIN h USING (node, year) WHERE n > 0 AND (n / headcount > 1.0 OR n / headcount < 0.02)
UNION ALL SELECT 'children add up', NULL, NULL, NULL, NULL FROM a WHERE abs(whole - parts) > 0.5""")
def check_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every violation as a row, with figures out of its detail."""
    def detail(name: str, kind: str) -> F.Column:
        return F.get_json_object("detail", f"$.{name}").cast(kind).alias(name)

    found = checks.report(_findings(spark, folder))
    return found.select("rule", "subject", detail("year", "int"), detail("n", "long"), detail("headcount", "double"))


_EXPECTED_HEADER = ["snapshot_yyyymm", "agency_code", "count", "grade"]
_ERA_HEADERS = {"000000": _EXPECTED_HEADER[:3], "199701": [*_EXPECTED_HEADER, "pay_plan_code"], "199901": ["agency_code", "snapshot_yyyymm", "count", "grade"]}


@query("Q1", """WITH months AS (SELECT DISTINCT year(l_shipdate) * 100 + month(l_shipdate) AS m FROM lineitem),
eras AS (SELECT CASE WHEN m < 199701 THEN 1 WHEN m < 199901 THEN 2 ELSE 3 END AS era, count(*) AS files FROM months GROUP BY 1),
drift(era, kind, name) AS (VALUES (1, 'missing', 'grade'), (2, 'added', 'pay_plan_code'), (3, 'reordered', 'agency_code'), (3, 'reordered', 'snapshot_yyyymm'),
  (3, 'reordered', 'count'), (3, 'reordered', 'grade'))
SELECT kind, name AS "column", files FROM drift JOIN eras USING (era)""")
def header_drift(spark: SparkSession, folder: str) -> DataFrame:
    """The headers of a file per month, as written in three eras, against the committed header: files per finding."""
    path, rows = scratch_path(spark, "headers"), standin.employment(spark, folder)
    lows = [*_ERA_HEADERS, "999999"]
    for low, high in zip(lows, lows[1:]):
        now = rows.filter((F.col("snapshot_yyyymm") >= low) & (F.col("snapshot_yyyymm") < high))
        named = now.withColumn("file", F.concat(F.lit("employment_"), "snapshot_yyyymm", F.lit("_1"))).select(*_ERA_HEADERS[low], "file")
        sinks.write_pipe_text(named.repartition("file"), f"{path}/{low}", ("file",))
    found = records.headers(spark, records.current_paths(spark, path, "employment")["txt"])
    findings = [(kind, c, len(files)) for names, files in found.items()
                for kind, columns in checks.header_drift(names, _EXPECTED_HEADER).items() for c in columns]
    return literal_table(spark, "kind string, column string, files long", findings)


@query("Q6 K5", f"""WITH b AS (SELECT cast(date_trunc('month', l_shipdate) AS DATE) AS build, count(DISTINCT l_suppkey) AS found FROM lineitem GROUP BY 1)
SELECT b.build, b.found, p.found AS before, coalesce(b.found >= p.found * cast({fixed.INPUT_GUARD} AS DOUBLE), true) AS accepted
FROM b LEFT JOIN b p ON p.build + INTERVAL 1 MONTH = b.build""")
def input_guard(spark: SparkSession, folder: str) -> DataFrame:
    """A build a month, with one file per supplier that ships: builds that see far fewer files than the one before are refused."""
    shipped = table(spark, folder, "lineitem").select(F.trunc("l_shipdate", "month").alias("build"), "l_suppkey")
    builds = shipped.groupBy("build").agg(F.countDistinct("l_suppkey").alias("found"))
    last = builds.select(F.add_months("build", 1).alias("build"), F.col("found").alias("before"))
    return builds.join(last, "build", "left").withColumn("accepted", checks.enough_inputs(F.col("found"), F.col("before")))


@query("K5 K1 A24", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL} SELECT 'employment' AS dataset, count(*) AS rows_out, cast(sum(n) AS BIGINT) AS people FROM facts""")
def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and people counted while the monthly facts are written, kept as a row of the runs table."""
    watch = sinks.write_facts(gathering.employment_facts(spark, folder), scratch_path(spark, "facts"), "snapshot_yyyymm")
    runs = scratch_path(spark, "runs")
    sinks.record_run(spark, runs, "employment", "all", 1, watch)
    return spark.read.parquet(runs).select("dataset", "rows_out", "people")
