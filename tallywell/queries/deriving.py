"""Derived measures and period algebra."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, periods
from tallywell.operators import evaluate, money
from tallywell.operators.evaluate import Measure, Term
from tallywell.plans import catalog as full
from tallywell.plans import changes, registry
from tallywell.queries import gathering, spending, standin, trees
from tallywell.queries.registry import query, rounded, table
from tallywell.schema import as_values
from tallywell.session import materialise
from tallywell.sources import tables

LEVELS = ("gov", "department", "agency")
QUARTER = "quarter"
CATALOG = {
    m.code: m
    for m in (
        Measure("placed", "Orders placed", "people", "month", LEVELS, aggregation="sum"),
        Measure("headcount", "Active customers", "people", "month", LEVELS),
        Measure("revenue", "Revenue", "currency", "month", LEVELS, aggregation="average"),
        Measure("headcount_prior", "Active the month before", "people", "month", LEVELS, pattern="time_offset", terms=(Term("headcount", offset=-1),)),
        Measure("order_rate", "Orders per 100 active the month before", "percentage", "month", ("agency",), pattern="ratio",
                terms=(Term("placed"), Term("headcount_prior"))),
        Measure("revenue_per_head", "Revenue per active customer", "currency", "month", LEVELS, pattern="ratio",
                terms=(Term("revenue"), Term("headcount")), notation="estimate"),
        Measure("net", "Orders over active customers", "people", "month", LEVELS, pattern="additive", terms=(Term("placed"), Term("headcount", -1))),
        Measure("last_two", "Orders of the two months before", "people", "month", LEVELS, pattern="additive",
                terms=(Term("placed", offset=-1), Term("placed", offset=-2))),
        Measure("quarter_rate", "Orders per 1000 active at quarter end", "rate", QUARTER, LEVELS, pattern="ratio",
                terms=(Term("placed"), Term("headcount"))),
        Measure("quarter_revenue", "Mean monthly revenue and orders", "currency", QUARTER, LEVELS, pattern="additive",
                terms=(Term("revenue"), Term("placed"))),
        Measure("year_orders", "Orders of the fiscal year", "people", "fiscal_year", LEVELS, pattern="additive", terms=(Term("placed"),)),
    )
}


# --- SQL for a level of derived measures ---------------------------------------------------------------------------
#
# The catalog enters as two literal tables, one row per measure and one per term. Observed rows are turned into
# `pieces`, what a term contributes to a node and period, in three ways: as they are, held until the next observation,
# or summarised over a longer period. One grouping of the pieces then answers all measures of the level.


def _containing(target: str, day: str = "period_start") -> str:
    return {
        "quarter": f"cast(date_trunc('quarter', {day}) AS DATE)",
        "fiscal_year": f"make_date(year({day}) - CASE WHEN month({day}) >= 10 THEN 0 ELSE 1 END, 10, 1)",
        "survey_year": f"make_date(year({day}), 1, 1)",
    }[target]


def _rows(values: list[tuple], name: str, columns: str) -> str:
    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(literal, x)) + "]"
        return f"'{x}'" if isinstance(x, str) else str(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(literal, v)) + ')' for v in values)}) {name}({columns})"


def level_sql(catalog: dict[str, Measure], level: list[Measure], source: str) -> str:
    """All rows of one level's measures, from base and earlier rows in `source`."""
    specs, terms, spans = [], [], set()
    for m in level:
        specs.append((m.code, m.cadence, m.pattern, fixed.UNIT_SCALE.get(m.unit, 1.0), m.notation, list(m.levels), len(m.terms)))
        for place, t in enumerate(m.terms):
            made = catalog[t.measure]
            rank, wanted = fixed.PERIOD_RANK[made.cadence], fixed.PERIOD_RANK[m.cadence]
            way = "finer" if rank < wanted else "none" if rank > wanted else "held" if t.carry else "same"
            step = fixed.PERIOD_MONTHS[m.cadence]
            terms.append((m.code, place, t.measure, made.cadence, t.sign, -t.offset * step, way, t.carry * step, step, m.cadence, made.aggregation or "latest",
                          fixed.PERIODS_PER_YEAR[made.cadence] // fixed.PERIODS_PER_YEAR[m.cadence]))
            if way == "finer":
                spans.add(m.cadence)
    target = " ".join(["CASE t.target WHEN 'month' THEN s.period_start", *[f"WHEN '{c}' THEN {_containing(c, 's.period_start')}" for c in sorted(spans)], "END"])
    columns = "code, place, measure, cadence, sign, months, way, carry, step, target, aggregation, expected"
    return f"""WITH specs AS (SELECT * FROM {_rows(specs, 'v', 'code, cadence, pattern, scale, note, kinds, n_terms')}),
    terms AS (SELECT * FROM {_rows(terms, 'v', columns)}),
    seen AS (SELECT measure, node, period_type, period_start, value, notation,
        lead(period_start) OVER (PARTITION BY measure, node, period_type ORDER BY period_start) AS following FROM {source} WHERE dim IS NULL),
    served AS (SELECT t.*, s.node, s.period_start, s.value, s.notation, s.following
        FROM seen s JOIN terms t ON t.measure = s.measure AND t.cadence = s.period_type),
    pieces AS (
        SELECT code, place, sign, months, node, period_start, value, notation FROM served WHERE way = 'same'
        UNION ALL
        SELECT code, place, sign, months, node, cast(unnest(generate_series(period_start,
            least(period_start + to_months(carry), coalesce(following - to_months(step), period_start)), to_months(step))) AS DATE), value, notation
        FROM served WHERE way = 'held'
        UNION ALL
        SELECT t.code, t.place, t.sign, t.months, s.node, {target} AS day,
            CASE any_value(t.aggregation) WHEN 'sum' THEN sum(s.value) WHEN 'average' THEN sum(s.value) / count(s.value)
              ELSE max({{'day': s.period_start, 'value': s.value}}) FILTER (s.value IS NOT NULL).value END,
            CASE WHEN count(*) < any_value(t.expected) THEN 'incomplete' ELSE max(s.notation) END
        FROM seen s JOIN terms t ON t.measure = s.measure AND t.cadence = s.period_type WHERE t.way = 'finer' GROUP BY 1, 2, 3, 4, 5, 6),
    met AS (SELECT code, node, cast(period_start + to_months(months) AS DATE) AS period_start,
        count(*) FILTER (place = 0) AS firsts, count(DISTINCT place) AS present, sum(sign * value) AS total, max(notation) AS worst,
        min(value) FILTER (place = 0) AS upper, min(value) FILTER (place = 1) AS lower,
        min(notation) FILTER (place = 0) AS upper_note, min(notation) FILTER (place = 1) AS lower_note FROM pieces GROUP BY 1, 2, 3),
    newest AS (SELECT period_type, max(period_start) AS until FROM {source} WHERE source_ref <> 'derived' GROUP BY 1),
    judged AS (SELECT s.*, m.*, CASE s.pattern WHEN 'ratio' THEN coalesce(lower, 0) <> 0 WHEN 'additive' THEN present = n_terms ELSE true END AS there
        FROM met m JOIN specs s USING (code) JOIN nodes k ON k.code = m.node AND list_contains(s.kinds, k.kind)
        LEFT JOIN newest e ON e.period_type = s.cadence WHERE (s.pattern <> 'ratio' OR firsts > 0) AND m.period_start <= coalesce(until, DATE '9999-01-01'))
    SELECT code AS measure, node, cadence AS period_type, period_start, cast(NULL AS VARCHAR) AS dim, cast(NULL AS VARCHAR) AS dim_value,
        CASE WHEN there THEN CASE pattern WHEN 'ratio' THEN upper / lower * scale WHEN 'additive' THEN total * scale ELSE upper END END AS value,
        CASE WHEN pattern = 'ratio' THEN cast(round(lower) AS BIGINT) END AS n,
        CASE WHEN NOT there THEN 'not_available' WHEN pattern = 'ratio' THEN coalesce(upper_note, lower_note, note) ELSE worst END AS notation,
        'derived' AS source_ref FROM judged"""


_COLUMNS = "measure, node, period_type, period_start, dim, dim_value, value, n, notation, source_ref"
_BASE = f"""{standin.NODE_VALUES_SQL},
f0 AS (SELECT measure, node, period_type, period_start, cast(NULL AS VARCHAR) AS dim, cast(NULL AS VARCHAR) AS dim_value, value,
  cast(NULL AS BIGINT) AS n, CASE WHEN measure = 'placed' AND month(period_start) = 5 THEN 'estimate' END AS notation, 'orders' AS source_ref FROM vals)"""


def levels_sql(catalog: dict[str, Measure], start: str = "f0") -> tuple[str, str]:
    """CTEs for every level and the name of the last one, which holds base and derived rows."""
    parts, source = [], start
    for i, level in enumerate(evaluate.levels(catalog), 1):
        parts.append(f"f{i} AS MATERIALIZED (SELECT {_COLUMNS} FROM {source} UNION ALL SELECT {_COLUMNS} FROM ({level_sql(catalog, level, source)}))")
        source = f"f{i}"
    return ",\n".join(parts), source


_LEVEL_PARTS, _LAST = levels_sql(CATALOG)
_RESULT = "node, period_start, round(value, 6) AS value, n, notation"


def _sql(*codes: str) -> str:
    listed = ", ".join(f"'{c}'" for c in codes)
    return f"WITH {_BASE}, {_LEVEL_PARTS} SELECT measure, {_RESULT} FROM {_LAST} WHERE measure IN ({listed})"


def base_values(spark: SparkSession, folder: str) -> DataFrame:
    values = standin.node_values(spark, folder)
    estimated = (F.col("measure") == "placed") & (F.month("period_start") == 5)
    return values.withColumn("notation", F.when(estimated, "estimate"))


def _derive(spark: SparkSession, folder: str, *codes: str) -> DataFrame:
    """The named measures and what they need. Base rows are stored, as every term reads them; two levels on top of
    them are shallow enough not to be cut."""
    wanted = {c: CATALOG[c] for c in CATALOG if c in codes or not CATALOG[c].derived}
    for code in codes:
        for term in CATALOG[code].terms:
            wanted[term.measure] = CATALOG[term.measure]
    base = materialise(base_values(spark, folder), "values")
    values = evaluate.evaluate_all(base, standin.nodes(spark, folder), wanted, cut=lambda df: df)
    rows = values.filter(F.col("measure").isin(*codes)).select("measure", "node", "period_start", "value", "n", "notation")
    return rounded(rows, value=6)


@query("D2 D1 D9 J1 J2 W3 D8", _sql("order_rate"))
def monthly_order_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Flow over the stock of the month before, per agency: the question the whole engine exists for."""
    return _derive(spark, folder, "order_rate")


@query("D2 P30 P42 D1", _sql("revenue_per_head"))
def ratio_with_default_notation(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, "revenue_per_head")


@query("D3 A22 W4 U1", _sql("net", "last_two"))
def signed_sums(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, "net", "last_two")


@query("D4 W3 D8", _sql("headcount_prior"))
def shifted_stock(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(spark, folder, "headcount_prior")


@query("D6 A21 P14 P30", _sql("quarter_rate", "quarter_revenue", "year_orders"))
def coarser_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Sums, means and last values of months in quarters and fiscal years, incomplete ones marked."""
    return _derive(spark, folder, "quarter_rate", "quarter_revenue", "year_orders")


_COARSE = {
    "yearly": Measure("yearly", "Orders of the year", "people", "fiscal_year", LEVELS, aggregation="sum"),
    "placed": CATALOG["placed"],
    "fine_share": Measure("fine_share", "Month of year", "percentage", "month", LEVELS, pattern="ratio", terms=(Term("placed"), Term("yearly"))),
}


@query("D7 D2", f"""WITH {_BASE} SELECT 'fine_share' AS measure, node, period_start, cast(NULL AS DOUBLE) AS value,
  cast(NULL AS BIGINT) AS n, 'not_available' AS notation FROM f0 WHERE measure = 'placed'""")
def coarse_is_never_spread(spark: SparkSession, folder: str) -> DataFrame:
    """A yearly component has no monthly value, so the ratio exists but is not available."""
    values = base_values(spark, folder).filter(F.col("measure") == "placed")
    yearly = values.groupBy("node", periods.containing("period_start", "fiscal_year").alias("period_start")).agg(F.sum("value").alias("value"))
    both = values.unionByName(as_values(yearly, measure="yearly", period_type="fiscal_year", source_ref="orders"))
    out = evaluate.evaluate(both, standin.nodes(spark, folder), [_COARSE["fine_share"]], _COARSE)
    return out.select("measure", "node", "period_start", "value", "n", "notation")


_SPARSE_SQL = """obs AS (SELECT cast(o_custkey AS VARCHAR) AS node, cast(date_trunc('month', o_orderdate) AS DATE) AS period_start,
  CASE WHEN min(o_orderpriority) = '1-URGENT' THEN NULL ELSE cast(count(*) AS DOUBLE) END AS value FROM orders GROUP BY 1, 2)"""


@query("J3 D5 W2 M6 P13", f"""WITH {_SPARSE_SQL},
spans AS (SELECT *, lead(period_start) OVER (PARTITION BY node ORDER BY period_start) AS following FROM obs)
SELECT node, cast(period_start + to_months(k) AS DATE) AS period_start, period_start AS observed, value
FROM spans, range(3) AS steps(k) WHERE k = 0 OR period_start + to_months(k) < following""")
def carried_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse observations per customer carried up to two months; a null-valued one stops the carry."""
    rows = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("node"), F.trunc("o_orderdate", "month").alias("period_start")
    ).agg(F.when(F.min("o_orderpriority") == "1-URGENT", None).otherwise(F.count(F.lit(1)).cast("double")).alias("value"))
    held = evaluate.carry_forward(rows.withColumn("carry", F.lit(2)).withColumn("step", F.lit(1)), ["node"])
    return held.select("node", "period_start", "observed", "value")


@query("W4 D3", f"""WITH {_BASE},
r AS (SELECT node, year(period_start) * 12 + month(period_start) AS i, period_start, value FROM f0 WHERE measure = 'placed')
SELECT a.node, a.period_start, CASE WHEN count(b.i) = 12 THEN sum(b.value) END AS value, CASE WHEN count(b.i) < 12 THEN 'not_available' END AS notation
FROM r a LEFT JOIN r b ON b.node = a.node AND b.i BETWEEN a.i - 12 AND a.i - 1 GROUP BY 1, 2""")
def trailing_twelve_months(spark: SparkSession, folder: str) -> DataFrame:
    values = base_values(spark, folder).filter(F.col("measure") == "placed")
    return evaluate.trailing_sum(values, 12).select("node", "period_start", "value", "notation")


# --- the whole registry ---------------------------------------------------------------------------------------------

_RECORD_MEASURES = {
    *gathering.EMPLOYMENT_SUMS, *gathering.ACCESSION_SUMS, *gathering.SEPARATION_SUMS,
}


def _closed(catalog: dict[str, Measure], known: set[str]) -> dict[str, Measure]:
    """The part of the catalog that can be computed from the known base measures."""
    out = {c: m for c, m in catalog.items() if c in known}
    for level in evaluate.levels(catalog):
        out.update({m.code: m for m in level if all(t.measure in out for t in m.terms)})
    return out


# The given dates lie before the first months of the real flows, so the stand-in opens every flow earlier.
RECORD_CATALOG = {
    code: replace(m, since=trees.STANDIN_SINCE) if code in dict(trees.FLOWS) else m
    for code, m in _closed(full.CATALOG, _RECORD_MEASURES).items()
}
_NODE_KINDS_SQL = """nodes AS (SELECT DISTINCT node AS code, CASE WHEN node = 'gov' THEN 'gov' WHEN node LIKE 'D:%' THEN 'department'
  WHEN length(node) = 2 THEN 'agency' ELSE 'subelement' END AS kind FROM rolled)"""
_RECORD_LEVELS, _RECORD_LAST = levels_sql(RECORD_CATALOG, "f0")
_REGISTRY_SQL = f"""{trees.ROLLED_SQL}, {trees.ZERO_SQL}, {_NODE_KINDS_SQL},
f0 AS MATERIALIZED (SELECT measure, node, period_type, period_start, dim, dim_value, value, cast(NULL AS BIGINT) AS n, cast(NULL AS VARCHAR) AS notation, source_ref
  FROM (SELECT * FROM rolled UNION ALL SELECT * FROM zeros)), {_RECORD_LEVELS}"""


def _record_nodes(extracts: DataFrame, edges: DataFrame) -> DataFrame:
    """Units and agencies that occur, all departments and the government."""
    units = extracts.filter("dim IS NULL").select("node").distinct().select(
        F.col("node").alias("code"), F.when(F.length("node") == 2, "agency").otherwise("subelement").alias("kind"))
    agencies = units.select(F.substring("code", 1, 2).alias("code")).distinct().withColumn("kind", F.lit("agency"))
    departments = edges.select(F.col("dept").alias("code")).distinct().withColumn("kind", F.lit("department"))
    return units.unionByName(agencies).unionByName(departments).unionByName(spark_root(extracts.sparkSession))


def spark_root(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT 'gov' AS code, 'gov' AS kind")


def record_values(spark: SparkSession, folder: str) -> DataFrame:
    """The whole build over the three record kinds; stored tables cut the lineage."""
    extracts, edges = gathering.stored_extracts(spark, folder), trees.agency_department(spark, folder)
    nodes = materialise(_record_nodes(extracts, edges), "nodes")
    return registry.build_values(registry.Sources(extracts, nodes, edges), RECORD_CATALOG, cut=lambda df: materialise(df, "build"))


@query("D10 D11 D2 D3 D4 D5 A8 A9", f"""WITH {_REGISTRY_SQL}
SELECT measure, period_type, count(*) AS rows_out, count(value) AS with_value, count(DISTINCT node) AS nodes, round(sum(value), 4) AS total,
  cast(sum(n) AS BIGINT) AS n, count(notation) AS noted FROM {_RECORD_LAST} WHERE source_ref = 'derived' GROUP BY 1, 2""")
def registry_summary(spark: SparkSession, folder: str) -> DataFrame:
    """From records to all workforce measures, derived by level, summed per measure."""
    values = record_values(spark, folder)
    return rounded(values.filter(F.col("source_ref") == "derived").groupBy("measure", "period_type").agg(
        F.count(F.lit(1)).alias("rows_out"), F.count("value").alias("with_value"), F.countDistinct("node").alias("nodes"),
        F.sum("value").alias("total"), F.sum("n").alias("n"), F.count("notation").alias("noted")), total=4)


@query("D11 Q5", f"""WITH {_REGISTRY_SQL}
SELECT measure, node, period_start, round(value, 6) AS value, n, notation FROM {_RECORD_LAST}
WHERE measure IN ('quit_rate', 'headcount_prior_month', 'net_change', 'first_year_attrition_rate', 'span_of_control')""")
def workforce_rates(spark: SparkSession, folder: str) -> DataFrame:
    values = record_values(spark, folder)
    wanted = ("quit_rate", "headcount_prior_month", "net_change", "first_year_attrition_rate", "span_of_control")
    return rounded(values.filter(F.col("measure").isin(*wanted)).select("measure", "node", "period_start", "value", "n", "notation"), value=6)


# One agency's records of one month are published again: people doubled, all quits withdrawn. The month lies two years
# before the last one, whatever the last one is.
_RESTATED = "period_start = (SELECT max(period_start) - INTERVAL 24 MONTH FROM first_facts) AND substr(node, 1, 2) = '03'"
_RESTATED_SQL = _REGISTRY_SQL.replace("raw_facts AS (SELECT", "first_facts AS (SELECT", 1).replace(
    trees.AGENCY_DEPARTMENT_SQL, f"""raw_facts AS (SELECT * EXCLUDE (again) REPLACE (CASE WHEN measure = 'headcount' AND again THEN value * 2 ELSE value END AS value,
  CASE WHEN again THEN source_ref || '2' ELSE source_ref END AS source_ref)
  FROM (SELECT *, {_RESTATED} AS again FROM first_facts)
  WHERE NOT (again AND measure = 'quits')), {trees.AGENCY_DEPARTMENT_SQL}""", 1)


@query("D10 S13 A7 A8 A9 J9", f"""WITH {_RESTATED_SQL}
SELECT measure, period_type, count(*) AS rows_out, count(value) AS with_value, count(DISTINCT node) AS nodes, round(sum(value), 4) AS total,
  cast(sum(n) AS BIGINT) AS n, count(notation) AS noted FROM {_RECORD_LAST} GROUP BY 1, 2""")
def restated_month(spark: SparkSession, folder: str) -> DataFrame:
    """A built table brought up to date after one agency's month was published again; SQL builds everything anew."""
    def cut(df: DataFrame) -> DataFrame:
        return materialise(df, "build")

    extracts, edges = gathering.stored_extracts(spark, folder), trees.agency_department(spark, folder)
    nodes = materialise(_record_nodes(extracts, edges), "nodes")
    old = materialise(registry.build_values(registry.Sources(extracts, nodes, edges), RECORD_CATALOG, cut), "values")
    month = F.add_months(extracts.select(F.max("period_start")).scalar(), -24)
    again = (F.col("period_start") == month) & (F.substring("node", 1, 2) == "03")
    first = extracts.filter(again)
    second = first.filter("measure <> 'quits'").withColumns({
        "value": F.when(F.col("measure") == "headcount", F.col("value") * 2).otherwise(F.col("value")),
        "source_ref": F.concat("source_ref", F.lit("2"))})
    first, second = materialise(first, "first"), materialise(second, "second")
    now = registry.Sources(extracts.filter(~again).unionByName(second), nodes, edges)
    values = changes.update_values(old, first, now, RECORD_CATALOG, cut, after=second).values
    return rounded(values.groupBy("measure", "period_type").agg(
        F.count(F.lit(1)).alias("rows_out"), F.count("value").alias("with_value"), F.countDistinct("node").alias("nodes"),
        F.sum("value").alias("total"), F.sum("n").alias("n"), F.count("notation").alias("noted")), total=4)


# With money and full-time equivalents appended before anything is derived: people by month, money by quarter.
BUILD_CATALOG = {
    **_closed(full.CATALOG, {*_RECORD_MEASURES, *fixed.MONEY_MEASURES, "omb_fte"}), **RECORD_CATALOG,
}


_BESIDE_SQL = f"""WITH {trees.ROLLED_SQL}, {trees._MEMBERS_SQL}, {spending._ROLLING_SQL}, {spending._FTE_SQL},
heads AS (SELECT g.gid AS node, f.period_start, sum(f.value * g.sign) AS value FROM members g JOIN rolled f ON f.node = g.code
  WHERE f.measure = 'headcount' AND f.dim IS NULL GROUP BY 1, 2),
quarters AS (SELECT node, cast(date_trunc('quarter', period_start) AS DATE) AS period_start, arg_max(value, period_start) AS people, count(*) AS months FROM heads GROUP BY 1, 2),
spent AS (SELECT 'g' || cast(n_regionkey AS VARCHAR) AS node, cast(make_date(fy - 1, 10, 1) + INTERVAL (3 * (quarter - 1)) MONTH AS DATE) AS period_start,
  round(sum(CASE WHEN bucket = 'personnel' THEN obligations ELSE 0 END), 2) AS personnel, round(sum(CASE WHEN bucket = 'contracted' THEN obligations ELSE 0 END), 2) AS contracted
  FROM rolling JOIN nation ON agency_name = 'AGENCY ' || cast(n_nationkey AS VARCHAR) GROUP BY 1, 2)
SELECT 'insourcing_ratio' AS measure, node, period_start, personnel / nullif(personnel + contracted, 0) AS value,
  CASE WHEN personnel + contracted = 0 THEN 'not_available' END AS notation FROM spent
UNION ALL SELECT 'personnel_per_head', s.node, s.period_start, personnel / nullif(people, 0),
  CASE WHEN coalesce(people, 0) = 0 THEN 'not_available' WHEN months < 3 THEN 'incomplete' END
  FROM spent s LEFT JOIN quarters q ON q.node = s.node AND q.period_start = s.period_start
UNION ALL SELECT 'omb_fte', 'g' || cast(n_regionkey AS VARCHAR), make_date(fy - 1, 10, 1), cast(sum(fte) AS DOUBLE), CASE WHEN max(kind) = 'estimate' THEN 'estimate' END
  FROM fte JOIN nation ON n_name = label GROUP BY n_regionkey, fy"""


def _beside_people(spark: SparkSession, folder: str, fte: DataFrame) -> DataFrame:
    extracts, edges = gathering.stored_extracts(spark, folder), trees.agency_department(spark, folder)
    gid = F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))
    nation = table(spark, folder, "nation")
    groups = nation.select(gid.alias("code")).distinct().withColumn("kind", F.lit("group"))
    obligations = money.bucket_measures(
        spending._rolling(spark, folder), nation.select(gid.alias("gid"), F.concat(F.lit("AGENCY "), F.col("n_nationkey").cast("string")).alias("agency_name")))
    equivalents = money.fte_by_group(fte, nation.select(gid.alias("gid"), F.col("n_name").alias("label")))
    sources = registry.Sources(
        extracts, materialise(_record_nodes(extracts, edges).unionByName(groups), "nodes"), edges, tables.group_members(trees._groups(spark, folder)),
        [materialise(rounded(obligations, value=2), "obligations"), materialise(equivalents, "equivalents")])
    values = registry.build_values(sources, BUILD_CATALOG, cut=lambda df: materialise(df, "build"))
    wanted = values.filter(F.col("measure").isin("insourcing_ratio", "personnel_per_head", "omb_fte"))
    return wanted.select("measure", "node", "period_start", "value", "notation")


@query("U2 D6 D10 A18 A22", _BESIDE_SQL)
def money_beside_people(spark: SparkSession, folder: str) -> DataFrame:
    """The whole build over records, group definitions, obligations and full-time equivalents: what needs all of them.

    Obligations are whole cents, so quotients agree without rounding.
    """
    return _beside_people(spark, folder, spending._fte(spark, folder))


# --- period algebra -----------------------------------------------------------------------------------------------

_DAYS_SQL = "days AS (SELECT DISTINCT cast(o_orderdate AS DATE) AS d FROM orders)"


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query("P11 P12 P13 P14", f"""WITH {_DAYS_SQL}
SELECT d, strftime(d, '%Y%m') AS code, cast(date_trunc('month', d) AS DATE) AS month_start,
  cast(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
  cast(CASE WHEN month(d) >= 10 THEN 1 ELSE (month(d) + 5) // 3 END AS INTEGER) AS fiscal_quarter,
  {_containing('fiscal_year', 'd')} AS fiscal_year_start, {_containing('quarter', 'd')} AS quarter_start, {_containing('survey_year', 'd')} AS survey_year_start,
  cast(date_trunc('month', d) + INTERVAL 5 MONTH AS DATE) AS five_months_on, cast(date_trunc('quarter', d) - INTERVAL 6 MONTH AS DATE) AS two_quarters_back
FROM days""")
def period_algebra(spark: SparkSession, folder: str) -> DataFrame:
    fy, quarter = periods.fiscal_year("d"), periods.fiscal_quarter("d")
    return _days(spark, folder).select(
        "d", periods.month_code("d").alias("code"), periods.month_start(periods.month_code("d")).alias("month_start"),
        fy.alias("fiscal_year"), quarter.alias("fiscal_quarter"), periods.fiscal_year_start(fy).alias("fiscal_year_start"),
        periods.fiscal_quarter_start(fy, quarter).alias("quarter_start"), periods.survey_year_start(F.year("d")).alias("survey_year_start"),
        periods.shift(F.trunc("d", "month"), "month", 5).alias("five_months_on"),
        periods.shift(periods.containing("d", "quarter"), F.lit("quarter"), -2).alias("two_quarters_back"))


@query("P15", f"""WITH {_DAYS_SQL}
SELECT d, strftime(d, '%b %Y') AS month_label,
  'FY' || cast(year(d) + (month(d) >= 10)::INTEGER AS VARCHAR) || ' Q' || cast(CASE WHEN month(d) >= 10 THEN 1 ELSE (month(d) + 5) // 3 END AS VARCHAR) AS quarter_label,
  'FY' || cast(year(d) + (month(d) >= 10)::INTEGER AS VARCHAR) AS year_label, cast(year(d) AS VARCHAR) AS survey_label FROM days""")
def period_labels(spark: SparkSession, folder: str) -> DataFrame:
    def label(kind: str) -> F.Column:
        return periods.period_label(F.lit(kind), "d")

    return _days(spark, folder).select("d", label("month").alias("month_label"), label("quarter").alias("quarter_label"),
                                       label("fiscal_year").alias("year_label"), label("survey_year").alias("survey_label"))


@query("P17 P18 J23", f"""WITH {_DAYS_SQL}
SELECT d, cast(date_trunc('quarter', d) - INTERVAL 3 MONTH AS DATE) AS closed, strftime(date_trunc('quarter', d) - INTERVAL 1 MONTH, '%Y%m') AS closed_end,
  strftime(d - INTERVAL 1 YEAR, '%Y%m') AS year_before, len(generate_series(DATE '1994-10-01', date_trunc('quarter', d), INTERVAL 3 MONTH)) AS quarters
FROM days""")
def quarter_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    closed = periods.closed_quarter("d")
    first = F.lit("1994-10-01").cast("date")
    return _days(spark, folder).select(
        "d", closed.alias("closed"), periods.quarter_end_month(closed).alias("closed_end"),
        periods.year_before(periods.month_code("d")).alias("year_before"),
        F.size(periods.quarter_range(first, periods.containing("d", "quarter"))).cast("long").alias("quarters"))


@query("P29", f"""WITH {_BASE}, ax AS (SELECT DISTINCT period_start, dense_rank() OVER (ORDER BY period_start DESC) AS back FROM f0),
cut AS (SELECT min(period_start) AS c FROM ax WHERE back <= 25)
SELECT measure, node, period_start, round(value, 2) AS value FROM f0 WHERE period_start >= (SELECT c FROM cut) AND period_start >= DATE '1996-01-01'""")
def last_24_months(spark: SparkSession, folder: str) -> DataFrame:
    rows = periods.since(periods.last_periods(base_values(spark, folder), 24), "1996-01-01")
    return rounded(rows.select("measure", "node", "period_start", "value"), value=2)


# --- cleaning of single fields -----------------------------------------------------------------------------------------


@query("P19 P21 P32 Q23", r"""
SELECT page_id, trim(replace(replace(replace(replace(trim(html), '&#039;', ''''), '&amp;', '&'), '&quot;', '"'), '&nbsp;', ' ')) = trim(html) AS unchanged,
  length(replace(replace(replace(replace(trim(html), '&#039;', ''''), '&amp;', '&'), '&quot;', '"'), '&nbsp;', ' ')) AS decoded_length,
  nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS page,
  try_cast(trim(replace(replace('$' || regexp_extract(url, '/(\d+)', 1) || ',000', ',', ''), '$', '')) AS DOUBLE) AS number
FROM pages""")
def cleaned_pages(spark: SparkSession, folder: str) -> DataFrame:
    decoded = clean.decode_entities("html")
    return table(spark, folder, "pages").select(
        "page_id", (decoded == F.trim("html")).alias("unchanged"), F.length(decoded).cast("long").alias("decoded_length"),
        clean.blank_to_null(F.regexp_extract("url", r"page=(\d+)", 1)).alias("page"),
        clean.plain_number(F.concat(F.lit("$"), F.regexp_extract("url", r"/(\d+)", 1), F.lit(",000"))).alias("number"))


@query("P20 P21", """
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 'P' THEN '' ELSE 'soon' END AS txt FROM orders)
SELECT o_orderkey, cast(try_strptime(nullif(txt, ''), '%m/%d/%Y') AS DATE) AS day FROM t""")
def us_dates(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderstatus") == "P", "").otherwise("soon")
    return table(spark, folder, "orders").select("o_orderkey", clean.us_date(text).alias("day"))


@query("P30 P31", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_tax AS x, CASE WHEN abs(l_extendedprice) >= 100 THEN round(l_extendedprice, 2) ELSE round(l_extendedprice, 4) END AS shown,
  l_quantity * CASE WHEN l_returnflag = 'R' THEN 100.0 WHEN l_returnflag = 'A' THEN 1000.0 ELSE 1.0 END AS scaled FROM lineitem""")
def display_values(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "R", "percentage").when(F.col("l_returnflag") == "A", "rate").otherwise("people")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * F.col("l_tax")).alias("x"),
        clean.display_round("l_extendedprice").alias("shown"), clean.scaled("l_quantity", unit).alias("scaled"))
