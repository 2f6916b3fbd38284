"""Whole documents of nodes, written, read back and taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.operators import documents, facts, roster, views
from tallywell.queries import gathering, locating, rostering, standin
from tallywell.queries.registry import query, table
from tallywell.session import materialise, scratch_path

_TREND = ("age_bracket", "work_schedule_code")


def _flows(spark: SparkSession, folder: str, kind: str, category: str, rows: DataFrame) -> DataFrame:
    monthly = facts.fact_rollup(rows, kind, "personnel_action_effective_date_yyyymm", ("effective_yyyymm", "org_code", category))
    dept = table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS agency", "concat('D:', n_regionkey) AS dept")
    placed = monthly.withColumn("agency", F.substring("org_code", 1, 2)).join(dept, "agency", "left")
    return views.flow_series(placed, category, F.array(F.lit("gov"), F.col("agency"), F.col("dept")))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """What all parts say about all nodes. Positions stand with the agency of their organisation's number."""
    values = gathering.stored_extracts(spark, folder)
    # Of the monthly facts, the dimensions that the parts read: all of them give nearly a row per record.
    monthly = materialise(gathering.employment_facts(spark, folder, ("snapshot_yyyymm", "org_code", *_TREND)), "facts")
    stations = materialise(locating.station_facts(spark, folder), "stations")
    agency = F.substring("org_code", 1, 2)
    people = rostering.current_roster(spark, folder).withColumn("node", F.lpad(F.replace("org_name", F.lit("ORG "), F.lit("")), 2, "0"))
    parts = [
        documents.measures(values), documents.dims(values), documents.dims_now(values),
        documents.geography(locating.distribution(spark, folder, stations)),
        documents.trend(views.dimension_trend(monthly, _TREND, F.array(F.lit("gov"), agency))),
        documents.mix(views.mix_summary(stations, agency)),
        documents.flows(_flows(spark, folder, "accessions", "accession_category_code", standin.accessions(spark, folder)), "accessions"),
        documents.flows(_flows(spark, folder, "separations", "separation_category_code", standin.separations(spark, folder)), "separations"),
        documents.positions(people),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def taken_apart(read: DataFrame) -> DataFrame:
    """(node, part, a, b, c, value): every figure in documents, with the names that lead to it."""
    def rows(df: DataFrame, part: str, a: Column, b: Column, c: Column, value: Column) -> DataFrame:
        return df.select("node", F.lit(part).alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), value.cast("double").alias("value"))

    def each(part: str, depth: int) -> DataFrame:
        out = read.select("node", F.explode(part).alias("k0", "v0"))
        for i in range(1, depth):
            out = out.select("node", *[f"k{j}" for j in range(i)], F.explode(f"v{i - 1}").alias(f"k{i}", f"v{i}"))
        return out

    none = F.lit("")
    series = each("measures", 1).select("node", "k0", "v0.t", "v0.i", F.posexplode("v0.v").alias("pos", "v"))
    trends = each("dims", 3).select("node", "k0", "k1", "k2", "v2.i", F.posexplode("v2.v").alias("pos", "v"))
    place = (F.col("i") + F.col("pos")).cast("string")

    def fields(path: str) -> DataFrame:
        names = read.select(f"{path}.*").columns
        return read.filter(F.col(path).isNotNull()).select("node", F.explode(F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"{path}.{n}").cast("double") for n in names]))).alias("k", "v"))

    def listed(path: str) -> DataFrame:
        return read.select("node", F.explode(path).alias("k", "v"))

    position = read.select("node", F.explode("roster").alias("p"))
    held = F.concat_ws("@", F.coalesce("p.individual_id", none), F.coalesce(F.col("p.begin_date").cast("string"), none))
    parts = [
        rows(series, "measures", F.col("k0"), F.col("t"), place, F.col("v")),
        rows(trends, "dims", F.col("k0"), F.col("k1"), F.concat_ws("@", "k2", place), F.col("v")),
        rows(each("dims_now", 3), "dims_now", F.col("k0"), F.col("k1"), F.col("k2"), F.col("v2")),
        rows(fields("geography.summary"), "geography", F.lit("summary"), F.col("k"), none, F.col("v")),
        rows(listed("geography.counties"), "geography", F.lit("counties"), F.col("k"), none, F.col("v")),
        rows(listed("geography.states"), "geography", F.lit("states"), F.col("k"), none, F.col("v")),
        rows(each("trend", 3), "trend", F.col("k0"), F.col("k1"), F.col("k2"), F.col("v2")),
        rows(fields("mix.summary"), "mix", F.lit("summary"), F.col("k"), none, F.col("v")),
        rows(each("accessions", 2), "accessions", F.col("k0"), F.col("k1"), none, F.col("v1")),
        rows(each("separations", 2), "separations", F.col("k0"), F.col("k1"), none, F.col("v1")),
        rows(position, "roster", F.col("p.title"), F.coalesce("p.name", none), held, F.col("p.rank")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull()).withColumn("value", F.round("value", 2))


def _top_sql(name: str, source: str, group: str, keep: int, order: str) -> str:
    """The `keep` largest items per group by `order`, the others as one."""
    return f"""{name}_ranked AS (SELECT {group}, item, row_number() OVER (PARTITION BY {group} ORDER BY {order} DESC, item) AS rn
  FROM (SELECT s.*, max(period) OVER (PARTITION BY {group}) AS newest FROM {source} s) GROUP BY {group}, item),
{name} AS (SELECT {group}, period, CASE WHEN rn <= {keep} THEN item ELSE '{fixed.OTHER}' END AS item, sum(value) AS value
  FROM {source} JOIN {name}_ranked USING ({group}, item) GROUP BY ALL)"""


def _flow_sql(kind: str, category: str) -> str:
    return f"""SELECT node, '{kind}', CASE WHEN {category} = '' THEN '{fixed.BLANK}' ELSE {category} END,
  CASE WHEN coalesce(effective_yyyymm, '') = '' THEN '{fixed.BLANK}' ELSE effective_yyyymm END, '', sum(n)
  FROM (SELECT f.*, unnest(['gov', substr(org_code, 1, 2), 'D:' || d]) AS node
    FROM ({gathering._fact_sql(kind, kind)}) f LEFT JOIN dept ON a = substr(org_code, 1, 2)) WHERE node IS NOT NULL AND {category} IS NOT NULL GROUP BY ALL"""


_AT_END = "coalesce(sum(value) FILTER (period = newest), 0)"
_DIM = f"CASE WHEN coalesce(dim_value, '') = '' THEN '{fixed.BLANK}' ELSE dim_value END"
_TREND_SQL = " UNION ALL ".join(
    f"SELECT node, '{d}' AS dim, CASE WHEN coalesce({d}, '') = '' THEN '{fixed.BLANK}' ELSE {d} END AS item, snapshot_yyyymm AS period, sum(n) AS value FROM wide GROUP BY ALL"
    for d in _TREND)
_SHARES = {"disclosed": "county abroad territory", "abroad": "abroad", "territory": "territory", "invalid": "invalid"}
_COUNTERS_SQL = ", ".join(
    f"sum(CASE WHEN bucket IN ({', '.join(repr(b) for b in buckets.split())}) THEN n ELSE 0 END)::DOUBLE AS {name}" for name, buckets in _SHARES.items())


@query("K3 M7 K2 A23 A28 A30 A31 A36 A10", f"""
WITH {gathering.EXTRACTS_SQL}, facts AS ({gathering._fact_sql('employment', 'employment')}), {locating.PLACES_SQL}, {rostering.COLLAPSED_SQL},
axis AS (SELECT period_start, row_number() OVER (ORDER BY period_start) - 1 AS pos FROM (SELECT DISTINCT period_start FROM raw_facts)),
dimmed AS (SELECT node, measure, dim, {_DIM} AS item, period_start AS period, sum(value) AS value FROM raw_facts
  WHERE dim IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
recent AS (SELECT * FROM dimmed WHERE dim IN {fixed.TREND_DIMS}
  AND period >= (SELECT period_start FROM axis WHERE pos = (SELECT greatest(max(pos) - {fixed.TREND_MONTHS - 1}, 0) FROM axis))),
{_top_sql('dims', 'recent', 'node, measure, dim', fixed.TREND_TOP, _AT_END)},
newest AS (SELECT * FROM dimmed WHERE period = (SELECT max(period_start) FROM raw_facts WHERE measure = 'headcount' AND dim IS NULL)),
{_top_sql('dims_now', 'newest', 'node, measure, dim', fixed.NOW_TOP, 'sum(value)')},
wide AS (SELECT 'gov' AS node, * FROM facts UNION ALL SELECT substr(org_code, 1, 2), * FROM facts), trends AS ({_TREND_SQL}),
{_top_sql('trend', 'trends', 'node, dim', fixed.TREND_TOP, _AT_END)},
counted AS (SELECT node, sum(n)::DOUBLE AS n, {_COUNTERS_SQL} FROM dist GROUP BY 1),
counters AS (SELECT *, round_even(disclosed / n, 4) AS disclosed_share FROM counted),
mixed AS (SELECT substr(org_code, 1, 2) AS node, sum(n)::DOUBLE AS n, round_even(sum(CASE WHEN duty_station_code <> 'NDS' THEN n ELSE 0 END) / sum(n), 4) AS disclosed_location_share,
  round_even(sum(pay_n) / sum(n), 4) AS pay_disclosed_share, round(sum(pay_sum) / nullif(sum(pay_n), 0), 0) AS avg_pay, round(sum(los_sum) / sum(n), 1) AS avg_los FROM facts GROUP BY 1),
rows(node, part, a, b, c, value) AS (
  SELECT node, 'measures', measure, 'month', cast(pos AS VARCHAR), value FROM raw_facts JOIN axis USING (period_start) WHERE dim IS NULL AND value IS NOT NULL
  UNION ALL SELECT node, 'dims', measure, dim, item || '@' || cast(pos AS VARCHAR), value FROM dims JOIN axis ON period_start = period
  UNION ALL SELECT node, 'dims_now', measure, dim, item, value FROM dims_now
  UNION ALL SELECT node, 'geography', 'summary', name, '', value FROM (UNPIVOT counters ON COLUMNS(* EXCLUDE node) INTO NAME name VALUE value)
  UNION ALL SELECT node, 'geography', 'counties', county, '', sum(n) FROM dist WHERE bucket = 'county' GROUP BY ALL
  UNION ALL SELECT node, 'geography', 'states', state, '', sum(n) FROM dist WHERE bucket = 'county' GROUP BY ALL
  UNION ALL SELECT node, 'trend', dim, item, period, value FROM trend
  UNION ALL SELECT node, 'mix', 'summary', name, '', value FROM (UNPIVOT mixed ON COLUMNS(* EXCLUDE node) INTO NAME name VALUE value)
  UNION ALL {_flow_sql('accessions', 'accession_category_code')}
  UNION ALL {_flow_sql('separations', 'separation_category_code')}
  UNION ALL SELECT lpad(replace(p.org_name, 'ORG ', ''), 2, '0'), 'roster', title, coalesce({rostering.FULL_NAME_SQL}, ''),
    coalesce(individual_id, '') || '@' || coalesce(cast(begin_date AS VARCHAR), ''), {rostering.RANK_SQL}
    FROM pos p JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name WHERE status <> 'Historical')
SELECT node, part, a, b, c, round(cast(value AS DOUBLE), 2) AS value FROM rows""")
def whole_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Series, dimensions, geography, trend, mix, actions and roster of every node in its documents."""
    path = scratch_path(spark, "documents")
    documents.write(documents.assemble(entries(spark, folder)), path)
    return taken_apart(documents.read(spark, path))
