"""Geography: people per node by county, state and class of location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.operators import checks, geo
from tallywell.queries import gathering
from tallywell.queries.registry import query, table

# Duty stations are parts: most are counties, some abroad, some territories, some unusable. Records know twenty codes more.
_STATIONS = {
    "code": "lpad(cast(p_partkey % 980 as string), 4, '0')",
    "name": "max(CASE WHEN p_partkey % 980 % 19 = 7 THEN 'INVALID' ELSE concat('CITY ', cast(p_partkey % 980 as string)) END)",
    "cc": "max(CASE WHEN p_partkey % 980 % 11 = 3 THEN 'GM' ELSE 'US' END)",
    "fips": "max(CASE WHEN p_partkey % 980 % 7 = 2 THEN '' ELSE lpad(cast(p_partkey % 980 % 50 * 1001 as string), 5, '0') END)",
    "st": "max(CASE WHEN p_partkey % 980 % 13 = 5 THEN '*' ELSE concat('S', cast(p_partkey % 980 % 50 as string)) END)",
}
_STATIONS_SQL = "stations AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _STATIONS.items()) + " FROM part GROUP BY 1)"
_BUCKET = """CASE WHEN f.duty_station_code = 'NDS' THEN 'nds' WHEN s.code IS NULL THEN 'invalid' WHEN s.name = 'Not disclosed' THEN 'nds' WHEN s.cc <> '' AND s.cc <> 'US' THEN 'abroad'
  WHEN regexp_full_match(s.fips, '\\d{5}') AND s.st <> '' AND s.st <> '*' THEN 'county' WHEN s.cc = 'US' AND s.name <> '' AND s.name <> 'INVALID' THEN 'territory' ELSE 'invalid' END"""
PLACES_SQL = f"""{_STATIONS_SQL},
located AS (SELECT f.org_code, f.duty_station_code, f.n, {_BUCKET} AS bucket, s.fips, s.st FROM facts f LEFT JOIN stations s ON s.code = f.duty_station_code),
dept AS (SELECT lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS a, cast(n_regionkey AS VARCHAR) AS d FROM nation),
spread AS (SELECT 'gov' AS node, * FROM located UNION ALL SELECT substr(org_code, 1, 2), * FROM located UNION ALL SELECT 'D:' || d.d, l.* FROM located l JOIN dept d ON d.a = substr(l.org_code, 1, 2)),
dist AS (SELECT node, bucket, CASE WHEN bucket = 'county' THEN fips END AS county, CASE WHEN bucket = 'county' THEN st END AS state, cast(sum(n) AS BIGINT) AS n FROM spread GROUP BY 1, 2, 3, 4)"""
_LOCATED = f"{gathering.EMPLOYMENT_FACTS_SQL}, {PLACES_SQL}"


def _stations(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    parts = [F.expr(e).alias(n) for n, e in _STATIONS.items()]
    return part.groupBy(parts[0]).agg(*parts[1:])


def station_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly facts of all months per unit and station."""
    return gathering.employment_facts(spark, folder, ("org_code", "duty_station_code"))


def _located(spark: SparkSession, folder: str, facts: DataFrame | None = None) -> DataFrame:
    facts = station_facts(spark, folder) if facts is None else facts
    return geo.locate(geo.station_counts(facts), _stations(spark, folder))


def distribution(spark: SparkSession, folder: str, facts: DataFrame | None = None) -> DataFrame:
    dept = table(spark, folder, "nation").selectExpr("lpad(n_nationkey, 2, '0') AS agency", "cast(n_regionkey AS string) AS dept")
    placed = _located(spark, folder, facts).withColumn("agency", F.substring("org_code", 1, 2)).join(dept, "agency", "left")
    return geo.distribution(placed, geo.node_targets(F.col("agency"), F.col("dept")))


@query("P34 J21 P1", f"WITH {_LOCATED} SELECT duty_station_code, bucket, cast(sum(n) AS BIGINT) AS n FROM located GROUP BY 1, 2")
def location_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder).groupBy("duty_station_code", "bucket").agg(F.sum("n").alias("n"))


@query("A28 J21", f"WITH {_LOCATED} SELECT * FROM dist")
def geographic_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return distribution(spark, folder)


@query("A28", f"""WITH {_LOCATED} SELECT node, cast(sum(n) AS BIGINT) AS n, cast(sum(CASE WHEN bucket IN ('county', 'abroad', 'territory') THEN n ELSE 0 END) AS BIGINT) AS disclosed,
  round_even(sum(CASE WHEN bucket IN ('county', 'abroad', 'territory') THEN n ELSE 0 END) / sum(n), 4) AS disclosed_share, cast(sum(CASE WHEN bucket = 'abroad' THEN n ELSE 0 END) AS BIGINT) AS abroad,
  cast(sum(CASE WHEN bucket = 'territory' THEN n ELSE 0 END) AS BIGINT) AS territory, cast(sum(CASE WHEN bucket = 'invalid' THEN n ELSE 0 END) AS BIGINT) AS invalid FROM dist GROUP BY 1""")
def location_summary(spark: SparkSession, folder: str) -> DataFrame:
    return geo.node_summary(distribution(spark, folder))


@query("A28 M7", f"""WITH {_LOCATED} SELECT node, 'counties' AS map, county AS place, cast(sum(n) AS BIGINT) AS n FROM dist WHERE bucket = 'county' GROUP BY 1, 3
UNION ALL SELECT node, 'states', state, cast(sum(n) AS BIGINT) FROM dist WHERE bucket = 'county' GROUP BY 1, 3""")
def location_maps(spark: SparkSession, folder: str) -> DataFrame:
    """The county and state maps of every node, entry by entry."""
    maps = geo.node_maps(distribution(spark, folder))
    entries = [maps.select("node", F.lit(name).alias("map"), F.explode(name).alias("place", "n")) for name in ("counties", "states")]
    return entries[0].unionByName(entries[1])


@query("Q18", f"""WITH {_LOCATED}, parts AS (SELECT node, sum(n) AS n FROM dist GROUP BY 1),
heads AS (SELECT 'gov' AS node, sum(n) AS n FROM facts UNION ALL SELECT substr(org_code, 1, 2), sum(n) FROM facts GROUP BY 1)
SELECT h.node, cast(h.n AS BIGINT) AS headcount, cast(p.n AS BIGINT) AS located, h.n = p.n AS equal FROM heads h LEFT JOIN parts p ON p.node = h.node""")
def locations_add_up(spark: SparkSession, folder: str) -> DataFrame:
    """Classes partition the headcount of every node, counted by two routes."""
    located = distribution(spark, folder).groupBy("node").agg(F.sum("n").alias("located"))
    monthly = gathering.employment_facts(spark, folder, ("snapshot_yyyymm", "org_code"))
    heads = monthly.select(F.explode(F.array(F.lit("gov"), F.substring("org_code", 1, 2))).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("headcount"))
    return heads.join(located, "node", "left").withColumn("equal", F.col("headcount") == F.col("located"))


@query("Q19 Q8", f"""WITH {gathering.EMPLOYMENT_FACTS_SQL}, {_STATIONS_SQL}
SELECT cast(sum(CASE WHEN s.code IS NULL THEN n ELSE 0 END) AS BIGINT) AS unknown, cast(sum(n) AS BIGINT) AS total, round(sum(CASE WHEN s.code IS NULL THEN n ELSE 0 END) / sum(n), 6) AS share,
  sum(CASE WHEN s.code IS NULL THEN n ELSE 0 END) / sum(n) < 0.01 AS ok FROM facts f LEFT JOIN stations s ON s.code = f.duty_station_code""")
def unknown_station_weight(spark: SparkSession, folder: str) -> DataFrame:
    rows = checks.unknown_weight(station_facts(spark, folder), "duty_station_code", _stations(spark, folder))
    return rows.withColumn("share", F.round("share", 6))
