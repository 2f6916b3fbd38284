"""Rosters: events as sightings of positions, days as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.functions import names
from tallywell.operators import roster
from tallywell.queries import standin
from tallywell.queries.registry import query, table

# One sighting per event; a user is a person, an event type a kind of position.
_SIGHTING = {
    "snapshot": "cast(ts as date)",
    "agency_name": "concat('AGENCY ', cast(user_id % 5 as string))",
    "org_name": "concat('ORG ', cast(user_id % 12 as string))",
    "title": "CASE event_type WHEN 'purchase' THEN 'Secretary of Trade' WHEN 'signup' THEN 'Director' WHEN 'view' THEN 'Deputy Secretary' WHEN 'click' THEN 'Chief of Staff' ELSE 'Adviser' END",
    "status": "CASE WHEN event_type = 'error' THEN 'Vacant' WHEN user_id % 17 = 3 THEN 'Historical' ELSE 'Filled' END",
    "appointment_type": "CASE user_id % 6 WHEN 0 THEN 'PAS' WHEN 1 THEN 'PA' WHEN 2 THEN 'CA' WHEN 3 THEN 'NA' WHEN 4 THEN 'SC' ELSE 'ZZ' END",
    "first_name": "CASE WHEN event_type = 'error' THEN '' ELSE concat('First', cast(user_id as string)) END",
    "last_name": "CASE WHEN event_type = 'error' THEN '' ELSE concat('Last', cast(user_id % 40 as string)) END",
    "individual_id": "CASE WHEN event_type = 'error' THEN NULL ELSE cast(user_id as string) END",
    "begin_date": "CASE WHEN event_type = 'view' THEN NULL ELSE cast(concat('20', cast(10 + user_id % 14 as string), '-0', cast(1 + length(event_type) % 9 as string), '-01') as date) END",
}
_COLUMNS = [c for c in _SIGHTING if c != "snapshot"]
COLLAPSED_SQL = f"""{standin.cte("sightings", _SIGHTING, "events")},
pos AS (SELECT {", ".join(_COLUMNS)}, min(snapshot) AS first_snapshot, max(snapshot) AS last_snapshot FROM sightings GROUP BY ALL),
xw AS (SELECT DISTINCT agency_name, org_name, 'A' || right(agency_name, 1) || replace(org_name, 'ORG ', '') AS node, 'A' || right(agency_name, 1) AS agency FROM sightings WHERE org_name <> 'ORG 7')"""
FULL_NAME_SQL = "nullif(concat_ws(' ', nullif(first_name, ''), nullif(last_name, '')), '')"


def _sightings(spark: SparkSession, folder: str) -> DataFrame:
    return standin.select(table(spark, folder, "events"), _SIGHTING)


def _positions(spark: SparkSession, folder: str) -> DataFrame:
    return roster.collapse_snapshots(_sightings(spark, folder), _COLUMNS)


def _crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _sightings(spark, folder).select("agency_name", "org_name").distinct().filter("org_name <> 'ORG 7'")
    agency = F.concat(F.lit("A"), F.element_at(F.split("agency_name", " "), -1))
    return pairs.select("agency_name", "org_name", F.concat(agency, F.element_at(F.split("org_name", " "), -1)).alias("node"), agency.alias("agency"))


@query("A19", f"WITH {COLLAPSED_SQL} SELECT * FROM pos")
def collapsed_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return _positions(spark, folder)


@query("A19", f"WITH {COLLAPSED_SQL} SELECT * FROM pos")
def carried_history(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier collapsed history and later snapshots collapse to the same spans as all snapshots at once."""
    sightings = _sightings(spark, folder)
    middle = sightings.select(F.percentile_approx(F.unix_date("snapshot"), 0.5)).scalar()
    old = roster.collapse_snapshots(sightings.filter(F.unix_date("snapshot") <= middle), _COLUMNS)
    return roster.collapse_snapshots(sightings.filter(F.unix_date("snapshot") > middle), _COLUMNS, carried=old)


_COUNTS = """count(*) AS plum_positions, cast(sum((status = 'Filled')::INTEGER) AS BIGINT) AS plum_filled, cast(sum((status = 'Vacant')::INTEGER) AS BIGINT) AS plum_vacant,
  cast(sum((status = 'Filled' AND appointment_type IN ('PAS','PA','SC','NA','TA'))::INTEGER) AS BIGINT) AS plum_political,
  cast(sum((status = 'Filled' AND appointment_type NOT IN ('PAS','PA','SC','NA','TA'))::INTEGER) AS BIGINT) AS plum_career"""


@query("A20 J13", f"""WITH {COLLAPSED_SQL} SELECT x.agency, p.last_snapshot AS snapshot, {_COUNTS}
FROM pos p JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name WHERE status <> 'Historical' GROUP BY 1, 2""")
def status_counts_at_last_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return roster.status_counts(roster.place(_positions(spark, folder), _crosswalk(spark, folder)))


@query("A20 J13", f"""WITH {COLLAPSED_SQL}, s AS (SELECT DISTINCT snapshot FROM sightings)
SELECT x.agency, s.snapshot, {_COUNTS} FROM pos p JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name
JOIN s ON s.snapshot BETWEEN p.first_snapshot AND p.last_snapshot WHERE status <> 'Historical' GROUP BY 1, 2""")
def status_counts_at_every_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A position counts in each snapshot between its first and its last, so later snapshots restate nothing."""
    placed = roster.place(_positions(spark, folder), _crosswalk(spark, folder))
    return roster.status_counts(placed, _sightings(spark, folder).select("snapshot").distinct())


@query("A20 M3", f"""WITH {COLLAPSED_SQL}, c AS (SELECT x.agency, p.last_snapshot AS snapshot, {_COUNTS}
FROM pos p JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name WHERE status <> 'Historical' GROUP BY 1, 2),
l AS (UNPIVOT c ON plum_positions, plum_filled, plum_vacant, plum_political, plum_career INTO NAME measure VALUE value)
SELECT measure, agency AS node, cast(date_trunc('month', snapshot) AS DATE) AS period_start, cast(value AS DOUBLE) AS value, 'plum:' || cast(snapshot AS VARCHAR) AS source_ref FROM l""")
def roster_measures(spark: SparkSession, folder: str) -> DataFrame:
    counts = roster.status_counts(roster.place(_positions(spark, folder), _crosswalk(spark, folder)))
    return roster.status_values(counts).select("measure", "node", "period_start", "value", "source_ref")


RANK_SQL = """CASE WHEN upper(title) LIKE 'SECRETARY%' OR upper(title) LIKE 'ATTORNEY GENERAL%' OR upper(title) = 'ADMINISTRATOR' OR (upper(title) = 'DIRECTOR' AND appointment_type = 'PAS') THEN 0
  WHEN upper(title) LIKE 'DEPUTY SECRETARY%' OR upper(title) LIKE 'DEPUTY ATTORNEY GENERAL%' OR upper(title) LIKE 'DEPUTY ADMINISTRATOR%' THEN 1
  WHEN upper(title) LIKE 'UNDER SECRETARY%' OR upper(title) LIKE 'ASSOCIATE ATTORNEY GENERAL%' THEN 2
  WHEN upper(title) LIKE 'ASSISTANT SECRETARY%' OR upper(title) LIKE 'GENERAL COUNSEL%' OR upper(title) LIKE 'INSPECTOR GENERAL%' OR upper(title) LIKE 'CHIEF%' THEN 3
  WHEN appointment_type = 'PAS' THEN 4 WHEN appointment_type IN ('PA', 'NA') THEN 5 ELSE 6 END"""


def current_roster(spark: SparkSession, folder: str) -> DataFrame:
    positions = _positions(spark, folder).withColumn("level_grade_pay", F.lit(None).cast("string"))
    return roster.roster(roster.place(positions, _crosswalk(spark, folder)))


@query("A36 P35 P33 K3", f"""WITH {COLLAPSED_SQL} SELECT x.node, cast({RANK_SQL} AS INTEGER) AS rank, title, status, appointment_type, {FULL_NAME_SQL} AS name, individual_id, begin_date
FROM pos p JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name WHERE status <> 'Historical'""")
def rosters(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of each node from the head down, as a distributed sort."""
    return current_roster(spark, folder).select(
        "node", "rank", "title", "status", "appointment_type", "name", "individual_id", "begin_date")


@query("A37 J13 P33", f"""WITH {COLLAPSED_SQL}, named AS (SELECT agency_name, org_name, title, status, appointment_type, nullif(first_name, '') AS first_name, nullif(last_name, '') AS last_name, individual_id, begin_date FROM pos)
SELECT {FULL_NAME_SQL} AS name, individual_id, title, p.agency_name, p.org_name, x.node FROM named p LEFT JOIN xw x ON x.agency_name = p.agency_name AND x.org_name = p.org_name
WHERE status = 'Filled' AND (first_name IS NOT NULL OR last_name IS NOT NULL)""")
def people_directory(spark: SparkSession, folder: str) -> DataFrame:
    return roster.directory(_positions(spark, folder), _crosswalk(spark, folder)).select(
        "name", "individual_id", "title", "agency_name", "org_name", "node")


@query("A38", f"""WITH {COLLAPSED_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY begin_date NULLS FIRST, title, agency_name, org_name, status) AS seq,
  count(*) OVER (PARTITION BY individual_id) AS held FROM pos WHERE individual_id IS NOT NULL)
SELECT individual_id, {FULL_NAME_SQL} AS name, seq, title, status, begin_date FROM n WHERE held > 1""")
def career_timelines(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of people with more than one, numbered in order without sorting a whole person in one task."""
    positions = _positions(spark, folder).withColumn("vacate_date", F.lit(None).cast("date")).withColumn("level_grade_pay", F.lit(None).cast("string"))
    return roster.timelines(positions).select("individual_id", "name", "seq", "title", "status", "begin_date")


@query("A38", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def numbered_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbering over raw events, cut into ranges: a user with a third of all events is many small sorts."""
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return roster.numbered(rows, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "seq")


_LABELS = "CASE appointment_type WHEN 'PAS' THEN 'Presidential appointment with Senate confirmation' WHEN 'PA' THEN 'Presidential appointment' WHEN 'SC' THEN 'Schedule C' WHEN 'NA' THEN 'Noncareer SES' WHEN 'CA' THEN 'Career' ELSE appointment_type END"


@query("P22", f"""WITH {COLLAPSED_SQL} SELECT DISTINCT appointment_type, {_LABELS} AS appointment_label,
  CASE WHEN appointment_type IN ('PAS','PA','SC','NA','TA') THEN 'political' ELSE 'career' END AS appointment_class FROM pos""")
def appointment_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return roster.with_appointment(_positions(spark, folder)).select("appointment_type", "appointment_label", "appointment_class").distinct()


@query("P25", """SELECT s_suppkey, 'McDonald O''Neil-' || 'Maclean van der S' || cast(s_suppkey AS VARCHAR) AS proper FROM supplier""")
def personal_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names in capitals to display case, with prefixes, particles and double names."""
    shouted = F.concat(F.lit("MCDONALD O'NEIL-MACLEAN VAN DER S"), F.col("s_suppkey").cast("string"))
    return table(spark, folder, "supplier").select("s_suppkey", names.person_name(shouted).alias("proper"))
