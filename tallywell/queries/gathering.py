"""Files and records: scans, versions, monthly facts, base measures, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, periods
from tallywell.operators import facts
from tallywell.queries import standin
from tallywell.queries.registry import query, rounded, table
from tallywell.schema import as_values
from tallywell.session import materialise, scratch_path
from tallywell.sources import manifest, records, sinks, tables
from tallywell.streaming import ingest

MONTH = standin.month_sql


# --- files -------------------------------------------------------------------------------------------------------

_FILES = {
    "dataset": "CASE l_returnflag WHEN 'A' THEN 'accessions' WHEN 'N' THEN 'employment' ELSE 'separations' END",
    "yyyymm": "cast(year(l_shipdate) * 100 + month(l_shipdate) as string)",
    "version": "l_linenumber",
    "format": "CASE WHEN l_linestatus = 'O' THEN 'parquet' ELSE 'txt' END",
    "current": "l_quantity < 49",
}
_FILES_SQL = standin.cte("files", _FILES, "lineitem")


@query("S11 P11", f"""
WITH {_FILES_SQL}, names AS (SELECT DISTINCT dataset || '_' || yyyymm || '_' || cast(version AS VARCHAR) AS name FROM files)
SELECT name, regexp_extract(name, '^(employment|accessions|separations)_(\\d{{6}})_(\\d+)$', 1) AS dataset,
       regexp_extract(name, '(\\d{{6}})', 1) AS yyyymm, cast(regexp_extract(name, '_(\\d+)$', 1) AS INTEGER) AS version,
       cast(regexp_extract(name, '(\\d{{4}})\\d{{2}}_', 1) || '-' || regexp_extract(name, '\\d{{4}}(\\d{{2}})_', 1) || '-01' AS DATE) AS month
FROM names""")
def file_name_parts(spark: SparkSession, folder: str) -> DataFrame:
    files = standin.select(table(spark, folder, "lineitem"), _FILES)
    names = files.select(F.concat_ws("_", "dataset", "yyyymm", "version").alias("name")).distinct()
    return names.withColumn("p", records.file_parts("name")).select(
        "name", "p.dataset", "p.yyyymm", "p.version", periods.month_start("p.yyyymm").alias("month"))


@query("S12", f"""
WITH {_FILES_SQL}, live AS (SELECT DISTINCT * FROM files WHERE "current"),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset, yyyymm ORDER BY version DESC, (format = 'parquet') DESC) AS rn FROM live)
SELECT dataset, yyyymm, version, format FROM ranked WHERE rn = 1""")
def current_files(spark: SparkSession, folder: str) -> DataFrame:
    files = standin.select(table(spark, folder, "lineitem"), _FILES).distinct()
    return records.current_files(files).select("dataset", "yyyymm", "version", "format")


@query("S12", f"""
WITH {_FILES_SQL}, best AS (SELECT dataset, yyyymm, max(version) AS version FROM files GROUP BY ALL)
SELECT f.dataset, f.yyyymm, f.version, count(*) AS records
FROM files f JOIN best b ON b.dataset = f.dataset AND b.yyyymm = f.yyyymm AND b.version = f.version GROUP BY ALL""")
def current_version_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = standin.select(table(spark, folder, "lineitem"), _FILES).withColumnRenamed("yyyymm", "file_yyyymm")
    return records.current_records(rows).groupBy("dataset", F.col("file_yyyymm").alias("yyyymm"), "version").agg(
        F.count(F.lit(1)).alias("records"))


_PUBLISHED = {
    "dataset": "CASE o_orderstatus WHEN 'O' THEN 'accessions' WHEN 'P' THEN 'employment' ELSE 'separations' END",
    "yyyymm": "cast(year(o_orderdate) * 100 + month(o_orderdate) as string)",
    "version": "cast(substr(o_orderpriority, 1, 1) as int)",
}


@query("S13", f"""
WITH {_FILES_SQL}, {standin.cte("published", _PUBLISHED, "orders")},
best AS (SELECT dataset, yyyymm, max(version) AS version FROM files GROUP BY ALL),
have AS (SELECT dataset, yyyymm, max(version) AS have FROM published GROUP BY ALL)
SELECT b.dataset, b.yyyymm, b.version FROM best b LEFT JOIN have h ON h.dataset = b.dataset AND h.yyyymm = b.yyyymm
WHERE h.have IS NULL OR h.have < b.version""")
def files_to_load(spark: SparkSession, folder: str) -> DataFrame:
    files = standin.select(table(spark, folder, "lineitem"), _FILES).drop("current").distinct()
    published = standin.select(table(spark, folder, "orders"), _PUBLISHED)
    return records.missing_files(records.current_files(files), published).select("dataset", "yyyymm", "version")


@query("S1 S11 K1", f"""
WITH {standin.EMPLOYMENT_SQL}
SELECT 'employment' AS dataset, snapshot_yyyymm AS yyyymm, 1 AS version, count(*) AS records,
       cast(sum(cast(count AS INTEGER)) AS BIGINT) AS people, count(*) FILTER (work_schedule_code = '') AS blank_schedules
FROM employment GROUP BY ALL""")
def pipe_text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Record files written as pipe-delimited text, one folder per file name, and read back with their names."""
    rows = standin.employment(spark, folder)
    path = scratch_path(spark, "text")
    named = rows.withColumn("file", F.concat(F.lit("employment_"), "snapshot_yyyymm", F.lit("_1")))
    # One month per shuffle partition keeps the number of files at the number of months.
    sinks.write_pipe_text(named.repartition("file"), path, ("file",))
    back = records.with_file(records.read_pipe_text(spark, f"{path}/*", rows.columns))
    return back.groupBy("dataset", F.col("file_yyyymm").alias("yyyymm"), "version").agg(
        F.count(F.lit(1)).alias("records"), F.sum(clean.multiplicity()).alias("people"),
        F.count(F.when(F.col("work_schedule_code").isNull(), 1)).alias("blank_schedules"))


@query("S12 S2 S1 K1", f"""
WITH {standin.EMPLOYMENT_SQL} SELECT snapshot_yyyymm AS yyyymm, 2 AS version, count(*) AS records, count(*) FILTER (grade = '09') AS grade_nine FROM employment GROUP BY ALL""")
def current_files_only(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of every month, a parquet one superseding a text one; only the newer files are opened."""
    rows = standin.employment(spark, folder).select("snapshot_yyyymm", "agency_code", "grade", "count")
    path = scratch_path(spark, "versions")

    def named(version: int) -> DataFrame:
        return rows.withColumn("file", F.concat(F.lit("employment_"), "snapshot_yyyymm", F.lit(f"_{version}"))).repartition("file")

    sinks.write_pipe_text(named(1).withColumn("grade", F.lit("old")), f"{path}/text", ("file",))
    sinks.write_parquet(named(2), f"{path}/parquet", ("file",))
    back = records.read_current(spark, path, "employment", rows.columns)
    return back.groupBy(F.col("file_yyyymm").alias("yyyymm"), "version").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("grade") == "09", 1)).alias("grade_nine"))


@query("S2 S5", """
SELECT year(o_orderdate) AS year, count(*) AS orders, count(CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END) AS with_priority,
       round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL""")
def union_of_eras(spark: SparkSession, folder: str) -> DataFrame:
    """Two eras of parquet files, the older one lacking a column, read as one table by column name."""
    orders = table(spark, folder, "orders")
    old, new = scratch_path(spark, "era-old"), scratch_path(spark, "era-new")
    sinks.write_parquet(orders.filter(F.year("o_orderdate") < 1998).drop("o_orderpriority"), old)
    sinks.write_parquet(orders.filter(F.year("o_orderdate") >= 1998), new)
    both = records.read_parquet_union(spark, [old, new])
    return rounded(both.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("orders"), F.count("o_orderpriority").alias("with_priority"), F.sum("o_totalprice").alias("total")), total=2)


@query("S3", """
SELECT lang, count(*) AS documents, cast(sum(length(text)) AS BIGINT) AS characters, max(length(text)) AS longest FROM documents GROUP BY ALL""")
def quoted_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with quotes, commas and line breaks through quoted CSV and back."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").cast("string"), "text", "lang")
    path = scratch_path(spark, "quoted")
    documents.write.option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = records.read_quoted_csv(spark, path, documents.columns, multiline=True)
    return back.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"), F.max(F.length("text")).alias("longest"))


@query("S4", """
SELECT c_mktsegment AS segment, count(*) AS customers, count(CASE WHEN c_custkey % 3 <> 0 THEN c_name END) AS named
FROM customer WHERE c_acctbal >= 0 GROUP BY ALL
UNION ALL SELECT NULL, count(*), count(*) FROM customer WHERE c_acctbal < 0 AND c_acctbal >= -300""")
def tolerant_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that lack fields or have too many are skipped; blank fields, the last one too, are no fault."""
    customer = table(spark, folder, "customer")
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("")
    line = (F.when(F.col("c_acctbal") >= 0, F.concat_ws(",", "c_custkey", name, "c_mktsegment"))
            .when(F.col("c_acctbal") >= -300, F.concat_ws(",", "c_custkey", "c_name", F.lit("")))
            .when(F.col("c_acctbal") >= -600, F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment", F.lit("more")))
            .otherwise(F.col("c_custkey").cast("string")))
    path = scratch_path(spark, "broken")
    customer.select(line.alias("line")).write.text(path)
    rows = records.read_tolerant_csv(spark, path, ["key", "name", "segment"], header=False)
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.count("name").alias("named"))


@query("S6 M8", """
SELECT event_type, count(*) AS events, round(sum(value), 2) AS total, cast(sum(cast(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k
FROM events GROUP BY ALL""")
def json_lines_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a JSON text inside, through JSON lines with an inferred schema."""
    path = scratch_path(spark, "lines")
    table(spark, folder, "events").select("event_id", "event_type", "value", "props").write.json(path)
    back = records.read_json_lines(spark, path)
    k = F.get_json_object("props", "$.k").cast("int")
    return rounded(back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"), F.sum(k).alias("k")), total=2)


# --- monthly facts ------------------------------------------------------------------------------------------------


def _fact_sql(dataset: str, source: str) -> str:
    """From the rule: clean each record once, then add up people, and pay and service of people, per combination."""
    names = {**fixed.DATASET_DIMS[dataset], **fixed.COMMON_DIMS}
    when = ["personnel_action_effective_date_yyyymm AS file_yyyymm"] if dataset != "employment" else []
    keys = ["file_yyyymm"] * (dataset != "employment") + list(names.values()) + ["pay_band"]
    cleaned = {
        "duty_station_code": "coalesce(nullif(duty_station_code, 'REDACTED'), 'NDS')",
        "agency_subelement_code": "coalesce(nullif(agency_subelement_code, ''), coalesce(nullif(agency_code, ''), 'UN') || '__')",
    }
    dims = when + [f"{cleaned.get(raw, raw)} AS {name}" for raw, name in names.items()]
    pay = "annualized_adjusted_basic_pay"
    return f"""SELECT {', '.join(keys)}, cast(sum(heads) AS BIGINT) AS n, round(sum(pay * heads), 2) AS pay_sum,
      cast(sum(heads * stated::INTEGER) AS BIGINT) AS pay_n, round(sum(served * heads), 2) AS los_sum
      FROM (SELECT {', '.join(dims)}, {pay} NOT IN ('REDACTED', '') AS stated, count::INTEGER AS heads, try_cast({pay} AS DOUBLE) AS pay,
        try_cast(length_of_service_years AS DOUBLE) AS served, if({pay} = 'REDACTED', 'R', (10 * floor(try_cast({pay} AS DOUBLE) / 10000)::INTEGER)::VARCHAR) AS pay_band
        FROM {source}) GROUP BY ALL"""


def employment_facts(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> DataFrame:
    return facts.fact_rollup(standin.employment(spark, folder), "employment", only=only)


EMPLOYMENT_FACTS_SQL = f"{standin.EMPLOYMENT_SQL}, facts AS ({_fact_sql('employment', 'employment')})"


@query("A1 P1 P2 P3 P5 P6 T1", f"WITH {EMPLOYMENT_FACTS_SQL} SELECT * FROM facts")
def monthly_facts(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(employment_facts(spark, folder), pay_sum=2, los_sum=2)


@query("A1 S11", f"WITH {standin.SEPARATIONS_SQL} {_fact_sql('separations', 'separations')}")
def separation_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts.fact_rollup(standin.separations(spark, folder), "separations", "personnel_action_effective_date_yyyymm")
    return rounded(rows, pay_sum=2, los_sum=2)


@query("A1", f"WITH {standin.ACCESSIONS_SQL} {_fact_sql('accessions', 'accessions')}")
def accession_facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts.fact_rollup(standin.accessions(spark, folder), "accessions", "personnel_action_effective_date_yyyymm")
    return rounded(rows, pay_sum=2, los_sum=2)


# --- base measures ------------------------------------------------------------------------------------------------

_A, _L, _P = standin.AGE_SQL, standin.SERVICE_SQL, standin.PAY_SQL
_N = "cast(count AS INTEGER)"


def _when(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN {_N} ELSE 0 END)"


EMPLOYMENT_SUMS = {
    "headcount": f"sum({_N})",
    "supervisors": _when("supervisory_status_code IN ('2','4','5')"),
    "permanent_employees": _when("appointment_type_code IN ('10','15','30','32','35','36','38','50','55','67')"),
    "temporary_employees": _when("appointment_type_code IN ('20','40','42','44','45','46','48','60','65','68')"),
    "fulltime_employees": _when("work_schedule_code IN ('F','G')"),
    "gs_employees": _when("pay_plan_code = 'GS'"),
    "gs13_plus_employees": _when("pay_plan_code = 'GS' AND grade IN ('13','14','15')"),
    "under_30": _when(f"{_A} < 30"),
    "age_55_plus": _when(f"{_A} >= 55"),
    "retirement_eligible": _when(f"({_A} >= 62 AND {_L} >= 5) OR ({_A} >= 60 AND {_L} >= 20) OR ({_A} >= 55 AND {_L} >= 30)"),
    "bachelors_plus": _when("education_level_code BETWEEN '13' AND '22'"),
    "service_years_total": f"sum({_L} * {_N})",
    "pay_total": f"sum({_P} * {_N})",
    "pay_disclosed_employees": _when(f"{_P} IS NOT NULL"),
    "location_disclosed_employees": _when("duty_station_code NOT IN ('REDACTED', '')"),
    "veterans": _when("veteran_indicator = 'Y'"),
    "stem_employees": _when("stem_occupation = 'STEM OCCUPATIONS'"),
    "bargaining_unit_employees": _when("bargaining_unit_status = 'ELIGIBLE_IN_BU'"),
    "bargaining_disclosed_employees": _when("bargaining_unit_status NOT IN ('REDACTED', '')"),
}
ACCESSION_SUMS = {
    "accessions": f"sum({_N})",
    "new_hires": _when("accession_category_code IN ('AC','AD','AE')"),
    "transfers_in": _when("accession_category_code IN ('AA','AB')"),
}
SEPARATION_SUMS = {
    "separations": f"sum({_N})",
    "quits": _when("separation_category_code = 'SC'"),
    "retirements": _when("separation_category_code IN ('SD','SE','SG')"),
    "rifs": _when("separation_category_code = 'SH'"),
    "transfers_out": _when("separation_category_code IN ('SA','SB')"),
    "terminations": _when("separation_category_code IN ('SJ','SL')"),
    "deferred_resignations": _when("drp_indicator = 'Y'"),
    "first_year_separations": _when(f"{_L} < 1"),
}
DIMENSION_EXPRS = {
    "grade": "grade", "age_bracket": "age_bracket", "supervisory": "supervisory_status_code",
    "appointment_type": "appointment_type_code", "pay_band": standin.BAND_SQL, "work_schedule": "work_schedule_code",
    "series": "occupational_series_code", "step": "step_or_rate_type_code",
}
_EFFECTIVE = "personnel_action_effective_date_yyyymm"


def _flat_sql(source: str, sums: dict[str, str], month: str, where: str, ref: str) -> str:
    wide = f"SELECT {standin.UNIT_SQL} AS node, {MONTH(month)} AS period_start, " + ", ".join(f"{e} AS {m}" for m, e in sums.items())
    wide += f" FROM {source} {where} GROUP BY 1, 2"
    return " UNION ALL ".join(
        f"SELECT '{m}' AS measure, node, 'month' AS period_type, period_start, cast(NULL AS VARCHAR) AS dim, cast(NULL AS VARCHAR) AS dim_value, "
        f"cast({m} AS DOUBLE) AS value, '{ref}' AS source_ref FROM ({wide}) WHERE {m} IS NOT NULL" for m in sums)


def _dims_sql(source: str, measure: str, dims: dict[str, str], month: str, where: str, ref: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{measure}' AS measure, agency_code AS node, 'month' AS period_type, {MONTH(month)} AS period_start, '{d}' AS dim, "
        f"CASE WHEN coalesce({e}, '') = '' THEN '_blank' ELSE {e} END AS dim_value, cast(sum({_N}) AS DOUBLE) AS value, '{ref}' AS source_ref "
        f"FROM {source} {where} GROUP BY ALL" for d, e in dims.items())


_VALID = f"WHERE length({_EFFECTIVE}) = 6"
EXTRACTS_SQL = f"""{standin.EMPLOYMENT_SQL}, {standin.ACCESSIONS_SQL}, {standin.SEPARATIONS_SQL},
employment_flat AS ({_flat_sql('employment', EMPLOYMENT_SUMS, 'snapshot_yyyymm', '', 'fwd:employment_1')}),
employment_dims AS ({_dims_sql('employment', 'headcount', DIMENSION_EXPRS, 'snapshot_yyyymm', '', 'fwd:employment_1')}),
accession_flat AS ({_flat_sql('accessions', ACCESSION_SUMS, _EFFECTIVE, _VALID, 'fwd:accessions_1')}),
accession_dims AS ({_dims_sql('accessions', 'accessions', {'accession_category': 'accession_category_code'}, _EFFECTIVE, _VALID, 'fwd:accessions_1')}),
separation_flat AS ({_flat_sql('separations', SEPARATION_SUMS, _EFFECTIVE, _VALID, 'fwd:separations_1')}),
separation_dims AS ({_dims_sql('separations', 'separations', {'separation_category': 'separation_category_code'}, _EFFECTIVE, _VALID, 'fwd:separations_1')}),
raw_facts AS (SELECT * FROM employment_flat UNION ALL SELECT * FROM employment_dims UNION ALL SELECT * FROM accession_flat
  UNION ALL SELECT * FROM accession_dims UNION ALL SELECT * FROM separation_flat UNION ALL SELECT * FROM separation_dims)"""


def extracts(spark: SparkSession, folder: str) -> DataFrame:
    """Base rows of all three record kinds."""
    return (
        facts.extract_employment(standin.employment(spark, folder), F.lit("fwd:employment_1"))
        .unionByName(facts.extract_actions(standin.accessions(spark, folder), "accessions", F.lit("fwd:accessions_1")))
        .unionByName(facts.extract_actions(standin.separations(spark, folder), "separations", F.lit("fwd:separations_1")))
    )


def stored_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """The same, written once: roll-ups read base rows several times and records never twice for it."""
    return materialise(extracts(spark, folder), "extracts")


def _value_rows(df: DataFrame) -> DataFrame:
    return rounded(df.select("measure", "node", "period_start", "dim", "dim_value", "value"), value=2)


_VALUE_ROWS = "measure, node, period_start, dim, dim_value, round(value, 2) AS value"


@query("A2 M3 P2 P4 P5 P6 P11 Q2 Q3", f"WITH {EXTRACTS_SQL} SELECT {_VALUE_ROWS} FROM employment_flat")
def employment_measures(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts.extract_employment(standin.employment(spark, folder), F.lit("fwd:employment_1"))
    return _value_rows(rows.filter(F.col("dim").isNull()))


@query("A3 P3 P7", f"WITH {EXTRACTS_SQL} SELECT {_VALUE_ROWS} FROM employment_dims")
def headcount_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts.extract_employment(standin.employment(spark, folder), F.lit("fwd:employment_1"))
    return _value_rows(rows.filter(F.col("dim").isNotNull()))


@query("A2 A3 P9", f"WITH {EXTRACTS_SQL} SELECT {_VALUE_ROWS} FROM accession_flat UNION ALL SELECT {_VALUE_ROWS} FROM accession_dims")
def accession_measures(spark: SparkSession, folder: str) -> DataFrame:
    return _value_rows(facts.extract_actions(standin.accessions(spark, folder), "accessions", F.lit("fwd:accessions_1")))


@query("A2 A3 P9", f"WITH {EXTRACTS_SQL} SELECT {_VALUE_ROWS} FROM separation_flat UNION ALL SELECT {_VALUE_ROWS} FROM separation_dims")
def separation_measures(spark: SparkSession, folder: str) -> DataFrame:
    return _value_rows(facts.extract_actions(standin.separations(spark, folder), "separations", F.lit("fwd:separations_1")))


def _publish(rows: DataFrame, path: str, copies: int = 1) -> None:
    """A record file with every row so many times. Text takes many times the room of the tables it is made from, so it is compressed."""
    many = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_copy") if copies > 1 else rows
    sinks.write_pipe_text(many, path, compression="gzip")


@query("S13 S12 A7 S1 A2 A3", f"""WITH {EXTRACTS_SQL} SELECT {_VALUE_ROWS} FROM raw_facts""")
def resumable_load(spark: SparkSession, folder: str) -> DataFrame:
    """Files of all three record kinds, two versions of each, through the default loader; a second run adds nothing.

    Version 1 has every record twice, so a version that is not replaced shows. Separations come newest first.
    """
    inbox, target = scratch_path(spark, "inbox"), scratch_path(spark, "extracts")
    kinds = {"employment": standin.employment, "accessions": standin.accessions, "separations": standin.separations}
    for order in ({"employment": 1, "accessions": 1, "separations": 2}, {"employment": 2, "accessions": 2, "separations": 1}):
        for kind, rows in kinds.items():
            now, version = rows(spark, folder), order[kind]
            _publish(now, f"{inbox}/{kind}_202401_{version}", copies=2 if version == 1 else 1)
        ingest.load_new_files(spark, inbox, target)
    ingest.load_new_files(spark, inbox, target)
    return _value_rows(spark.read.parquet(target))


@query("S13 K5 S12", f"""WITH {EXTRACTS_SQL},
given AS (SELECT 'employment' AS dataset, count(*) AS rows_in, sum(cast(count AS INTEGER)) AS people FROM employment
  UNION ALL SELECT 'accessions', count(*), sum(cast(count AS INTEGER)) FILTER ({_EFFECTIVE} <> '') FROM accessions
  UNION ALL SELECT 'separations', count(*), sum(cast(count AS INTEGER)) FILTER ({_EFFECTIVE} <> '') FROM separations),
stored AS (SELECT regexp_extract(source_ref, '^fwd:([a-z]+)_', 1) AS dataset, count(*) AS rows_out FROM raw_facts GROUP BY 1)
SELECT dataset, '202401' AS yyyymm, 2 AS version, rows_in, rows_out, cast(people AS BIGINT) AS people FROM given JOIN stored USING (dataset)
UNION ALL SELECT 'accessions', '202402', 2, 0, 0, 0""")
def load_log(spark: SparkSession, folder: str) -> DataFrame:
    """What the log holds after every kind was loaded in two versions, one month's newer version being empty."""
    inbox, target = scratch_path(spark, "inbox"), scratch_path(spark, "extracts")
    kinds = {"employment": standin.employment, "accessions": standin.accessions, "separations": standin.separations}
    for version in (1, 2):
        for kind, rows in kinds.items():
            now = rows(spark, folder)
            _publish(now, f"{inbox}/{kind}_202401_{version}", copies=2 if version == 1 else 1)
        actions = standin.accessions(spark, folder)
        _publish(actions if version == 1 else actions.filter("false").coalesce(1), f"{inbox}/accessions_202402_{version}")
        ingest.load_new_files(spark, inbox, target)
    return manifest.committed(spark, target).select("dataset", "yyyymm", "version", "rows_in", "rows_out", "people")


@query("S1 S5 Q1 Q2 Q3", f"""WITH {standin.EMPLOYMENT_SQL}, dated AS (SELECT *, CASE WHEN snapshot_yyyymm < '199701' THEN 1 WHEN snapshot_yyyymm < '199901' THEN 2 ELSE 3 END AS era FROM employment),
flat AS (SELECT {standin.UNIT_SQL} AS node, {MONTH('snapshot_yyyymm')} AS period_start, era, sum({_N}) AS headcount, {_when("veteran_indicator = 'Y'")} AS veterans,
  {_when("stem_occupation = 'STEM OCCUPATIONS'")} AS stem_employees FROM dated GROUP BY 1, 2, 3)
SELECT 'headcount' AS measure, node, period_start, cast(headcount AS DOUBLE) AS value FROM flat
UNION ALL SELECT 'veterans', node, period_start, veterans FROM flat WHERE era > 1
UNION ALL SELECT 'stem_employees', node, period_start, stem_employees FROM flat WHERE era > 2""")
def measures_of_eras(spark: SparkSession, folder: str) -> DataFrame:
    """Text files of three eras, with columns in another order, fewer and more of them. What an era lacks gives no rows."""
    path = scratch_path(spark, "eras")
    rows = standin.employment(spark, folder)
    core = [c for c in rows.columns if c not in ("veteran_indicator", "stem_occupation")]
    eras = [list(reversed(core)), ["veteran_indicator", *core], [*core, "stem_occupation", "veteran_indicator"]]
    bounds = ("000000", "199701", "199901", "999999")
    for columns, low, high in zip(eras, bounds, bounds[1:]):
        now = rows.filter((F.col("snapshot_yyyymm") >= low) & (F.col("snapshot_yyyymm") < high))
        named = now.withColumn("file", F.concat(F.lit("employment_"), "snapshot_yyyymm", F.lit("_1"))).select(*columns, "file")
        sinks.write_pipe_text(named.repartition("file"), f"{path}/{low}", ("file",))
    frames = records.read_current_eras(spark, path, "employment", rows.columns)
    values = records.union_by_name([facts.extract_employment(era, F.col("source_ref")) for era in frames])
    wanted = values.filter(F.col("dim").isNull() & F.col("measure").isin("headcount", "veterans", "stem_employees"))
    return wanted.groupBy("measure", "node", "period_start").agg(F.sum("value").alias("value"))


# --- duplicates, modes, lookups -------------------------------------------------------------------------------------

_VERSIONED = """versioned AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'quits' ELSE 'headcount' END AS measure, cast(l_suppkey AS VARCHAR) AS node,
         cast(date_trunc('month', l_shipdate) AS DATE) AS period_start, l_linenumber + 6 AS version,
         CASE WHEN min(l_tax) = 0.0 THEN NULL ELSE sum(l_quantity) END AS value FROM lineitem GROUP BY 1, 2, 3, 4)"""


@query("A7 J9", f"""
WITH {_VERSIONED}
SELECT measure, node, period_start,
       CASE WHEN measure = 'quits' THEN sum(value) ELSE arg_max(value, version) END AS value,
       'fwd:employment_202401_' || cast(max(version) AS VARCHAR) AS source_ref
FROM versioned GROUP BY measure, node, period_start""")
def resolve_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Flows add up over files; stocks take the newest file's value, version 10 after version 9."""
    rows = table(spark, folder, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "O", "quits").otherwise("headcount").alias("measure"),
        F.col("l_suppkey").cast("string").alias("node"), F.trunc("l_shipdate", "month").alias("period_start"),
        F.concat(F.lit("fwd:employment_202401_"), (F.col("l_linenumber") + 6).cast("string")).alias("source_ref"),
    ).agg(F.when(F.min("l_tax") == 0.0, None).otherwise(F.sum("l_quantity")).alias("value"))
    return facts.resolve_duplicates(as_values(rows, period_type="month"), ["quits"]).select(
        "measure", "node", "period_start", "value", "source_ref")


@query("A4", f"""
WITH {standin.EMPLOYMENT_SQL}, u AS (SELECT {standin.UNIT_SQL} AS code, * FROM employment),
c1 AS (SELECT code, agency_subelement AS v, count(*) AS k FROM u GROUP BY ALL),
c2 AS (SELECT code, department_code AS v, count(*) AS k FROM u GROUP BY ALL),
c3 AS (SELECT code, grade AS v, count(*) AS k FROM u GROUP BY ALL),
r1 AS (SELECT code, v FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k DESC, v) AS rn FROM c1 WHERE v IS NOT NULL) WHERE rn = 1),
r2 AS (SELECT code, v FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k DESC, v) AS rn FROM c2 WHERE v IS NOT NULL) WHERE rn = 1),
r3 AS (SELECT code, v FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k DESC, v) AS rn FROM c3 WHERE v IS NOT NULL) WHERE rn = 1)
SELECT r1.code, r1.v AS agency_subelement, r2.v AS department_code, r3.v AS grade FROM r1 JOIN r2 USING (code) JOIN r3 USING (code)""")
def most_frequent_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = standin.employment(spark, folder).withColumn("code", clean.unit_code())
    return facts.most_frequent(rows, ["code"], ["agency_subelement", "department_code", "grade"])


@query("A5 P7", f"""
WITH {standin.EMPLOYMENT_SQL} SELECT DISTINCT CASE WHEN work_schedule_code = '' THEN '_blank' ELSE work_schedule_code END AS code
FROM employment WHERE work_schedule_code IS NOT NULL""")
def distinct_codes(spark: SparkSession, folder: str) -> DataFrame:
    return facts.distinct_codes(standin.employment(spark, folder), "work_schedule_code")


@query("A6 P2", f"""
WITH {standin.EMPLOYMENT_SQL}, m AS (SELECT {standin.UNIT_SQL} AS code, snapshot_yyyymm AS yyyymm, cast(sum({_N}) AS BIGINT) AS headcount FROM employment GROUP BY ALL)
SELECT code, string_agg(yyyymm || ':' || cast(headcount AS VARCHAR), ',' ORDER BY yyyymm) AS headcount FROM m GROUP BY code""")
def headcount_maps(spark: SparkSession, folder: str) -> DataFrame:
    by_month = facts.headcount_by_month(standin.employment(spark, folder), clean.unit_code(), F.col("snapshot_yyyymm"))
    entries = F.map_entries("headcount")
    return facts.headcount_map(by_month).select("code", F.array_join(
        F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("headcount"))


_OBSERVED = f"""obs AS (
  SELECT code, yyyymm, v AS name, dep FROM (
    SELECT *, row_number() OVER (PARTITION BY code, yyyymm ORDER BY k DESC, v) AS rn FROM (
      SELECT {standin.UNIT_SQL} AS code, snapshot_yyyymm AS yyyymm, agency_subelement AS v, max(department_code) AS dep, count(*) AS k
      FROM employment GROUP BY 1, 2, 3)) WHERE rn = 1)"""


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    rows = standin.employment(spark, folder).select(
        clean.unit_code().alias("code"), F.col("snapshot_yyyymm").alias("yyyymm"),
        F.col("agency_subelement").alias("name"), "department_code")
    return facts.most_frequent(rows, ["code", "yyyymm"], ["name", "department_code"])


@query("A25 A4", f"""
WITH {standin.EMPLOYMENT_SQL}, {_OBSERVED}
SELECT code, min(yyyymm) AS first_seen, max(yyyymm) AS last_seen, arg_max(dep, yyyymm) AS department_code, arg_max(name, yyyymm) AS name
FROM obs GROUP BY code""")
def merged_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return facts.merge_lookup(_observations(spark, folder), ["department_code"])


@query("A26", f"""
WITH {standin.EMPLOYMENT_SQL}, {_OBSERVED},
seen AS (SELECT code, yyyymm, name, lag(name) OVER (PARTITION BY code ORDER BY yyyymm) AS before FROM obs)
SELECT code, yyyymm, name FROM seen WHERE before IS NULL OR before <> name""")
def name_history(spark: SparkSession, folder: str) -> DataFrame:
    return facts.name_history(_observations(spark, folder))


@query("A45", f"""
WITH {standin.EMPLOYMENT_SQL}, {_OBSERVED} SELECT code, arg_max(name, yyyymm) AS name, max(yyyymm) AS from_month FROM obs
WHERE name NOT IN ('', 'NO DATA REPORTED') GROUP BY code""")
def newest_names(spark: SparkSession, folder: str) -> DataFrame:
    return facts.newest_names(_observations(spark, folder))


@query("A24 K5", f"""
WITH {EXTRACTS_SQL} SELECT count(*) AS "rows", count(DISTINCT node) AS nodes, count(DISTINCT measure) AS measures,
min(period_start) AS first_period, max(period_start) AS last_period FROM raw_facts""")
def table_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return facts.table_stats(stored_extracts(spark, folder))


@query("A27", f"""
WITH {EXTRACTS_SQL} SELECT node, min(period_start) AS first_seen, max(period_start) AS last_seen FROM raw_facts
WHERE measure = 'headcount' AND dim IS NULL AND (length(node) = 4 OR (length(node) = 2 AND node = upper(node))) GROUP BY node""")
def observed_spans(spark: SparkSession, folder: str) -> DataFrame:
    return facts.observed_span(stored_extracts(spark, folder))


# --- small sources ----------------------------------------------------------------------------------------------------


@query("S7a M3 U2", """
WITH t AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'ALL' WHEN c_nationkey = 0 THEN 'XX' ELSE 'N' || cast(c_nationkey AS VARCHAR) END AS agency,
  year(o_orderdate) AS year, count(*) AS n_resp, max(o_totalprice) AS eei, CASE WHEN count(*) >= 100 THEN cast(max(o_custkey) AS DOUBLE) END AS gsi
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
l AS (SELECT 'fevs_engagement' AS measure, agency, year, n_resp, eei AS value FROM t UNION ALL SELECT 'fevs_global_satisfaction', agency, year, n_resp, gsi FROM t)
SELECT measure, CASE WHEN agency = 'ALL' THEN 'gov' ELSE agency END AS node, 'survey_year' AS period_type,
  make_date(year, 1, 1) AS period_start, value, cast(n_resp AS BIGINT) AS n, 'fevs:' || cast(year AS VARCHAR) || '-prdf' AS source_ref
FROM l WHERE agency <> 'XX' AND value IS NOT NULL""")
def wide_survey_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    agency = F.when(F.col("o_orderstatus") == "O", "ALL").when(F.col("c_nationkey") == 0, "XX").otherwise(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    wide = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        agency.alias("agency"), F.year("o_orderdate").alias("year")
    ).agg(F.count(F.lit(1)).alias("n_resp"), F.max("o_totalprice").alias("eei"),
          F.when(F.count(F.lit(1)) >= 100, F.max("o_custkey").cast("double")).alias("gsi"))
    return tables.wide_survey(wide).select("measure", "node", "period_type", "period_start", "value", "n", "source_ref")


def _long_sql(period_type: str, notation: str) -> str:
    return f"""
WITH t AS (SELECT 'N' || cast(c_nationkey AS VARCHAR) AS node, make_date(year(o_orderdate), 1, 1) AS period_start,
  count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT 'm' AS measure, node, '{period_type}' AS period_type, period_start, value, CASE WHEN n >= 20 THEN n END AS n, {notation} AS notation FROM t"""


def _long_input(spark: SparkSession, folder: str) -> DataFrame:
    """Long rows as a text file would give them: every column a string, a missing count blank."""
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    grouped = joined.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("node"), F.trunc("o_orderdate", "year").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))
    return grouped.select(
        F.lit("m").alias("measure"), "node", F.date_format("day", "yyyy-MM-dd").alias("period_start"),
        F.col("value").cast("string").alias("value"),
        F.when(F.col("n") >= 20, F.col("n").cast("string")).otherwise("").alias("n"), F.lit("file").alias("source_ref"))


_LONG = ["measure", "node", "period_type", "period_start", "value", "n", "notation"]


@query("S7b P42", _long_sql("survey_year", "'estimate'"))
def estimated_survey_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tables.long_table(_long_input(spark, folder), "survey_year", notation="estimate").select(*_LONG)


@query("S7c S7d", _long_sql("fiscal_year", "cast(NULL AS VARCHAR)"))
def long_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tables.long_table(_long_input(spark, folder), "fiscal_year").select(*_LONG)


_HTML_SQL = r"""
rows_found AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul(?:\s[^>]*)?>(.*?)</ul>', 1)) AS body,
  generate_subscripts(regexp_extract_all(html, '(?s)<ul(?:\s[^>]*)?>(.*?)</ul>', 1), 1) - 1 AS "row" FROM pages),
cells AS (SELECT page_id, "row", [trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
   regexp_replace(c, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
   '[\s ]+', ' ', 'g')) FOR c IN regexp_extract_all(body, '(?s)<(?:li)(?:\s[^>]*)?>(.*?)</(?:li)>', 1)] AS cells FROM rows_found)"""


@query("S10", f"""WITH {_HTML_SQL}
SELECT page_id, cast("row" AS INTEGER) AS "row", len(cells) AS n_cells, array_to_string(cells, '|') AS cells FROM cells
WHERE len(cells) >= 2 AND cells[1] <> ''""")
def html_table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and cells of repeated page markup; the pages hold lists where the source holds tables."""
    rows = tables.html_rows(table(spark, folder, "pages").select("page_id", "html"), "html", "ul", ("li",), least=2)
    return rows.select("page_id", "row", F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", "|").alias("cells"))
