"""From records to monthly facts, base measures and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, periods
from tallywell.schema import KEY_COLUMNS, VALUE_COLUMNS, as_values, notation_name, notation_rank
from tallywell.session import materialise


class EraError(ValueError):
    """A file lacks columns that every era must have."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise EraError(f"missing core columns {missing}")
    return df


# --- monthly fact grain -------------------------------------------------------------------------------------


def fact_rollup(records: DataFrame, dataset: str, file_month: Column | str | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """One row per combination of dimensions with people, disclosed pay and years of service.

    Sums combine on the map side, so a crowded combination costs one row per task in the shuffle. `only` names the
    dimensions to keep: all of them together tell nearly all records apart, while a few give few rows with the same sums.
    """
    dims: list[Column] = []
    if dataset != "employment":
        month = F.col(file_month) if isinstance(file_month, str) else file_month
        dims.append((month if month is not None else F.lit(None).cast("string")).alias("file_yyyymm"))
    special = {
        "duty_station_code": clean.redacted_to_undisclosed("duty_station_code"),
        "agency_subelement_code": clean.unit_code(missing_agency=fixed.UNKNOWN_AGENCY),
    }
    for source, name in {**fixed.DATASET_DIMS[dataset], **fixed.COMMON_DIMS}.items():
        dims.append(special.get(source, F.col(source)).alias(name))
    dims.append(clean.pay_band(undisclosed_only=True).alias("pay_band"))
    if only is not None:
        kept = records.select(*dims).columns
        if set(only) - set(kept):
            raise KeyError(f"no dimensions {sorted(set(only) - set(kept))}")
        dims = [c for c, name in zip(dims, kept) if name in only]
    people = F.col("_people")
    stated = ~F.col("annualized_adjusted_basic_pay").isin(fixed.REDACTED, "")
    return parsed(records).groupBy(*dims).agg(
        F.sum(people).alias("n"),
        F.sum(F.col("_pay") * people).alias("pay_sum"),
        F.sum(F.when(stated, people).otherwise(0)).alias("pay_n"),
        F.sum(F.col("_years") * people).alias("los_sum"),
    )


# --- base measures --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BaseMeasure:
    """A conditional sum over records; emitted only where its columns exist."""

    code: str
    amount: Column
    needs: tuple[str, ...] = field(default=())


# Fields every measure reads, parsed once per record: name, expression, raw column.
_PARSED = (
    ("_people", clean.multiplicity, "count"),
    ("_age", clean.age_floor, "age_bracket"),
    ("_years", clean.service_years, "length_of_service_years"),
    ("_pay", clean.disclosed_pay, "annualized_adjusted_basic_pay"),
)


def parsed(records: DataFrame) -> DataFrame:
    return records.withColumns({name: parse(raw) for name, parse, raw in _PARSED if raw in records.columns})


def _people_if(condition: Column) -> Column:
    return F.when(condition, F.col("_people")).otherwise(0)


def employment_measures() -> list[BaseMeasure]:
    people, age, years, pay = (F.col(name) for name, _, _ in _PARSED)
    col = F.col
    eligible = F.lit(False)
    for floor, service in fixed.RETIREMENT_RULES:
        eligible = eligible | ((age >= floor) & (years >= service))
    unit = col("bargaining_unit_status")
    return [
        BaseMeasure("headcount", people),
        BaseMeasure("supervisors", _people_if(col("supervisory_status_code").isin(*fixed.SUPERVISOR_CODES))),
        BaseMeasure("permanent_employees", _people_if(col("appointment_type_code").isin(*fixed.PERMANENT_CODES))),
        BaseMeasure("temporary_employees", _people_if(col("appointment_type_code").isin(*fixed.TEMPORARY_CODES))),
        BaseMeasure("fulltime_employees", _people_if(col("work_schedule_code").isin(*fixed.FULLTIME_CODES))),
        BaseMeasure("gs_employees", _people_if(col("pay_plan_code") == "GS")),
        BaseMeasure("gs13_plus_employees", _people_if((col("pay_plan_code") == "GS") & col("grade").isin(*fixed.SENIOR_GRADES))),
        BaseMeasure("under_30", _people_if(age < 30)),
        BaseMeasure("age_55_plus", _people_if(age >= 55)),
        BaseMeasure("retirement_eligible", _people_if(eligible)),
        BaseMeasure("bachelors_plus", _people_if(col("education_level_code").between(*fixed.DEGREE_CODES))),
        BaseMeasure("service_years_total", years * people),
        BaseMeasure("pay_total", pay * people),
        BaseMeasure("pay_disclosed_employees", _people_if(pay.isNotNull())),
        BaseMeasure("location_disclosed_employees", _people_if(~col("duty_station_code").isin(fixed.REDACTED, "")), ("duty_station_code",)),
        BaseMeasure("veterans", _people_if(col("veteran_indicator") == "Y"), ("veteran_indicator",)),
        BaseMeasure("stem_employees", _people_if(col("stem_occupation") == "STEM OCCUPATIONS"), ("stem_occupation",)),
        BaseMeasure("bargaining_unit_employees", _people_if(unit == "ELIGIBLE_IN_BU"), ("bargaining_unit_status",)),
        BaseMeasure("bargaining_disclosed_employees", _people_if(~unit.isin(fixed.REDACTED, "")), ("bargaining_unit_status",)),
    ]


def action_measures(dataset: str) -> list[BaseMeasure]:
    if dataset == "accessions":
        kind, needs = F.col("accession_category_code"), ("accession_category_code",)
        return [
            BaseMeasure("accessions", F.col("_people")),
            BaseMeasure("new_hires", _people_if(kind.isin(*fixed.NEW_HIRE_CODES)), needs),
            BaseMeasure("transfers_in", _people_if(kind.isin(*fixed.TRANSFER_IN_CODES)), needs),
        ]
    kind, needs = F.col("separation_category_code"), ("separation_category_code",)
    return [
        BaseMeasure("separations", F.col("_people")),
        BaseMeasure("quits", _people_if(kind.isin(*fixed.QUIT_CODES)), needs),
        BaseMeasure("retirements", _people_if(kind.isin(*fixed.RETIREMENT_CODES)), needs),
        BaseMeasure("rifs", _people_if(kind.isin(*fixed.RIF_CODES)), needs),
        BaseMeasure("transfers_out", _people_if(kind.isin(*fixed.TRANSFER_OUT_CODES)), needs),
        BaseMeasure("terminations", _people_if(kind.isin(*fixed.TERMINATION_CODES)), needs),
        BaseMeasure("deferred_resignations", _people_if(F.col("drp_indicator") == "Y"), ("drp_indicator",)),
        BaseMeasure("first_year_separations", _people_if(F.col("_years") < 1)),
    ]


def available(measures: Sequence[BaseMeasure], columns: Sequence[str]) -> list[BaseMeasure]:
    return [m for m in measures if set(m.needs) <= set(columns)]


def conditional_sums(records: DataFrame, keys: Mapping[str, Column], measures: Sequence[BaseMeasure]) -> DataFrame:
    """All measures in one pass and one shuffle, wide."""
    measures = available(measures, records.columns)
    return parsed(records).groupBy(*[c.alias(name) for name, c in keys.items()]).agg(
        *[F.sum(m.amount).cast("double").alias(m.code) for m in measures]
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "measure") -> DataFrame:
    """Unpivot; absent values give no row."""
    return df.unpivot(list(ids), list(columns), name, "value").filter(F.col("value").isNotNull())


# dimension code -> (expression over a record, columns it needs)
def headcount_dimensions() -> dict[str, tuple[Column, tuple[str, ...]]]:
    return {
        "grade": (F.col("grade"), ()),
        "age_bracket": (F.col("age_bracket"), ()),
        "supervisory": (F.col("supervisory_status_code"), ()),
        "appointment_type": (F.col("appointment_type_code"), ()),
        "pay_band": (clean.pay_band(), ()),
        "work_schedule": (F.col("work_schedule_code"), ()),
        "series": (F.col("occupational_series_code"), ("occupational_series_code",)),
        "step": (F.col("step_or_rate_type_code"), ("step_or_rate_type_code",)),
    }


def by_dimensions(
    df: DataFrame, keys: Mapping[str, Column], dims: Mapping[str, Column], amount: Column
) -> DataFrame:
    """Sum of `amount` per key and value of every dimension, in one scan and one shuffle."""
    names = list(keys)
    cells = {f"_dim{i}": clean.dim_value(c) for i, c in enumerate(dims.values())}
    # Pairs of name and value, without an array of structs built and taken apart again for every record.
    pairs = F.stack(F.lit(len(dims)), *[part for d, c in zip(dims, cells) for part in (F.lit(d), F.col(c))])
    return (
        # Keys and amount stand below the fan-out, or they would be worked out again for every dimension.
        df.select(*[c.alias(k) for k, c in keys.items()], amount.alias("amount"), *[c.alias(k) for k, c in cells.items()])
        .select(*names, "amount", pairs.alias("dim", "dim_value"))
        .groupBy(*names, "dim", "dim_value")
        .agg(F.sum("amount").cast("double").alias("value"))
    )


def extract_employment(records: DataFrame, source: Column) -> DataFrame:
    """Base stock rows: flat per sub-element, dimensioned headcount per agency, dated by snapshot month."""
    require(records, fixed.CORE_EMPLOYMENT)
    tagged = records.withColumn("source_ref", source)
    month = periods.month_start("snapshot_yyyymm")
    measures = available(employment_measures(), records.columns)
    wide = conditional_sums(tagged, {"node": clean.unit_code(), "period_start": month, "source_ref": F.col("source_ref")}, measures)
    flat_rows = wide_to_long(wide, ["node", "period_start", "source_ref"], [m.code for m in measures])
    dims = {d: c for d, (c, needs) in headcount_dimensions().items() if set(needs) <= set(records.columns)}
    dimensioned = by_dimensions(
        tagged,
        {"node": F.col("agency_code"), "period_start": month, "source_ref": F.col("source_ref")},
        dims,
        clean.multiplicity(),
    )
    return as_values(flat_rows, period_type="month").unionByName(
        as_values(dimensioned, measure="headcount", period_type="month")
    )


def extract_actions(records: DataFrame, dataset: str, source: Column) -> DataFrame:
    """Base flow rows, dated by the month an action took effect; rows without a valid month are out."""
    require(records, fixed.CORE_ACTIONS)
    effective = "personnel_action_effective_date_yyyymm"
    dated = records.filter(periods.is_month_code(effective)).withColumn("source_ref", source)
    month = periods.month_start(effective)
    measures = available(action_measures(dataset), records.columns)
    keys = {"period_start": month, "source_ref": F.col("source_ref")}
    wide = conditional_sums(dated, {"node": clean.unit_code(), **keys}, measures)
    rows = as_values(
        wide_to_long(wide, ["node", "period_start", "source_ref"], [m.code for m in measures]), period_type="month"
    )
    dim, column = {
        "accessions": ("accession_category", "accession_category_code"),
        "separations": ("separation_category", "separation_category_code"),
    }[dataset]
    if column in records.columns:
        split = by_dimensions(dated, {"node": F.col("agency_code"), **keys}, {dim: F.col(column)}, clean.multiplicity())
        rows = rows.unionByName(as_values(split, measure=dataset, period_type="month"))
    return rows


# --- one row per key ---------------------------------------------------------------------------------------------


def source_version(source: Column | str) -> Column:
    """Version number inside a source reference such as 'fwd:employment_202607_2', compared as a number."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.regexp_extract(source, r"_(\d+)$", 1).try_cast("int"), F.lit(0))


def number_sources(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a source number in place of the reference, and the list of (source_no, source_ref).

    Numbers follow the order of names and, within a name, of versions. They are what duplicates and roll-ups
    compare: a maximum of numbers stays in a hash aggregate. There are as many sources as files were loaded. The list
    is written, so the optimiser knows its size when it joins it.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.regexp_replace("source_ref", r"_\d+$", ""), source_version("source_ref"), "source_ref")
    listed = values.select(F.coalesce("source_ref", F.lit("")).alias("source_ref")).distinct()
    sources = materialise(listed.withColumn("source_no", F.row_number().over(order)), "sources")
    numbered = values.withColumn("source_ref", F.coalesce("source_ref", F.lit(""))).join(
        sources, "source_ref"
    ).drop("source_ref")
    return numbered, sources


def name_sources(numbered: DataFrame, sources: DataFrame) -> DataFrame:
    return numbered.join(sources, "source_no").select(*VALUE_COLUMNS)


def resolve_numbered(values: DataFrame, flow_measures: Sequence[str]) -> DataFrame:
    """One row per key: flows add up over sources, stocks take the non-null value of the highest source number."""
    stock = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("source_no")))
    # A node, period or measure may hold most rows; all of this combines before the shuffle.
    return values.groupBy(*KEY_COLUMNS).agg(
        F.when(F.col("measure").isin(*flow_measures), F.sum("value")).otherwise(stock).alias("value"),
        F.lit(None).cast("long").alias("n"),
        notation_name(F.max(notation_rank("notation"))).alias("notation"),
        F.max("source_no").alias("source_no"),
    )


def resolve_duplicates(values: DataFrame, flow_measures: Sequence[str]) -> DataFrame:
    """Flows add up over files; stocks take the non-null value of the newest file."""
    numbered, sources = number_sources(values)
    return name_sources(resolve_numbered(numbered, flow_measures), sources)


def most_frequent(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column per key, lowest value on ties, nulls not counted.

    Counts per (key, column, value) first, so no key's values ever meet in one buffer.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = (
        df.select(*keys, F.explode(pairs).alias("pair"))
        .groupBy(*keys, F.col("pair.column").alias("column"), F.col("pair.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("times"))
    )
    known = F.col("value").isNotNull()

    def winner(column: str) -> Column:
        mine = known & (F.col("column") == column)
        best = F.min(F.when(mine, F.struct((-F.col("times")).alias("times"), F.col("value"))))
        return best["value"].alias(column)

    return counts.groupBy(*keys).agg(*[winner(c) for c in columns])


def distinct_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, blanks named."""
    return df.filter(F.col(column).isNotNull()).select(
        F.when(F.col(column) == "", fixed.BLANK).otherwise(F.col(column)).alias("code")
    ).distinct()


def headcount_by_month(records: DataFrame, code: Column, month: Column) -> DataFrame:
    """Headcount per code and month, long."""
    return records.groupBy(code.alias("code"), month.alias("yyyymm")).agg(
        F.sum(clean.multiplicity()).alias("headcount")
    )


def headcount_map(by_month: DataFrame) -> DataFrame:
    """The same as one map per code; its size is the number of months."""
    return by_month.groupBy("code").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("yyyymm", "headcount")))).alias("headcount")
    )


# --- lookups ---------------------------------------------------------------------------------------------------------


def merge_lookup(observations: DataFrame, attributes: Sequence[str], code: str = "code", month: str = "yyyymm") -> DataFrame:
    """First and last month seen, newest usable value of each attribute, name of the newest month.

    Observations are one row per code and month, earlier lookups included; a merge is a union and this call.
    """
    def newest(column: str, usable: Column) -> Column:
        return F.max_by(column, F.when(usable, F.col(month)))

    def stated(column: str) -> Column:
        return F.col(column).isNotNull() & ~F.col(column).isin("", fixed.REDACTED)

    return observations.groupBy(code).agg(
        F.min(month).alias("first_seen"),
        F.max(month).alias("last_seen"),
        *[newest(a, stated(a)).alias(a) for a in attributes],
        newest("name", F.col("name").isNotNull()).alias("name"),
    )


def name_history(observations: DataFrame, code: str = "code", month: str = "yyyymm") -> DataFrame:
    """Months at which a code's name changed, the first month included. One row per code and month comes in."""
    from pyspark.sql import Window

    order = Window.partitionBy(code).orderBy(month)
    named = observations.filter(F.col("name").isNotNull())
    before = F.lag("name").over(order)
    return (
        named.withColumn("changed", before.isNull() | (before != F.col("name")))
        .filter("changed")
        .select(code, month, "name")
    )


def newest_names(observations: DataFrame, code: str = "code", month: str = "yyyymm") -> DataFrame:
    """Name in the latest month a code was seen, and that month."""
    usable = F.col("name").isNotNull() & ~F.col("name").isin(*fixed.NO_NAME)
    return observations.filter(usable).groupBy(code).agg(
        F.max_by("name", month).alias("name"), F.max(month).alias("from_month")
    )


def observed_span(values: DataFrame) -> DataFrame:
    """First and last headcount month of every code shaped like an agency or sub-element."""
    node = F.col("node")
    shaped = (F.length(node) == 4) | ((F.length(node) == 2) & (node == F.upper(node)))
    return (
        values.filter((F.col("measure") == "headcount") & F.col("dim").isNull() & shaped)
        .groupBy("node")
        .agg(F.min("period_start").alias("first_seen"), F.max("period_start").alias("last_seen"))
    )


def table_stats(values: DataFrame) -> DataFrame:
    """Rows, nodes, measures and period range in one row."""
    return values.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("node").alias("nodes"),
        F.countDistinct("measure").alias("measures"),
        F.min("period_start").alias("first_period"),
        F.max("period_start").alias("last_period"),
    )
