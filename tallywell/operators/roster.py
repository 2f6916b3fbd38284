"""Leadership rosters: position history, counts, ordered rosters, directory and careers.

Rosters name people. Nothing here joins them to workforce records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import classify, clean
from tallywell.operators.slices import with_range
from tallywell.schema import as_values

POSITION_COLUMNS = [
    "agency_name", "org_name", "title", "status", "appointment_type", "pay_plan", "level_grade_pay", "duty_location",
    "first_name", "last_name", "individual_id", "begin_date", "vacate_date", "expiration_date", "tenure",
]


def read_positions(raw: DataFrame, snapshot: Column) -> DataFrame:
    """Raw roster columns cleaned: entities decoded, blanks to null, dates parsed."""
    text, blank = clean.decode_entities, clean.blank_to_null
    return raw.select(
        snapshot.alias("snapshot"),
        text("Agency").alias("agency_name"), text("Organization").alias("org_name"), text("`Position Title`").alias("title"),
        F.col("`Position Status`").alias("status"), F.col("`Appointment Type`").alias("appointment_type"),
        F.col("`Pay Plan`").alias("pay_plan"), text("`Level, Grade, or Pay`").alias("level_grade_pay"),
        text("`Duty Location`").alias("duty_location"),
        blank(text("`First Name`")).alias("first_name"), blank(text("`Last Name`")).alias("last_name"),
        blank("`Individual Unique ID`").alias("individual_id"),
        clean.us_date("`Begin Date`").alias("begin_date"), clean.us_date("`Vacate Date`").alias("vacate_date"),
        clean.us_date("`Expiration Date`").alias("expiration_date"), blank("Tenure").alias("tenure"),
    )


def collapse_snapshots(observed: DataFrame, columns: Sequence[str], carried: DataFrame | None = None) -> DataFrame:
    """Identical rows over snapshots become one with the first and last snapshot it was seen in.

    A collapsed history comes back in as both ends of its span.
    """
    rows = observed.select("snapshot", *columns)
    if carried is not None:
        ends = carried.select(F.explode(F.array("first_snapshot", "last_snapshot")).alias("snapshot"), *columns)
        rows = rows.unionByName(ends)
    return rows.groupBy(*columns).agg(F.min("snapshot").alias("first_snapshot"), F.max("snapshot").alias("last_snapshot"))


def with_appointment(positions: DataFrame, code: str = "appointment_type") -> DataFrame:
    return positions.withColumn("appointment_label", classify.appointment_label(code)).withColumn(
        "appointment_class", classify.appointment_class(code)
    )


def place(positions: DataFrame, crosswalk: DataFrame, how: str = "inner") -> DataFrame:
    """Attach node and agency by the (agency name, organisation name) crosswalk."""
    return positions.join(crosswalk.select("agency_name", "org_name", "node", "agency"), ["agency_name", "org_name"], how)


STATUS_MEASURES = ("plum_positions", "plum_filled", "plum_vacant", "plum_political", "plum_career")


def status_counts(placed: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Positions, filled, vacant, political and career per agency and snapshot, as wide rows.

    With `snapshots` a position counts in every snapshot between its first and last one, so a new snapshot adds a
    point and leaves the older ones as they were. Without it each position counts once, at its last snapshot.
    """
    live = placed.filter(F.col("status") != "Historical")
    if snapshots is None:
        dated = live.withColumn("snapshot", F.col("last_snapshot"))
    else:
        listed = snapshots.select(F.array_sort(F.collect_set("snapshot"))).scalar()
        spans = live.groupBy("agency", "status", "appointment_type", "first_snapshot", "last_snapshot").agg(F.count(F.lit(1)).alias("rows"))
        dated = spans.withColumn("listed", listed).withColumn("snapshot", F.explode(
            F.filter("listed", lambda s: s.between(F.col("first_snapshot"), F.col("last_snapshot")))
        )).drop("listed")
    amount = F.col("rows") if "rows" in dated.columns else F.lit(1)
    filled, vacant = F.col("status") == "Filled", F.col("status") == "Vacant"
    political = classify.is_political("appointment_type")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, amount).otherwise(0))

    return dated.groupBy("agency", "snapshot").agg(
        F.sum(amount).alias("plum_positions"),
        total(filled).alias("plum_filled"),
        total(vacant).alias("plum_vacant"),
        total(filled & political).alias("plum_political"),
        total(filled & ~political).alias("plum_career"),
    )


def status_values(counts: DataFrame) -> DataFrame:
    """Status counts as value rows, dated by the month of the snapshot."""
    long = counts.select("agency", "snapshot", *[F.col(m).cast("double") for m in STATUS_MEASURES]).unpivot(
        ["agency", "snapshot"], list(STATUS_MEASURES), "measure", "value"
    )
    day = F.col("snapshot").cast("date")
    return as_values(
        long.withColumnRenamed("agency", "node"), period_type="month", period_start=F.trunc(day, "month"),
        source_ref=F.concat(F.lit("plum:"), F.date_format(day, "yyyy-MM-dd")),
    )


def roster(placed: DataFrame) -> DataFrame:
    """Current positions of every node from the head down.

    The order is a distributed sort: a node with a great many positions spreads over several ranges.
    """
    live = placed.filter(F.col("status") != "Historical")
    return live.select(
        "node", classify.seniority("title", "appointment_type").alias("rank"), "title", "status", "appointment_type",
        clean.full_name("first_name", "last_name").alias("name"), "last_name", "individual_id", "begin_date",
        "level_grade_pay", "org_name",
    ).orderBy("node", "rank", "last_name", "title", "individual_id")


def directory(positions: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Filled positions with a named person, by name; a position without a node stays in."""
    named = positions.filter(
        (F.col("status") == "Filled") & (F.col("first_name").isNotNull() | F.col("last_name").isNotNull())
    )
    return place(named, crosswalk, "left").select(
        clean.full_name("first_name", "last_name").alias("name"), "first_name", "last_name", "individual_id", "title",
        "agency_name", "org_name", "appointment_type", "begin_date", "node",
    ).orderBy("last_name", "first_name", "individual_id", "title")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "seq") -> DataFrame:
    """Row numbers per key without sorting a whole key in one task.

    Ranges over key and order cut a crowded key into many small sorts, also where most of its rows share one date;
    rows are numbered inside (key, range) and shifted by the number of rows in the key's earlier ranges.
    """
    keys = list(keys)
    blocked = with_range(df, [*keys, *order], "_slice")
    sizes = blocked.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    # At most one row per key and slice.
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_slice",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("_rows"),
    )
    # Rows that are equal in the order are told apart as the ranges did.
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order, F.xxhash64(*df.columns))
    return (
        blocked.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .withColumn(name + "_of", F.col("_rows"))
        .drop("_slice", "_local", "_before", "_rows")
    )


def timelines(positions: DataFrame) -> DataFrame:
    """Every position of people who held more than one, numbered by begin date; unknown dates come first."""
    known = positions.filter(F.col("individual_id").isNotNull())
    order = [F.col("begin_date").asc_nulls_first(), "title", "agency_name", "org_name", "status"]
    return numbered(known, ["individual_id"], order).filter(F.col("seq_of") > 1).select(
        "individual_id", clean.full_name("first_name", "last_name").alias("name"), "seq", "title", "agency_name",
        "org_name", "status", "appointment_type", "begin_date", "vacate_date", "level_grade_pay",
    )


def leaked_columns(df: DataFrame) -> list[str]:
    """Workforce attributes that have no place in a roster output."""
    return sorted(set(fixed.WORKFORCE_ONLY_COLUMNS) & set(df.columns))


def leaks(documents: DataFrame) -> DataFrame:
    """Per output: documents, and those that name a workforce attribute. `documents` is (output, document) of JSON texts."""
    named = F.arrays_overlap(F.json_object_keys("document"), F.array(*[F.lit(c) for c in fixed.WORKFORCE_ONLY_COLUMNS]))
    return documents.groupBy("output").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.when(named, 1).otherwise(0)).alias("leaking"))
