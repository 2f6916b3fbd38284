"""Questions over the value table: latest rows, movers, changes, top values, shares, packed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import clean, periods
from tallywell.schema import flat
from tallywell.session import cut_lineage, literal_table


def valued(values: DataFrame) -> DataFrame:
    return flat(values).filter(F.col("value").isNotNull())


def latest_headcount_month(values: DataFrame) -> Column:
    """The newest month with a headcount; other sources may run ahead of it."""
    return (
        flat(values)
        .filter((F.col("measure") == "headcount") & (F.col("period_type") == "month"))
        .select(F.max("period_start"))
        .scalar()
    )


def current(values: DataFrame) -> DataFrame:
    """Latest valued row per node and measure: a maximum, which combines before the shuffle, not a sort."""
    newest = F.max(F.struct("period_start", "period_type", "value", "n", "notation")).alias("newest")
    return valued(values).groupBy("node", "measure").agg(newest).select(
        "node", "measure", "newest.period_type", "newest.period_start",
        F.bround("newest.value", 4).alias("value"), "newest.n", "newest.notation",
    )


def _starts(values: DataFrame, anchor: Column, windows: dict[str, int | None]) -> DataFrame:
    """(label, start, latest): first month at or after the window's beginning. One row per window."""
    spans = literal_table(values.sparkSession, "label string, months int", windows.items())
    months = (
        flat(values).filter(F.col("period_type") == "month").select("period_start").distinct()
        .withColumn("latest", anchor)
    )
    inside = F.col("months").isNull() | (F.col("period_start") >= F.add_months("latest", -F.col("months")))
    return (
        months.withColumn("window", F.explode(
            spans.agg(F.collect_list(F.struct("label", "months"))).scalar()))
        .select("period_start", "latest", "window.label", "window.months")
        .filter(inside)
        .groupBy("label", "latest")
        .agg(F.min("period_start").alias("start"))
        .filter("start < latest")
    )


def _endpoints(values: DataFrame, starts: DataFrame) -> DataFrame:
    """(label, measure, node, v0, v1) where both ends of a window have a value; one pass, no self join."""
    ends = starts.select("label", F.explode(F.array(
        F.struct(F.col("start").alias("period_start"), F.lit(0).alias("end")),
        F.struct(F.col("latest").alias("period_start"), F.lit(1).alias("end")),
    )).alias("e")).select("label", "e.period_start", "e.end")
    rows = valued(values).filter(F.col("period_type") == "month")
    return (
        rows.join(F.broadcast(ends), "period_start")
        .groupBy("label", "measure", "node")
        .agg(
            F.max(F.when(F.col("end") == 0, F.col("value"))).alias("v0"),
            F.max(F.when(F.col("end") == 1, F.col("value"))).alias("v1"),
        )
    )


def movers(
    values: DataFrame,
    nodes: DataFrame,
    measures: Sequence[str],
    windows: dict[str, int | None] = fixed.MOVER_WINDOWS,
    rows: int = fixed.MOVER_ROWS,
    floor: float = fixed.MIN_MOVER_HEADCOUNT,
    by: str = "delta",
) -> DataFrame:
    """Agencies that rose and fell most per measure and window.

    Only agencies with at least `floor` people at the start count, and a measure needs four of them. The two
    lists overlap when there are fewer than twice `rows` agencies. `by` may be 'pct'.
    """
    starts = _starts(values, latest_headcount_month(values), windows)
    wanted = list(dict.fromkeys([*measures, "headcount"]))
    agencies = nodes.filter(F.col("kind") == "agency").select(F.col("code").alias("node"))
    # The 8 boundary rows are the broadcast side; agencies and sizes are left to the optimiser's size estimates.
    ends = _endpoints(values.filter(F.col("measure").isin(*wanted)).join(agencies, "node", "left_semi"), starts)
    large = ends.filter((F.col("measure") == "headcount") & (F.col("v0") >= floor)).select("label", "node")
    both = ends.filter(F.col("measure").isin(*measures) & F.col("v0").isNotNull() & F.col("v1").isNotNull())
    change = both.join(large, ["label", "node"], "left_semi").select(
        "label", "measure", "node", "v0", "v1",
        (F.col("v1") - F.col("v0")).alias("delta"),
        F.try_divide(100.0 * (F.col("v1") - F.col("v0")), F.abs("v0")).alias("pct"),
    )
    # At most agencies times measures times windows; three steps read it.
    change = cut_lineage(change)
    enough = change.groupBy("label", "measure").agg(F.count(F.lit(1)).alias("units")).filter(F.col("units") >= fixed.MIN_MOVER_UNITS)
    change = change.join(enough.select("label", "measure"), ["label", "measure"], "left_semi")
    group = Window.partitionBy("label", "measure")
    ranked = change.filter(F.col(by).isNotNull())
    down = ranked.withColumn("place", F.row_number().over(group.orderBy(by, "node"))).filter(F.col("place") <= rows)
    up = ranked.withColumn("place", F.row_number().over(group.orderBy(F.desc(by), F.desc("node")))).filter(F.col("place") <= rows)
    return (
        down.withColumn("direction", F.lit("down")).unionByName(up.withColumn("direction", F.lit("up")))
        .select(
            "label", "measure", "direction", "place", "node",
            F.bround("v0", 3).alias("v0"), F.bround("v1", 3).alias("v1"),
            F.bround("delta", 3).alias("delta"), F.bround("pct", 1).alias("pct"),
        )
    )


def change_table(values: DataFrame, nodes: DataFrame, windows: dict[str, int | None] = fixed.CHANGE_WINDOWS) -> DataFrame:
    """Latest value of every measure and its absolute and relative change over each window."""
    shown = nodes.filter(F.col("kind").isin("gov", "agency", "group")).select(F.col("code").alias("node"))
    rows = values.join(shown, "node", "left_semi")
    now = current(rows)
    starts = _starts(values, latest_headcount_month(values), windows)
    base = valued(rows).filter(F.col("period_type") == "month").join(
        F.broadcast(starts.select("label", F.col("start").alias("period_start"))), "period_start"
    )
    past = base.groupBy("node", "measure").agg(
        *[F.max(F.when(F.col("label") == label, F.col("value"))).alias("base" + label) for label in windows]
    )
    monthly = F.col("period_type") == "month"
    out = now.join(past, ["node", "measure"], "left")
    cells = []
    for label in windows:
        base_value = F.when(monthly, F.col("base" + label))
        delta = F.col("value") - base_value
        cells += [
            F.bround(delta, 3).alias("d" + label),
            F.bround(F.try_divide(100.0 * delta, F.abs(base_value)), 2).alias("p" + label),
        ]
    return out.select("node", "measure", "period_type", "period_start", "value", "notation", *cells)


# --- top values ------------------------------------------------------------------------------------------------


def top_and_other(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    amount: str,
    keep: int,
    period: str | None = None,
) -> DataFrame:
    """The `keep` largest items per group by their amount in the group's last period; all others become '_other'.

    Ranking keeps at most `keep` rows per group and task before anything is shuffled. The rest is recoded through
    a join and summed, so a group of any size is never gathered in one place and nothing is dropped.
    """
    keys = [*group, item]
    df = df.groupBy(*keys, *([period] if period else [])).agg(F.sum(amount).alias(amount))
    if period is None:
        last = df.groupBy(*keys).agg(F.sum(amount).alias("_last"))
    else:
        newest = df.groupBy(*group).agg(F.max(period).alias("_newest"))
        at_end = F.coalesce(F.sum(F.when(F.col(period) == F.col("_newest"), F.col(amount))), F.lit(0.0))
        last = df.join(newest, list(group)).groupBy(*keys).agg(at_end.alias("_last"))
    order = Window.partitionBy(*group).orderBy(F.desc("_last"), item)
    kept = (
        last.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= keep)
        .select(*keys, F.lit(True).alias("_kept"))
    )
    out_keys = [*group, *([period] if period else [])]
    return (
        df.join(kept, keys, "left")
        .groupBy(*out_keys, F.when(F.col("_kept"), F.col(item)).otherwise(fixed.OTHER).alias(item))
        .agg(F.sum(amount).alias(amount))
    )


def largest(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], count: int) -> DataFrame:
    """The first `count` rows of each group; Spark limits each task's share before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= count)


def sort_nulls_last(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(key)


# --- shares, indices, changes ------------------------------------------------------------------------------------


def share_of_total(df: DataFrame, group: Sequence[str], amount: str = "value") -> DataFrame:
    """Amount over the group's total. The total is an aggregate joined back, so no group passes through one task."""
    totals = df.groupBy(*group).agg(F.sum(amount).alias("_total"))
    return df.join(totals, list(group)).withColumn("share", F.try_divide(F.col(amount), "_total")).drop("_total")


def index_to_first(series: DataFrame, keys: Sequence[str], period: str = "period_start") -> DataFrame:
    """100 at the first period of each series; a zero or absent base counts as 1."""
    base = series.groupBy(*keys).agg(F.min_by("value", period).alias("_base"))
    divisor = F.when(F.col("_base").isNull() | (F.col("_base") == 0), 1.0).otherwise(F.col("_base"))
    return series.join(base, list(keys)).withColumn("index", 100 * F.col("value") / divisor).drop("_base")


def change_since_first(series: DataFrame, keys: Sequence[str], period: str = "period_start") -> DataFrame:
    return series.groupBy(*keys).agg(
        F.min(period).alias("since"), F.max(period).alias("until"),
        (F.max_by("value", period) - F.min_by("value", period)).alias("change"),
    )


def flows_wide(values: DataFrame, node: str | None, up: Sequence[str], down: Sequence[str]) -> DataFrame:
    """One row per node and period: every flow as a column, and the net."""
    rows = valued(values).filter(F.col("measure").isin(*up, *down))
    if node is not None:
        rows = rows.filter(F.col("node") == node)
    wide = rows.groupBy("node", "period_start").pivot("measure", [*up, *down]).agg(F.sum("value"))

    def total(columns: Sequence[str]) -> Column:
        out = F.lit(0.0)
        for c in columns:
            out = out + F.coalesce(F.col(c), F.lit(0.0))
        return out

    return wide.withColumn("net", total(up) - total(down))


# --- packed series ------------------------------------------------------------------------------------------------


def pack(values: DataFrame, keys: Sequence[str] = ("node", "measure"), axes: DataFrame | None = None) -> DataFrame:
    """Series as arrays against the shared axis of their period type: {t, i, v, n, z}. The axis is that of `axes`, if given.

    A series holds at most one point per period, so the arrays are bounded by the calendar. Gaps are null; n is
    null unless some point has a count; z maps positions to notations.
    """
    positions = periods.axis(values if axes is None else axes).select("period_type", F.posexplode("axis").alias("pos", "period_start"))
    points = values.filter(F.col("value").isNotNull()).join(F.broadcast(positions), ["period_type", "period_start"])
    point = F.struct("pos", clean.display_round("value").alias("value"), "n", "notation")
    gathered = points.groupBy(*keys, "period_type").agg(F.array_sort(F.collect_list(point)).alias("points"))
    items = F.col("points")
    first = F.element_at(items, 1)["pos"]

    def spread(name: str) -> Column:
        def with_gap(p: Column, at: Column) -> Column:
            following = F.try_element_at(items, at + 2)["pos"]
            gap = F.coalesce(following - p["pos"] - 1, F.lit(0))
            return F.concat(F.array(p[name]), F.array_repeat(F.lit(None).cast(_type_of[name]), gap))

        return F.flatten(F.transform(items, with_gap))

    _type_of = {"value": "double", "n": "long"}
    noted = F.filter(items, lambda p: p["notation"].isNotNull())
    return gathered.select(
        *keys,
        F.col("period_type").alias("t"),
        first.alias("i"),
        spread("value").alias("v"),
        F.when(F.exists(items, lambda p: p["n"].isNotNull()), spread("n")).alias("n"),
        F.when(F.size(noted) > 0, F.map_from_entries(
            F.transform(noted, lambda p: F.struct((p["pos"] - first).cast("string"), p["notation"])))).alias("z"),
    )


def unpack(packed: DataFrame, axes: DataFrame, keys: Sequence[str] = ("node", "measure")) -> DataFrame:
    """Packed series back to rows, absent points left out."""
    positions = axes.select(F.col("period_type").alias("t"), F.posexplode("axis").alias("pos", "period_start"))
    points = packed.select(*keys, "t", "i", "n", "z", F.posexplode("v").alias("at", "value")).filter(F.col("value").isNotNull())
    return points.withColumn("pos", F.col("i") + F.col("at")).join(F.broadcast(positions), ["t", "pos"]).select(
        *keys, F.col("t").alias("period_type"), "period_start", "value",
        F.try_element_at("n", F.col("at") + 1).alias("n"),
        F.try_element_at("z", F.col("at").cast("string")).alias("notation"),
    )


def node_documents(values: DataFrame) -> DataFrame:
    """One row per node with its packed series keyed by measure. Its size is catalog times calendar, not data."""
    series = pack(valued(values))
    return series.groupBy("node").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("t", "i", "v", "n", "z")))).alias("measures")
    )


# --- questions -------------------------------------------------------------------------------------------------------


def explore(values: DataFrame, node_codes: Sequence[str], measures: Sequence[str], start: str | None = None, mode: str = "value") -> DataFrame:
    """Series of some nodes and measures since a date, as values or indexed to their first point."""
    rows = valued(values).filter(F.col("node").isin(*node_codes) & F.col("measure").isin(*measures))
    if start is not None:
        rows = periods.since(rows, start)
    rows = rows.select(
        "node", "measure", "period_type", "period_start",
        periods.period_label("period_type", "period_start").alias("label"), "value", "n", "notation",
    )
    return index_to_first(rows, ["node", "measure"]) if mode == "index" else rows


def breakdown(facts: DataFrame, unit: str, dim: str, equals: tuple[str, str] | None = None, rows: int | None = fixed.BREAKDOWN_ROWS) -> DataFrame:
    """People, share and average disclosed pay by one dimension, for a unit and all below it.

    Shares refer to everything that passed the filter. `rows` is the length of the report; None gives all.
    """
    picked = facts.filter(clean.below_prefix("org_code", unit))
    if equals is not None:
        picked = picked.filter(F.col(equals[0]) == equals[1])
    counts = picked.groupBy(F.col(dim).alias("k")).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("pay_sum"), F.sum("pay_n")).alias("avg_pay")
    )
    total = picked.select(F.sum("n")).scalar()
    out = counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total)).orderBy(F.desc("n"), "k")
    return out if rows is None else out.limit(rows)


def mix_summary(facts: DataFrame, node: Column) -> DataFrame:
    """Share with a disclosed location, average disclosed pay, disclosed share and average service per node."""
    disclosed = F.sum(F.when(F.col("duty_station_code") != fixed.NOT_DISCLOSED, F.col("n")).otherwise(0))
    return facts.groupBy(node.alias("node")).agg(
        F.sum("n").alias("n"),
        F.bround(F.try_divide(disclosed.cast("double"), F.sum("n")), 4).alias("disclosed_location_share"),
        F.bround(F.try_divide(F.sum("pay_sum"), F.sum("pay_n")), 0).alias("avg_pay"),
        F.bround(F.try_divide(F.sum("pay_n").cast("double"), F.sum("n")), 4).alias("pay_disclosed_share"),
        F.bround(F.try_divide(F.sum("los_sum"), F.sum("n")), 1).alias("avg_los"),
    )


def flow_series(facts: DataFrame, category: str, targets: Column, extra: tuple[str, Column] | None = None) -> DataFrame:
    """Actions per node, effective month and category; `extra` counts a flagged part again under its own name."""
    codes = F.array(F.col(category)) if extra is None else F.filter(
        F.array(F.col(category), F.when(extra[1], F.lit(extra[0]))), lambda c: c.isNotNull()
    )
    # Actions are summed per set of nodes and categories first; the fan-out works on those sums.
    counts = facts.groupBy(
        F.filter(targets, lambda t: t.isNotNull()).alias("targets"), "effective_yyyymm", codes.alias("codes")
    ).agg(F.sum("n").alias("n"))
    return (
        counts.select(F.explode("targets").alias("node"), "effective_yyyymm", "n", "codes")
        .select("node", "effective_yyyymm", "n", F.explode("codes").alias("category"))
        .groupBy("node", "effective_yyyymm", "category")
        .agg(F.sum("n").alias("n"))
    )


def dimension_trend(facts: DataFrame, dims: Sequence[str], targets: Column, month: str = "snapshot_yyyymm") -> DataFrame:
    """Headcount per node, month and dimension value."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), clean.dim_value(d).alias("dim_value")) for d in dims])
    # Sum to the finest needed grain first: the fan-out to nodes then works on totals, not on facts.
    counts = (
        facts.select("org_code", month, "n", F.explode(pairs).alias("p"))
        .groupBy("org_code", month, F.col("p.dim").alias("dim"), F.col("p.dim_value").alias("dim_value"))
        .agg(F.sum("n").alias("n"))
    )
    return (
        counts.withColumn("node", F.explode(F.filter(targets, lambda t: t.isNotNull())))
        .groupBy("node", month, "dim", "dim_value")
        .agg(F.sum("n").alias("n"))
    )
