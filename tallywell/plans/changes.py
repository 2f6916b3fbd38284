"""Restated months without a full rebuild: changes are carried from records to every value that they can move.

A value table that a full build made is brought up to date with extracts of which some rows changed. The changed keys are
followed through each step of the build, only what they reach is computed again, and what comes out as it was before does
not go on:

    extracts      rows that differ between the old and the new extracts give (measure, period, agency);
    roll-up       those agencies are summed from their units, departments and the whole from agencies, of which the
                  unchanged ones come from the old table;
    zero rows     node months in which a headcount or a flow changed, and months by which a flow's last month moved;
    groups        groups with a member whose headcount changed;
    derived       level by level, the cells that a changed component serves: moved by an offset, in a longer period, or
                  anywhere in the node's series where an observation is carried; and periods by which the last observed
                  period moved.

Values of other sources change by rows too: `others` of the new sources are compared with those of the old table. A node's
kind and a department's agencies are taken as they are; if those change, build anew.

Defined results: the table equals a full build over the new sources. Without a change nothing is computed and the old
table comes back. A restated month may lack rows that it had, or have no rows at all; values that rested on them go.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.operators import evaluate, facts, hierarchy
from tallywell.plans.catalog import CATALOG, flows
from tallywell.plans.registry import Sources
from tallywell.schema import VALUE_COLUMNS
from tallywell.session import cut_lineage

CELL = ["measure", "node", "period_type", "period_start"]
_ZERO, _DERIVED = "zero-fill", "derived"


@dataclass(frozen=True)
class Update:
    """`values` is the whole table; `cells` are the keys that were looked at again, `rows` what stands there now."""

    values: DataFrame
    cells: DataFrame
    rows: DataFrame


def differing(old: DataFrame, new: DataFrame, columns: Sequence[str] = VALUE_COLUMNS) -> DataFrame:
    """Rows that only one of two tables of values has, repeated rows counted.

    One grouping over both, so equal rows cancel on the way to the shuffle; nothing is joined.
    """
    sided = old.select(*columns, F.lit(-1).alias("side")).unionByName(new.select(*columns, F.lit(1).alias("side")))
    return sided.groupBy(*columns).agg(F.sum("side").alias("side")).filter("side <> 0").drop("side")


def _moved(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells in which a calculation finds something else than before; the source alone does not matter to it."""
    return differing(evaluate.flat(old), evaluate.flat(new), [*CELL, "value", "notation"]).select(*CELL).distinct()


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select(*CELL).distinct()


def _replaced(old: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    return old.join(cells, CELL, "left_anti").select(*VALUE_COLUMNS).unionByName(rows.select(*VALUE_COLUMNS))


def _rolled_again(old: DataFrame, changed: DataFrame, sources: Sources, flow_codes: list[str], cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cells, rows) of the roll-up that changed extract rows reach. `old` are the rolled rows of the old table."""
    month, agency = ["measure", "period_type", "period_start"], F.substring("node", 1, 2)
    agency_cells = cut(changed.select(*month, agency.alias("agency")).distinct())
    kinds = sources.nodes.select(F.col("code").alias("node"), "kind")
    above = sources.agency_department.select(F.col("dept").alias("node")).distinct().unionByName(
        sources.nodes.sparkSession.createDataFrame([(hierarchy.ROOT,)], "node string"))
    groups = kinds.filter("kind = 'group'").select("node")
    below = old.join(above, "node", "left_anti").join(groups, "node", "left_anti").withColumn("agency", agency)

    part = sources.extracts.withColumn("agency", agency).join(agency_cells, [*month, "agency"], "left_semi").drop("agency")
    beside = below.filter(F.col("node") == F.col("agency")).join(agency_cells.select(*month).distinct(), month, "left_semi").join(
        agency_cells, [*month, "agency"], "left_anti")
    # Sources are numbered over both, so that the newest is found among both.
    given = part.select(*VALUE_COLUMNS, F.lit(True).alias("fresh")).unionByName(beside.select(*VALUE_COLUMNS, F.lit(False).alias("fresh")))
    numbered, listed = facts.number_sources(given)
    numbered = cut(numbered)
    leaf = facts.resolve_numbered(numbered.filter("fresh"), flow_codes)
    flat_rows = leaf.filter(F.col("dim").isNull())
    agencies = cut(hierarchy._totals(flat_rows.withColumn("node", agency)).unionByName(leaf.filter(F.col("dim").isNotNull())))
    departments = sources.agency_department.select(F.col("agency").alias("node"), "dept")
    moved = agency_cells.withColumnRenamed("agency", "node").join(departments, "node").select(*month, F.col("dept").alias("node")).unionByName(
        agency_cells.select(*month, F.lit(hierarchy.ROOT).alias("node"))).distinct()
    every = agencies.unionByName(numbered.filter("NOT fresh").select(*agencies.columns))
    upward = every.join(departments, "node", "left").withColumn(
        "node", F.explode(F.filter(F.array(F.col("dept"), F.lit(hierarchy.ROOT)), lambda code: code.isNotNull()))).drop("dept")
    totals = hierarchy._totals(upward.join(moved, [*month, "node"], "left_semi"))
    rows = cut(facts.name_sources(flat_rows.unionByName(agencies).unionByName(totals), listed))
    gone = below.join(agency_cells, [*month, "agency"], "left_semi").select(*CELL)
    return cut(gone.unionByName(moved.select(*CELL)).unionByName(rows.select(*CELL)).distinct()), rows


def _zeros_again(old: DataFrame, rolled: DataFrame, cells: DataFrame, flow_specs: list[tuple[str, str]], cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cells, rows) of zero rows; `old` is the old table of base rows, `rolled` the rolled rows as they are now."""
    codes = [code for code, _ in flow_specs]
    monthly = (F.col("period_type") == "month") & F.col("dim").isNull() & F.col("measure").isin("headcount", *codes)
    at = ["node", "period_start"]
    before = hierarchy.flow_spans(old.filter(F.col("source_ref") != _ZERO), flow_specs).withColumnRenamed("until", "was")
    spans = cut(hierarchy.flow_spans(rolled, flow_specs))
    moved = before.join(spans, "measure", "full").filter("NOT was <=> until").select(
        F.when(F.col("was").isNotNull() & F.col("until").isNotNull(), F.least("was", "until")).alias("after"), F.greatest("was", "until").alias("until"))
    touched = cells.filter((F.col("period_type") == "month") & F.col("measure").isin("headcount", *codes)).select(*at)
    window = moved.agg(F.min(F.coalesce(F.col("after").cast("string"), F.lit("0001-01-01"))).alias("after"), F.max("until").cast("string").alias("until")).first()
    if window["until"] is not None:  # a flow's last month moved: every node between
        between = (F.col("period_start") > F.lit(window["after"]).cast("date")) & (F.col("period_start") <= F.lit(window["until"]).cast("date"))
        touched = touched.unionByName(old.filter(monthly & between).select(*at)).unionByName(rolled.filter(monthly & between).select(*at))
    touched = cut(touched.distinct())
    rows = cut(hierarchy.zero_fill(rolled.filter(monthly).join(touched, at, "left_semi"), flow_specs, spans))
    gone = old.filter(F.col("source_ref") == _ZERO).join(touched, at, "left_semi")
    return cut(_cells(gone.unionByName(rows))), rows


def _groups_again(old: DataFrame, rolled: DataFrame, cells: DataFrame, sources: Sources, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    members = sources.group_members
    at = ["period_type", "period_start"]
    heads = cells.filter("measure = 'headcount'").select("node", *at)
    groups = heads.join(members.select(F.col("code").alias("node"), "gid"), "node").select(F.col("gid").alias("node"), *at).distinct()
    groups = cut(groups.withColumn("measure", F.lit("headcount")).select(*CELL))
    held = rolled.filter(F.col("measure") == "headcount").join(groups.select(*at).distinct(), at, "left_semi")
    touched = members.join(groups.select(F.col("node").alias("gid")).distinct(), "gid", "left_semi")
    rows = hierarchy.signed_groups(held, touched, sources.nodes).join(groups, CELL, "left_semi").select(*VALUE_COLUMNS)
    return groups, cut(rows)


def update_values(old: DataFrame, before: DataFrame, sources: Sources, catalog: evaluate.Catalog = CATALOG,
                  cut: Callable[[DataFrame], DataFrame] = cut_lineage, after: DataFrame | None = None) -> Update:
    """`old` is what a build made of the extracts `before`; `sources` hold the extracts as they are now.

    Where only some files were loaded anew, `before` and `after` may be the rows of these files alone, so that the others
    are not compared.
    """
    flow_specs = flows(catalog)
    codes = [code for code, _ in flow_specs]
    derived_codes = [m.code for m in catalog.values() if m.derived]
    base = old.filter(~F.col("measure").isin(*derived_codes))
    other_codes = [row["measure"] for other in sources.others for row in other.select("measure").distinct().collect()]  # codes of the catalog
    group_nodes = sources.nodes.filter("kind = 'group'").select(F.col("code").alias("node"))
    plain = base.filter(~F.col("measure").isin(*other_codes)) if other_codes else base
    rolled_before = plain.filter(F.col("source_ref") != _ZERO).join(group_nodes, "node", "left_anti").select(*VALUE_COLUMNS)

    changed = cut(differing(before, sources.extracts if after is None else after))
    if not sources.others and changed.isEmpty():
        return Update(old, old.select(*CELL).limit(0), old.limit(0))
    cells, rows = _rolled_again(rolled_before, changed, sources, codes, cut)
    rolled = _replaced(rolled_before, cells, rows)
    parts = [(cells, rows)]
    if flow_specs:
        parts.append(_zeros_again(plain, rolled, cells, flow_specs, cut))
    if sources.group_members is not None:
        parts.append(_groups_again(plain, rolled, cells, sources, cut))
    for other in sources.others:
        own = [row["measure"] for row in other.select("measure").distinct().collect()]
        moved = cut(_cells(differing(base.filter(F.col("measure").isin(*own)), other)))
        parts.append((moved, other.join(moved, CELL, "left_semi").select(*VALUE_COLUMNS)))
    all_cells, all_rows = parts[0]
    for more_cells, more_rows in parts[1:]:
        all_cells, all_rows = all_cells.unionByName(more_cells), all_rows.unionByName(more_rows)
    all_cells, all_rows = cut(all_cells.distinct()), cut(all_rows.select(*VALUE_COLUMNS))

    known = cut(_replaced(base, all_cells, all_rows))
    moved = cut(_moved(base.join(all_cells, CELL, "left_semi"), all_rows))
    ends = evaluate.last_periods(known).toDF("period_type", "end")
    was = evaluate.last_periods(base).toDF("period_type", "was")
    ends_moved = ends.join(was, "period_type", "full").filter("NOT was <=> end").select(
        "period_type", F.least("was", "end").alias("after"),
        F.when(F.col("was").isNotNull() & F.col("end").isNotNull(), F.greatest("was", "end")).otherwise(F.lit("9999-12-31").cast("date")).alias("until"))
    ends_moved, ends = cut(ends_moved), cut(ends)  # a row per kind of period
    for level in evaluate.levels(catalog):
        level_cells, level_rows = _level_again(old, known, moved, level, sources.nodes, catalog, ends, ends_moved, cut)
        before_rows = old.filter(F.col("measure").isin(*[m.code for m in level]))
        moved = moved.unionByName(cut(_moved(before_rows.join(level_cells, CELL, "left_semi"), level_rows)))
        known = known.unionByName(cut(_replaced(before_rows, level_cells, level_rows)))
        all_cells, all_rows = all_cells.unionByName(level_cells), all_rows.unionByName(level_rows)
    return Update(known, all_cells, all_rows)


def _level_again(old: DataFrame, known: DataFrame, moved: DataFrame, level: list[evaluate.Measure], nodes: DataFrame, catalog: evaluate.Catalog,
                 ends: DataFrame, ends_moved: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(cells, rows) of one level of derived measures."""
    at = ["measure", "node", "period_start"]
    cadence = F.create_map(*[F.lit(x) for m in level for x in (m.code, m.cadence)])
    cells, series = evaluate.reached(moved, level, catalog)
    series = cut(series)
    held = old.filter(F.col("measure").isin(*[m.code for m in level]))

    def served(rows: DataFrame) -> DataFrame:
        return evaluate.components(rows, level, catalog).select(F.col("derived").alias("measure"), "node", "period_start")

    anywhere = known.join(series.select("node").distinct(), "node", "left_semi")
    cells = cells.unionByName(served(anywhere).join(series, ["measure", "node"], "left_semi")).unionByName(
        held.join(series, ["measure", "node"], "left_semi").select(*at))
    if not ends_moved.isEmpty():
        late = served(known).unionByName(held.select(*at)).withColumn("period_type", cadence[F.col("measure")])
        late = late.join(F.broadcast(ends_moved), "period_type").filter((F.col("period_start") > F.col("after")) & (F.col("period_start") <= F.col("until")))
        cells = cells.unionByName(late.select(*at))
    cells = cut(cells.distinct())
    near = known.join(cells.select("node").distinct(), "node", "left_semi")
    rows = cut(evaluate.evaluate(near, nodes, level, catalog, cells, ends).select(*VALUE_COLUMNS))
    return cells.withColumn("period_type", cadence[F.col("measure")]).select(*CELL), rows
