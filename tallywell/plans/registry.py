"""The whole build: base rows from every source, roll-ups, zero rows, derived measures, checked and written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.operators import checks, evaluate, facts, hierarchy
from tallywell.plans.catalog import CATALOG, as_table, flows
from tallywell.schema import VALUE_COLUMNS, as_values
from tallywell.session import cut_lineage
from tallywell.sources import sinks


@dataclass(frozen=True)
class Sources:
    """Inputs of a build. `extracts` are base rows from record files; `others` are value rows of slower sources."""

    extracts: DataFrame
    nodes: DataFrame
    agency_department: DataFrame
    group_members: DataFrame | None = None
    others: Sequence[DataFrame] = field(default=())


def base_values(
    sources: Sources,
    catalog: evaluate.Catalog = CATALOG,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Base rows at every level: duplicates resolved, rolled up, zero rows and group headcounts added.

    The roll-up is cut once, as all later steps read it several times.
    """
    flow_specs = flows(catalog)
    numbered, listed = facts.number_sources(sources.extracts)
    leaf = facts.resolve_numbered(numbered, [code for code, _ in flow_specs])
    rolled = cut(facts.name_sources(hierarchy.roll_up_numbered(leaf, sources.agency_department), listed))
    out = rolled
    if flow_specs:
        out = out.unionByName(cut(hierarchy.zero_fill(rolled, flow_specs)))
    if sources.group_members is not None:
        out = out.unionByName(cut(hierarchy.signed_groups(rolled, sources.group_members, sources.nodes)))
    for other in sources.others:
        out = out.unionByName(other)
    return out


def build_values(
    sources: Sources,
    catalog: evaluate.Catalog = CATALOG,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Base and derived rows; a measure outside the catalog stops the build."""
    base = base_values(sources, catalog, cut)
    known = as_table(sources.nodes.sparkSession, catalog)
    checks.require_empty(checks.unknown_measures(base, known), "measures not in the catalog")
    return evaluate.evaluate_all(base, sources.nodes, catalog, cut)


def latest_composition(monthly_facts: DataFrame, nodes: DataFrame, latest, source: str) -> DataFrame:
    """Dimensioned headcount of sub-elements for the latest month, from the monthly facts."""
    dims = {
        "grade": "grade", "age_bracket": "age_bracket", "supervisory": "supervisory_code",
        "appointment_type": "appointment_type_code", "pay_band": "pay_band", "work_schedule": "work_schedule_code",
        "series": "series_code", "step": "step_code",
    }
    units = nodes.filter(F.col("kind") == "subelement").select(F.col("code").alias("org_code"))
    month = monthly_facts.filter(F.to_date(F.concat("snapshot_yyyymm", F.lit("01")), "yyyyMMdd") == latest)
    rows = facts.by_dimensions(
        month.join(units, "org_code", "left_semi"),
        {"node": F.col("org_code"), "period_start": F.to_date(F.concat("snapshot_yyyymm", F.lit("01")), "yyyyMMdd")},
        {d: F.col(c) for d, c in dims.items()},
        F.col("n"),
    )
    return as_values(rows, measure="headcount", period_type="month", source_ref=source)


def publish(values: DataFrame, path: str) -> DataFrame:
    """Write the value table in node order and return its statistics."""
    sinks.write_values(values, path)
    return facts.table_stats(values.sparkSession.read.parquet(path).select(*VALUE_COLUMNS))
