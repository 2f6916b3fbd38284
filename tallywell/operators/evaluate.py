"""Derived measures: ratio, signed sum and time offset, one dependency level at a time.

A level is one job whatever its number of measures. Every flat value row is matched to the terms it serves,
moved to the period it serves, and a single grouping by (derived measure, node, period) yields numerator,
denominator, signed sum, the set of terms present and the notations for all measures of the level.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed
from tallywell.functions import periods
from tallywell.schema import as_values, flat, notation_name, notation_rank
from tallywell.session import cut_lineage, literal_table


@dataclass(frozen=True)
class Term:
    """One component of a calculation. A value observed at p with offset k serves the derived period p - k."""

    measure: str
    sign: int = 1
    offset: int = 0
    carry: int = 0


@dataclass(frozen=True)
class Measure:
    code: str
    title: str
    unit: str
    cadence: str
    levels: tuple[str, ...]
    category: str = "input"
    since: str = "2005-03-01"
    aggregation: str = "latest"
    pattern: str | None = None
    terms: tuple[Term, ...] = ()
    dimensions: tuple[str, ...] = ()
    notation: str | None = None
    display: bool = True

    @property
    def derived(self) -> bool:
        return self.pattern is not None


Catalog = Mapping[str, Measure]


def depth(catalog: Catalog, code: str) -> int:
    """0 for base measures, else one more than the deepest component."""
    measure = catalog[code]
    return 1 + max(depth(catalog, t.measure) for t in measure.terms) if measure.derived else 0


def levels(catalog: Catalog) -> list[list[Measure]]:
    """Derived measures by depth, components before dependents."""
    by_depth: dict[int, list[Measure]] = {}
    for measure in catalog.values():
        if measure.derived:
            by_depth.setdefault(depth(catalog, measure.code), []).append(measure)
    return [by_depth[d] for d in sorted(by_depth)]


def carry_forward(observations: DataFrame, keys: Sequence[str], steps: str = "carry", step: str = "step") -> DataFrame:
    """As-of with bounded staleness: each observation also stands for up to `steps` later periods.

    It stops at the next observation, null-valued ones included, and never runs past the last one of its key.
    This equals an as-of join against a grid of periods, without the grid: the reach of a row follows from the
    one after it. A key has at most one row per period, so its window is as long as the calendar.
    """
    ahead = F.lead("period_start").over(Window.partitionBy(*keys).orderBy("period_start"))
    gap = (F.months_between(ahead, F.col("period_start")) / F.col(step)).cast("int") - 1
    reach = F.least(F.col(steps), F.coalesce(gap, F.lit(0)))
    return observations.withColumn("reach", reach).select(
        *[c for c in observations.columns if c != "period_start"],
        F.col("period_start").alias("observed"),
        F.explode(
            F.transform(F.sequence(F.lit(0), F.greatest("reach", F.lit(0))),
                        lambda i: F.add_months("period_start", (i * F.col(step)).cast("int")))
        ).alias("period_start"),
    )


def coarsen(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Finer to coarser periods by the measure's own rule, marked incomplete where sub-periods are missing.

    Rows carry measure, node, period_start, value, notation, target, rule and expected.
    """
    parts = [*keys, "measure", "node", "target"]
    newest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period_start")))
    return (
        rows.withColumn("whole", periods.containing_any("period_start", "target"))
        .groupBy(*parts, "whole", "rule", "expected")
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.sum("value").alias("total"), F.avg("value").alias("mean"), newest.alias("newest"),
            notation_name(F.max(notation_rank("notation"))).alias("notation"),
        )
        .select(
            *parts,
            F.col("whole").alias("period_start"),
            F.when(F.col("rule") == "sum", F.col("total")).when(F.col("rule") == "average", F.col("mean"))
            .otherwise(F.col("newest")).alias("value"),
            F.when(F.col("found") < F.col("expected"), fixed.INCOMPLETE).otherwise(F.col("notation")).alias("notation"),
        )
    )


TERM_SCHEMA = (
    "derived string, target string, term int, term_bit long, sign int, shift int, measure string, period_type string, "
    "how string, carry int, step int, rule string, expected int"
)


def _term_rows(measures: Sequence[Measure], catalog: Catalog) -> list[tuple]:
    rows = []
    for measure in measures:
        for i, term in enumerate(measure.terms):
            if term.measure not in catalog:
                raise KeyError(f"{measure.code}: unknown component {term.measure}")
            source = catalog[term.measure]
            rank, wanted = fixed.PERIOD_RANK[source.cadence], fixed.PERIOD_RANK[measure.cadence]
            if rank == wanted and source.cadence != measure.cadence:
                raise ValueError(f"{measure.code}: {source.cadence} and {measure.cadence} never align")
            if rank > wanted:
                continue  # coarse is never spread to fine
            how = "coarser" if rank < wanted else "carried" if term.carry else "same"
            rows.append((
                measure.code, measure.cadence, i, 1 << i, term.sign,
                -term.offset * fixed.PERIOD_MONTHS[measure.cadence], term.measure, source.cadence, how, term.carry,
                fixed.PERIOD_MONTHS[source.cadence], source.aggregation,
                fixed.PERIODS_PER_YEAR[source.cadence] // fixed.PERIODS_PER_YEAR[measure.cadence],
            ))
    return rows


def components(values: DataFrame, measures: Sequence[Measure], catalog: Catalog) -> DataFrame:
    """(derived, term, sign, node, period_start, value, notation): each term's rows at the period they serve."""
    spark = values.sparkSession
    rows = _term_rows(measures, catalog)
    base = flat(values).select("measure", "node", "period_type", "period_start", "value", "notation")
    ways = {row[8] for row in rows}
    out = None

    def terms(how: str) -> DataFrame:
        return literal_table(spark, TERM_SCHEMA, [r for r in rows if r[8] == how])

    def served(df: DataFrame) -> DataFrame:
        return df.select(
            "derived", "term", "term_bit", "sign", "node",
            F.add_months("period_start", F.col("shift")).alias("period_start"), "value", "notation",
        )

    parts = []
    if "same" in ways:
        parts.append(served(base.join(F.broadcast(terms("same")), ["measure", "period_type"])))
    if "carried" in ways:
        specs = terms("carried")
        held = base.join(F.broadcast(specs), ["measure", "period_type"])
        parts.append(served(carry_forward(held, ["derived", "term", "node"])))
    if "coarser" in ways:
        specs = terms("coarser")
        rules = specs.select("measure", "period_type", "target", "rule", "expected").distinct()
        whole = coarsen(base.join(F.broadcast(rules), ["measure", "period_type"]))
        parts.append(served(whole.join(F.broadcast(specs.drop("period_type", "rule", "expected")), ["measure", "target"])))
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = served(base.join(F.broadcast(literal_table(spark, TERM_SCHEMA, [])), ["measure", "period_type"]))
    return out


def evaluate(values: DataFrame, nodes: DataFrame, measures: Sequence[Measure], catalog: Catalog,
             only: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Value rows of derived measures whose components are all in `values`.

    With `only`, a table of (measure, node, period_start), no other row is computed; `ends` are then the last periods of
    the whole table, of which `values` may be a part.
    """
    spark = values.sparkSession
    specs = literal_table(
        spark,
        "derived string, pattern string, cadence string, terms int, scale double, fallback string, levels array<string>",
        [(m.code, m.pattern, m.cadence, len(m.terms), fixed.UNIT_SCALE.get(m.unit, 1.0), m.notation, m.levels) for m in measures],
    )
    first, second = F.col("term") == 0, F.col("term") == 1
    served = components(values, measures, catalog).withColumn("noted", notation_rank("notation"))
    if only is not None:
        served = served.join(only.withColumnRenamed("measure", "derived"), ["derived", "node", "period_start"], "left_semi")
    gathered = served.groupBy("derived", "node", "period_start").agg(
        F.bool_or(first).alias("started"),
        F.max(F.when(first, F.col("value"))).alias("num"),
        F.max(F.when(second, F.col("value"))).alias("den"),
        notation_name(F.max(F.when(first, F.col("noted")))).alias("num_note"),
        notation_name(F.max(F.when(second, F.col("noted")))).alias("den_note"),
        F.sum(F.col("sign") * F.col("value")).alias("total"),
        F.bit_count(F.bit_or("term_bit")).alias("present"),
        notation_name(F.max("noted")).alias("any_note"),
    )
    ratio, additive = F.col("pattern") == "ratio", F.col("pattern") == "additive"
    undefined = F.col("den").isNull() | (F.col("den") == 0)
    partial = F.col("present") < F.col("terms")
    missing = F.lit(fixed.NOT_AVAILABLE)
    rows = (
        gathered.join(F.broadcast(specs), "derived")
        .filter(additive | F.col("started"))
        .withColumn(
            "value",
            F.when(ratio, F.when(~undefined, F.try_divide("num", "den") * F.col("scale")))
            .when(additive, F.when(~partial, F.col("total") * F.col("scale")))
            .otherwise(F.col("num")),
        )
        .withColumn("n", F.when(ratio, F.round("den").cast("long")))
        .withColumn(
            "notation",
            F.when(ratio, F.when(undefined, missing).otherwise(F.coalesce("num_note", "den_note", "fallback")))
            .when(additive, F.when(partial, missing).otherwise(F.col("any_note")))
            .otherwise(F.col("num_note")),
        )
    )
    kinds = nodes.select(F.col("code").alias("node"), "kind")
    allowed = rows.join(kinds, "node").filter(F.array_contains("levels", F.col("kind")))
    shaped = as_values(allowed.withColumnRenamed("derived", "measure"), period_type=F.col("cadence"), source_ref="derived",
                       dim=None, dim_value=None)
    return trim(shaped, last_periods(values) if ends is None else ends)


def last_periods(values: DataFrame) -> DataFrame:
    """(period_type, end): the last observed period of each kind."""
    return values.filter(F.col("source_ref") != "derived").groupBy("period_type").agg(F.max("period_start").alias("end"))


def trim(derived: DataFrame, ends: DataFrame) -> DataFrame:
    """Drop derived periods after the last observed period of their cadence; an offset must not invent a future."""
    return (
        derived.join(F.broadcast(ends), "period_type", "left")
        .filter(F.col("end").isNull() | (F.col("period_start") <= F.col("end")))
        .select(*derived.columns)
    )


def reached(changed: DataFrame, measures: Sequence[Measure], catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """What changed (measure, node, period_type, period_start) cells can move: (measure, node, period_start) cells of derived
    measures, and (measure, node) pairs of which any period may move, because a carried observation stands for others.
    """
    specs = F.broadcast(literal_table(changed.sparkSession, TERM_SCHEMA, _term_rows(measures, catalog)))
    met = changed.join(specs, ["measure", "period_type"])
    served = F.when(F.col("how") == "coarser", periods.containing_any("period_start", "target")).otherwise(F.col("period_start"))
    cells = met.filter("how <> 'carried'").select(F.col("derived").alias("measure"), "node", F.add_months(served, F.col("shift")).alias("period_start"))
    whole = met.filter("how = 'carried'").select(F.col("derived").alias("measure"), "node")
    return cells.distinct(), whole.distinct()


def evaluate_all(
    values: DataFrame,
    nodes: DataFrame,
    catalog: Catalog,
    cut: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Base rows and every derived row. Old derived rows are replaced, and each level is cut from its lineage."""
    known = values.filter(~F.col("measure").isin(*[m.code for m in catalog.values() if m.derived]))
    for level in levels(catalog):
        known = known.unionByName(cut(evaluate(known, nodes, level, catalog)))
    return known


def trailing_sum(values: DataFrame, months: int = 12, include_current: bool = False) -> DataFrame:
    """Sum of the `months` periods before each month, only where every one of them is present.

    The frame runs over a month number, so a gap stays a gap; the window is per node and measure and as long as
    the calendar.
    """
    number = F.year("period_start") * 12 + F.month("period_start")
    last = 0 if include_current else -1
    frame = Window.partitionBy("measure", "node").orderBy(number).rangeBetween(last - months + 1, last)
    rows = values.filter(F.col("dim").isNull() & (F.col("period_type") == "month"))
    return (
        rows.withColumn("total", F.sum("value").over(frame))
        .withColumn("found", F.count(F.lit(1)).over(frame))
        .select(
            "measure", "node", "period_start",
            F.when(F.col("found") == months, F.col("total")).alias("value"),
            F.when(F.col("found") < months, fixed.NOT_AVAILABLE).alias("notation"),
        )
    )
