"""Derived measures on small series with known results."""

from datetime import date

import pytest

from tallywell.operators import evaluate
from tallywell.operators.evaluate import Measure, Term
from tallywell.plans.catalog import CATALOG
from tallywell.schema import VALUE_SCHEMA

ALL = ("agency",)
STOCK = Measure("stock", "Stock", "people", "month", ALL)
FLOW = Measure("flow", "Flow", "people", "month", ALL, aggregation="sum")
QUARTERLY = Measure("quarterly", "Quarterly", "currency", "quarter", ALL)


def months(measure, values, start=(2025, 1), node="A", kind="month", step=1, notation=None):
    rows = []
    for i, v in enumerate(values):
        month = start[1] - 1 + i * step
        rows.append((measure, node, kind, date(start[0] + month // 12, month % 12 + 1, 1), None, None, v, None, notation, "src"))
    return rows


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("A", "agency"), ("S", "subelement")], "code string, kind string")


def run(spark, nodes, rows, *measures):
    catalog = {m.code: m for m in (STOCK, FLOW, QUARTERLY, *measures)}
    values = spark.createDataFrame(rows, VALUE_SCHEMA)
    out = evaluate.evaluate_all(values, nodes, catalog)
    return {(r.measure, r.node, r.period_start): r for r in out.collect() if r.source_ref == "derived"}


def test_ratio_offset_and_scale(spark, nodes):
    prior = Measure("prior", "Prior", "people", "month", ALL, pattern="time_offset", terms=(Term("stock", offset=-1),))
    rate = Measure("rate", "Rate", "percentage", "month", ALL, pattern="ratio", terms=(Term("flow"), Term("prior")))
    got = run(spark, nodes, months("stock", [1000.0, 1100.0, 1200.0]) + months("flow", [10.0, 22.0, 36.0]), prior, rate)
    feb, mar = got["rate", "A", date(2025, 2, 1)], got["rate", "A", date(2025, 3, 1)]
    assert feb.value == pytest.approx(2.2) and feb.n == 1000
    assert mar.value == pytest.approx(3600 / 1100)
    assert got["rate", "A", date(2025, 1, 1)].notation == "not_available"
    assert ("prior", "A", date(2025, 4, 1)) not in got, "nothing after the last observed month"


def test_offset_may_stand_in_the_term_itself(spark, nodes):
    rate = Measure("rate", "Rate", "percentage", "month", ALL, pattern="ratio", terms=(Term("flow"), Term("stock", offset=-1)))
    got = run(spark, nodes, months("stock", [1000.0, 1100.0, 1200.0]) + months("flow", [10.0, 22.0, 36.0]), rate)
    assert got["rate", "A", date(2025, 2, 1)].value == pytest.approx(2.2)


def test_additive_needs_every_term(spark, nodes):
    two = Measure("two", "Two months", "people", "month", ALL, pattern="additive", terms=(Term("flow", offset=-1), Term("flow", offset=-2)))
    got = run(spark, nodes, months("flow", [5.0, 7.0, 11.0, 13.0]), two)
    assert got["two", "A", date(2025, 3, 1)].value == 12 and got["two", "A", date(2025, 4, 1)].value == 18
    feb = got["two", "A", date(2025, 2, 1)]
    assert feb.value is None and feb.notation == "not_available"


def test_coarser_cadence_takes_latest_and_marks_incomplete(spark, nodes):
    per_head = Measure("per_head", "Per head", "currency", "quarter", ALL, pattern="ratio", terms=(Term("quarterly"), Term("stock")))
    rows = months("stock", [100.0, 110.0, 120.0, 130.0]) + months("quarterly", [1200.0, 1300.0], kind="quarter", step=3)
    got = run(spark, nodes, rows, per_head)
    first, second = got["per_head", "A", date(2025, 1, 1)], got["per_head", "A", date(2025, 4, 1)]
    assert first.value == 10.0 and first.notation is None and first.n == 120
    assert second.value == 10.0 and second.notation == "incomplete"


def test_zero_and_missing_denominators(spark, nodes):
    ratio = Measure("ratio", "Ratio", "ratio", "month", ALL, pattern="ratio", terms=(Term("flow"), Term("stock")))
    got = run(spark, nodes, months("flow", [1.0, 2.0]) + months("stock", [0.0]), ratio)
    for month in (1, 2):
        row = got["ratio", "A", date(2025, month, 1)]
        assert row.value is None and row.notation == "not_available"


def test_notation_first_component_then_default(spark, nodes):
    ratio = Measure("ratio", "Ratio", "ratio", "month", ALL, pattern="ratio", terms=(Term("flow"), Term("stock")), notation="estimate")
    noted = months("flow", [1.0], notation="incomplete") + months("flow", [1.0], start=(2025, 2)) + months("stock", [2.0, 2.0])
    got = run(spark, nodes, noted, ratio)
    assert got["ratio", "A", date(2025, 1, 1)].notation == "incomplete"
    assert got["ratio", "A", date(2025, 2, 1)].notation == "estimate"


def test_only_nodes_of_the_measures_kinds(spark, nodes):
    ratio = Measure("ratio", "Ratio", "ratio", "month", ALL, pattern="ratio", terms=(Term("flow"), Term("stock")))
    rows = months("flow", [1.0], node="S") + months("stock", [2.0], node="S") + months("flow", [1.0]) + months("stock", [2.0])
    assert {node for _, node, _ in run(spark, nodes, rows, ratio)} == {"A"}


def test_carry_is_bounded_and_stops_at_the_last_observation(spark, nodes):
    held = Measure("held", "Held", "people", "month", ALL, pattern="time_offset", terms=(Term("stock", carry=2),))
    rows = months("stock", [1.0]) + months("stock", [5.0], start=(2025, 6)) + months("stock", [None], start=(2025, 8)) + months("stock", [9.0], start=(2025, 10))
    got = run(spark, nodes, rows, held)
    assert {p.month: r.value for (_, _, p), r in got.items()} == {1: 1.0, 2: 1.0, 3: 1.0, 6: 5.0, 7: 5.0, 8: None, 9: None, 10: 9.0}


def test_fiscal_and_survey_years_never_mix(spark, nodes):
    survey = Measure("survey", "Survey", "index", "survey_year", ALL)
    mixed = Measure("mixed", "Mixed", "index", "fiscal_year", ALL, pattern="additive", terms=(Term("survey"),))
    with pytest.raises(ValueError):
        run(spark, nodes, months("stock", [1.0]), survey, mixed)


def test_unknown_component_is_an_error(spark, nodes):
    broken = Measure("broken", "Broken", "people", "month", ALL, pattern="additive", terms=(Term("nothing"),))
    with pytest.raises(KeyError):
        run(spark, nodes, months("stock", [1.0]), broken)


def test_derived_rows_are_replaced(spark, nodes):
    double = Measure("double", "Double", "people", "month", ALL, pattern="additive", terms=(Term("flow"), Term("flow")))
    catalog = {m.code: m for m in (FLOW, double)}
    once = evaluate.evaluate_all(spark.createDataFrame(months("flow", [3.0]), VALUE_SCHEMA), nodes, catalog)
    twice = evaluate.evaluate_all(once, nodes, catalog)
    assert [r.value for r in twice.filter("measure = 'double'").collect()] == [6.0]


def test_catalog_is_complete():
    derived = [m for m in CATALOG.values() if m.derived]
    assert len(CATALOG) == 96 and len(derived) == 33
    assert all(t.measure in CATALOG for m in derived for t in m.terms)
    assert max(evaluate.depth(CATALOG, m.code) for m in derived) == len(evaluate.levels(CATALOG)) == 2
