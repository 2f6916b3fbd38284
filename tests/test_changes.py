"""Restated months: the updated table equals a full build, and little of it was computed again."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallywell.operators.evaluate import Measure, Term
from tallywell.plans import changes, registry
from tallywell.schema import VALUE_COLUMNS, VALUE_SCHEMA
from tallywell.session import materialise

LEVELS = ("gov", "department", "agency", "subelement")
CATALOG = {
    m.code: m
    for m in (
        Measure("headcount", "People", "people", "month", (*LEVELS, "group")),
        Measure("quits", "Quits", "people", "month", LEVELS, since="2024-01-01", aggregation="sum"),
        Measure("hires", "Hires", "people", "month", LEVELS, since="2024-03-01", aggregation="sum"),
        Measure("money", "Money", "currency", "quarter", ("group",)),
        Measure("prior", "The month before", "people", "month", LEVELS, pattern="time_offset", terms=(Term("headcount", offset=-1, carry=2),)),
        Measure("quit_rate", "Quits of the month before", "percentage", "month", LEVELS, pattern="ratio", terms=(Term("quits"), Term("prior"))),
        Measure("net", "Hires less quits", "people", "month", LEVELS, pattern="additive", terms=(Term("hires"), Term("quits", -1))),
        Measure("last_three", "Hires of three months", "people", "month", LEVELS, pattern="additive", terms=tuple(Term("hires", offset=-k) for k in (1, 2, 3))),
        Measure("quarter_quits", "Quits of a quarter", "people", "quarter", LEVELS, pattern="additive", terms=(Term("quits"),)),
        Measure("per_head", "Money a head", "currency", "quarter", ("group",), pattern="ratio", terms=(Term("money"), Term("headcount"))),
    )
}
MONTHS = [date(2024, m, 1) for m in range(1, 13)] + [date(2025, m, 1) for m in range(1, 7)]
AGENCIES = ["AA", "BB", "CC", "DD"]


def record(measure, node, month, value, version=1, dim=None, dim_value=None):
    return (measure, node, "month", month, dim, dim_value, float(value), None, None, f"fwd:employment_{month:%Y%m}_{version}")


def base_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for agency in AGENCIES:
        for unit in ("01", "02"):
            for month in MONTHS:
                if r.random() < 0.85:
                    rows.append(record("headcount", agency + unit, month, r.randrange(5, 50)))
                for flow in ("quits", "hires"):
                    if r.random() < 0.4:
                        rows.append(record(flow, agency + unit, month, r.randrange(1, 4)))
        for month in MONTHS:
            rows.append(record("headcount", agency, month, r.randrange(5, 50), dim="grade", dim_value=r.choice("ab")))
    return rows


def sources(spark, rows, money=1.0):
    nodes = [("gov", "gov"), ("D:1", "department"), ("D:2", "department"), ("g1", "group"), ("g2", "group")]
    nodes += [(a, "agency") for a in AGENCIES] + [(a + u, "subelement") for a in AGENCIES for u in ("01", "02")]
    other = [("money", g, "quarter", date(2024, m, 1), None, None, money * m if g == "g1" else 7.0 * m, None, None, "m") for g in ("g1", "g2") for m in (1, 4, 7, 10)]
    return registry.Sources(
        materialise(spark.createDataFrame(rows, VALUE_SCHEMA), "extracts"),
        spark.createDataFrame(nodes, "code string, kind string"),
        spark.createDataFrame([("AA", "D:1"), ("BB", "D:1"), ("CC", "D:2"), ("DD", None)], "agency string, dept string"),
        spark.createDataFrame([("g1", "AA", 1), ("g1", "AA01", -1), ("g2", "CC", 1)], "gid string, code string, sign int"),
        [spark.createDataFrame(other, VALUE_SCHEMA)],
    )


def cut(df):
    return materialise(df, "build")


def restated(rows, agency, month, change):
    """The month's rows of an agency under a new version, with values changed."""
    out = []
    for row in rows:
        if row[1][:2] == agency and row[3] == month:
            value = change(row)
            out += [(*row[:6], float(value), None, None, f"fwd:employment_{month:%Y%m}_2")] if value is not None else []
        else:
            out.append(row)
    return out


def table(df):
    return sorted((tuple(r) for r in df.select(*VALUE_COLUMNS).collect()), key=str)


def lost(rows):
    return restated(rows, "CC", date(2024, 9, 1), lambda r: None if r[0] != "hires" else r[6])


def empty(rows):
    return restated(rows, "DD", date(2024, 3, 1), lambda r: None)


def late(rows):
    more = [record("quits", "BB02", date(2024, 2, 1), 9, 3), record("hires", "CC01", date(2024, 11, 1), 2, 3), record("headcount", "DD02", date(2024, 1, 1), 3, 9)]
    return restated([*rows, *more], "AA", date(2024, 6, 1), lambda r: r[6])


CASES = {
    "a month that lost rows and one without rows": lambda rows: empty(lost(rows)),
    "late actions and a version with the same values": late,
    "a new last month": lambda rows: [*rows, record("headcount", "AA01", date(2025, 7, 1), 5), record("quits", "AA01", date(2025, 8, 1), 1)],
    "the last month gone, and observations that others rested on": lambda rows: [
        r for r in rows if r[3] < date(2025, 6, 1) and not (r[1] == "AA02" and date(2024, 5, 1) <= r[3] <= date(2024, 7, 1))],
    "a flow gone": lambda rows: [r for r in rows if r[0] != "hires"],
}


@pytest.fixture(scope="module")
def built(spark):
    given = sources(spark, base_rows())
    return given, materialise(registry.build_values(given, CATALOG, cut), "old")


@pytest.mark.parametrize("case", CASES)
def test_update_equals_a_full_build(spark, built, case):
    given, old = built
    now = sources(spark, CASES[case](base_rows()), 2.0 if case.startswith("late") else 1.0)
    update = changes.update_values(old, given.extracts, now, CATALOG, cut)
    assert table(update.values) == table(registry.build_values(now, CATALOG, cut))


def test_only_what_a_change_reaches_is_computed(spark, built):
    given, old = built
    month = next(r[3] for r in base_rows() if r[0] == "quits" and r[1] == "BB01" and r[3] > date(2024, 4, 1))
    now = sources(spark, restated(base_rows(), "BB", month, lambda r: r[6] + (r[0] == "quits" and r[1] == "BB01")))
    update = changes.update_values(old, given.extracts, now, CATALOG, cut)
    derived = update.rows.filter("source_ref = 'derived' AND measure = 'quarter_quits'")
    assert {r["node"] for r in derived.collect()} <= {"BB01", "BB", "D:1", "gov"}
    assert {r["period_start"] for r in derived.collect()} == {date(month.year, (month.month - 1) // 3 * 3 + 1, 1)}
    # The other version of the month moves nothing but quits: no carried headcount, no group is looked at.
    assert update.rows.filter("measure IN ('prior', 'per_head')").isEmpty()
    assert update.rows.count() < 0.05 * old.count()


def test_files_that_were_loaded_anew_are_enough(spark, built):
    """Old rows of the restated months alone, as a load has them, with the extracts as they are now."""
    given, old = built
    rows = restated(base_rows(), "BB", date(2024, 6, 1), lambda r: r[6] * 2)
    now = sources(spark, rows)
    month = F.col("period_start") == F.lit("2024-06-01").cast("date")
    update = changes.update_values(old, given.extracts.filter(month), now, CATALOG, cut, after=now.extracts.filter(month))
    assert table(update.values) == table(registry.build_values(now, CATALOG, cut))


def test_without_a_change_nothing_is_computed(spark, built):
    given, old = built
    update = changes.update_values(old, given.extracts, sources(spark, base_rows()), CATALOG, cut)
    assert update.rows.isEmpty() and table(update.values) == table(old)
