from datetime import date

import pytest
from pyspark.sql import functions as F

from tallywell.functions import periods


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day(text):
    return F.lit(text).cast("date")


@pytest.mark.parametrize(
    "start, kind, count, expected",
    [
        ("2025-12-01", "month", 1, date(2026, 1, 1)),
        ("2025-01-01", "month", -1, date(2024, 12, 1)),
        ("2025-10-01", "quarter", 1, date(2026, 1, 1)),
        ("2025-10-01", "fiscal_year", -1, date(2024, 10, 1)),
    ],
)
def test_shift(spark, start, kind, count, expected):
    assert value(spark, periods.shift(day(start), kind, count)) == expected
    assert value(spark, periods.shift(day(start), F.lit(kind), count)) == expected


@pytest.mark.parametrize(
    "start, target, expected",
    [
        ("2025-11-01", "quarter", date(2025, 10, 1)),
        ("2025-11-01", "fiscal_year", date(2025, 10, 1)),
        ("2025-03-01", "fiscal_year", date(2024, 10, 1)),
        ("2025-03-01", "survey_year", date(2025, 1, 1)),
    ],
)
def test_containing(spark, start, target, expected):
    assert value(spark, periods.containing(day(start), target)) == expected
    assert value(spark, periods.containing_any(day(start), F.lit(target))) == expected


def test_labels(spark):
    labels = {k: value(spark, periods.period_label(F.lit(k), day("2025-10-01"))) for k in ("month", "quarter", "fiscal_year", "survey_year")}
    assert labels == {"month": "Oct 2025", "quarter": "FY2026 Q1", "fiscal_year": "FY2026", "survey_year": "2025"}


@pytest.mark.parametrize(
    "today, expected", [(date(2026, 9, 9), (2026, 3)), (date(2026, 10, 15), (2026, 4)), (date(2027, 1, 5), (2027, 1))]
)
def test_latest_closed_quarter(spark, today, expected):
    assert periods.latest_closed_quarter(today) == expected
    start = value(spark, periods.closed_quarter(day(str(today))))
    assert start == value(spark, periods.fiscal_quarter_start(F.lit(expected[0]), F.lit(expected[1])))


@pytest.mark.parametrize("year, quarter, expected", [(2026, 3, "202606"), (2026, 1, "202512")])
def test_quarter_end(spark, year, quarter, expected):
    start = periods.fiscal_quarter_start(F.lit(year), F.lit(quarter))
    assert value(spark, periods.quarter_end_month(start)) == expected


def test_quarter_range_is_inclusive(spark):
    first, last = periods.fiscal_quarter_start(F.lit(2018), F.lit(2)), periods.fiscal_quarter_start(F.lit(2019), F.lit(1))
    assert value(spark, periods.quarter_range(first, last)) == [date(2018, 1, 1), date(2018, 4, 1), date(2018, 7, 1), date(2018, 10, 1)]
