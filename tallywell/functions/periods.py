"""Period algebra as column expressions.

A period is (period_type, period_start). Fiscal years start in October, so a fiscal quarter is a calendar
quarter under another label, and fiscal year F starts in October of F - 1.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywell.fixed_values import PERIOD_MONTHS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_month_code(code: Column | str) -> Column:
    return F.length(_col(code)) == 6


def month_start(code: Column | str) -> Column:
    """'202607' -> 2026-07-01."""
    return F.to_date(F.concat(_col(code), F.lit("01")), "yyyyMMdd")


def month_code(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyyMM")


def fiscal_year(day: Column | str) -> Column:
    return F.year(F.add_months(_col(day), 3))


def fiscal_quarter(day: Column | str) -> Column:
    return F.quarter(F.add_months(_col(day), 3))


def fiscal_year_start(year: Column | str) -> Column:
    return F.make_date(_col(year) - 1, F.lit(10), F.lit(1))


def fiscal_quarter_start(year: Column | str, quarter: Column | str) -> Column:
    return F.add_months(fiscal_year_start(year), ((_col(quarter) - 1) * 3).cast("int"))


def survey_year_start(year: Column | str) -> Column:
    return F.make_date(_col(year), F.lit(1), F.lit(1))


def step_months(period_type: Column | str) -> Column:
    """Months in one period of the type held in a column."""
    out = None
    for name, months in PERIOD_MONTHS.items():
        test = _col(period_type) == name
        out = F.when(test, months) if out is None else out.when(test, months)
    return out


def shift(day: Column | str, period_type: str | Column, count: int | Column) -> Column:
    """Move a period start by `count` periods of its own type."""
    months = F.lit(PERIOD_MONTHS[period_type]) if isinstance(period_type, str) else step_months(period_type)
    return F.add_months(_col(day), (months * count).cast("int"))


def containing(day: Column | str, target: str) -> Column:
    """Start of the coarser period that holds `day`."""
    day = _col(day)
    if target == "month":
        return F.trunc(day, "month")
    if target == "quarter":
        return F.trunc(day, "quarter")
    if target == "fiscal_year":
        return fiscal_year_start(fiscal_year(day))
    if target == "survey_year":
        return F.trunc(day, "year")
    raise ValueError(f"no such period type: {target}")


def containing_any(day: Column | str, target: Column | str) -> Column:
    """`containing` with the target type in a column."""
    out = None
    for name in PERIOD_MONTHS:
        test = _col(target) == name
        value = containing(day, name)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def period_label(period_type: Column | str, day: Column | str) -> Column:
    """'Jul 2026', 'FY2026 Q3', 'FY2026' or '2026'."""
    kind, day = _col(period_type), _col(day)
    year = F.concat(F.lit("FY"), fiscal_year(day).cast("string"))
    return (
        F.when(kind == "month", F.date_format(day, "MMM yyyy"))
        .when(kind == "quarter", F.concat(year, F.lit(" Q"), fiscal_quarter(day).cast("string")))
        .when(kind == "fiscal_year", year)
        .otherwise(F.date_format(day, "yyyy"))
    )


def closed_quarter(today: Column | str) -> Column:
    """Start date of the most recent fiscal quarter that has ended by `today`."""
    return F.add_months(F.trunc(_col(today), "quarter"), -3)


def latest_closed_quarter(today: date) -> tuple[int, int]:
    """(fiscal year, quarter) of the last closed quarter, for parameters fixed before a job starts."""
    start_month = 3 * ((today.month - 1) // 3) + 1
    year, month = (today.year, start_month - 3) if start_month > 3 else (today.year - 1, 10)
    return (year + 1, 1) if month == 10 else (year, (month - 1) // 3 + 2)


def quarter_end_month(quarter_start: Column | str) -> Column:
    """yyyymm of the last month of a quarter."""
    return month_code(F.add_months(_col(quarter_start), 2))


def year_before(code: Column | str) -> Column:
    """The same month a year earlier, as yyyymm."""
    return month_code(F.add_months(month_start(code), -12))


def quarter_range(first: Column | str, last: Column | str) -> Column:
    """Array of quarter starts from first to last, both included."""
    return F.sequence(_col(first), _col(last), F.expr("interval 3 months"))


def since(df: DataFrame, start: date | str, period: str = "period_start") -> DataFrame:
    return df.filter(F.col(period) >= F.lit(str(start)).cast("date"))


def axis(df: DataFrame, keys: tuple[str, ...] = ("period_type",), period: str = "period_start") -> DataFrame:
    """Sorted distinct periods per type; an axis is bounded by the calendar, never by the data."""
    return (
        df.select(*keys, period)
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(period)).alias("axis"))
    )


def last_periods(df: DataFrame, count: int, period_type: str = "month") -> DataFrame:
    """Rows in the last `count` steps of the axis, counting back from its end; all rows if the axis is shorter."""
    periods = F.col("axis")
    cut = (
        axis(df.filter(F.col("period_type") == period_type))
        .select(F.element_at(periods, F.greatest(F.size(periods) - count, F.lit(1))).alias("cut"))
        .scalar()
    )
    return df.filter((F.col("period_type") == period_type) & (F.col("period_start") >= cut))
