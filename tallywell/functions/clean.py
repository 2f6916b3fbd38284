"""Cleaning of raw string columns, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def redacted_to_undisclosed(c: Column | str) -> Column:
    return F.when(_col(c) == fixed.REDACTED, fixed.NOT_DISCLOSED).otherwise(_col(c))


def unit_code(
    unit: Column | str = "agency_subelement_code",
    agency: Column | str = "agency_code",
    missing_agency: str | None = None,
) -> Column:
    """Sub-element code; a blank one becomes '<agency>__' so the prefix still names the agency.

    `missing_agency` also replaces a blank agency; without it such a row has no unit.
    """
    agency = _col(agency)
    if missing_agency is not None:
        agency = F.coalesce(blank_to_null(agency), F.lit(missing_agency))
    return F.coalesce(blank_to_null(unit), F.concat(agency, F.lit("__")))


def disclosed_pay(pay: Column | str = "annualized_adjusted_basic_pay") -> Column:
    """Pay as a number. The usual non-numbers are sorted out first: a failed parse costs far more than a comparison."""
    pay = _col(pay)
    return F.when(~pay.isin(fixed.REDACTED, ""), pay.try_cast("double"))


def pay_band(pay: Column | str = "annualized_adjusted_basic_pay", undisclosed_only: bool = False) -> Column:
    """Lower bound of the $10k band in thousands.

    Everything without a number becomes 'R'; with `undisclosed_only` that holds for redacted values alone and
    other unreadable pay stays null, which is the rule of the monthly fact grain.
    """
    amount = disclosed_pay(pay)
    band = (F.floor(amount / 10_000) * 10).cast("int").cast("string")
    if undisclosed_only:
        return F.when(_col(pay) == fixed.REDACTED, fixed.REDACTED_BAND).otherwise(band)
    return F.coalesce(band, F.lit(fixed.REDACTED_BAND))


def age_floor(bracket: Column | str = "age_bracket") -> Column:
    """Lower bound of an age bracket."""
    bracket = _col(bracket)
    return (
        F.when(bracket == fixed.YOUNGEST_BRACKET, 15)
        .when(bracket == fixed.OLDEST_BRACKET, 65)
        .when(bracket == fixed.NO_BRACKET, None)
        .otherwise(F.substring(bracket, 1, 2).try_cast("int"))
    )


def service_years(c: Column | str = "length_of_service_years") -> Column:
    c = _col(c)
    return F.when(~c.isin(fixed.REDACTED, ""), c.try_cast("double"))


def multiplicity(c: Column | str = "count") -> Column:
    """People a record stands for; a record without a count is an error, so the cast is strict."""
    return _col(c).cast("int")


def dim_value(c: Column | str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(fixed.BLANK))


def prefix_key(c: Column | str, length: int = 2) -> Column:
    return F.substring(_col(c), 1, length)


def below_prefix(c: Column | str, prefix: str) -> Column:
    """Node filter of a user's question: the node itself and all codes below it."""
    return _col(c).startswith(prefix)


def plain_number(c: Column | str) -> Column:
    """'$1,234.5' -> 1234.5, anything else null."""
    return F.trim(F.translate(_col(c), ",$", "")).try_cast("double")


def us_date(c: Column | str) -> Column:
    """mm/dd/yyyy to a date; blank or unreadable gives null."""
    return F.try_to_date(F.trim(_col(c)), "M/d/yyyy")


def decode_entities(c: Column | str) -> Column:
    """Trim, then replace the four entities the rosters use, in their fixed order."""
    return reduce(
        lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), fixed.HTML_ENTITIES, F.trim(_col(c))
    )


def full_name(*parts: Column | str) -> Column:
    """Non-empty parts joined by a blank; null if none is left."""
    return blank_to_null(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def display_round(value: Column | str) -> Column:
    """Two places from 100 up, else four; halves to even."""
    value = _col(value)
    return F.when(F.abs(value) >= 100, F.bround(value, 2)).otherwise(F.bround(value, 4))


def scaled(value: Column | str, unit: Column | str) -> Column:
    """A ratio in its display unit: percentages by 100, rates by 1000."""
    unit = _col(unit)
    factor = F.lit(1.0)
    for name, scale in fixed.UNIT_SCALE.items():
        factor = F.when(unit == name, scale).otherwise(factor)
    return _col(value) * factor
