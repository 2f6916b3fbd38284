"""Classifiers: ordered rules as conditional expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywell import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def object_class(code: Column | str) -> Column:
    """Spending bucket of an object class. The first rule that fits decides."""
    code = F.trim(F.coalesce(_col(code), F.lit("")))
    return (
        F.when(code.isin(*fixed.PERSONNEL_CLASSES), "personnel")
        .when(code.isin(*fixed.MILITARY_CLASSES), "military")
        .when(code.isin(*fixed.CONTRACTED_CLASSES), "contracted")
        .when(code.isin(*fixed.FEDERAL_SERVICE_CLASSES), "federal_services")
        .when(code.isin(*fixed.ADMINISTERED_CLASSES), "administered")
        .when(F.substring(code, 1, 2).isin(*fixed.OPERATIONS_PREFIXES), "operations_other")
        .otherwise("other")
    )


def appointment_label(code: Column | str) -> Column:
    labels = F.create_map(*[F.lit(x) for c, label, _ in fixed.APPOINTMENTS for x in (c, label)])
    return F.coalesce(F.try_element_at(labels, _col(code)), _col(code))


def appointment_class(code: Column | str) -> Column:
    classes = F.create_map(*[F.lit(x) for c, _, kind in fixed.APPOINTMENTS for x in (c, kind)])
    return F.coalesce(F.try_element_at(classes, _col(code)), F.lit("career"))


POLITICAL_CODES = tuple(code for code, _, kind in fixed.APPOINTMENTS if kind == "political")


def is_political(code: Column | str) -> Column:
    return _col(code).isin(*POLITICAL_CODES)


def location_class(
    name: Column | str, country: Column | str, county: Column | str, state: Column | str, known: Column | str
) -> Column:
    """nds, abroad, county, territory or invalid, from a duty-station lookup entry; `known` is false if there is none."""
    name, country, county, state = (_col(c) for c in (name, country, county, state))
    is_county = county.rlike(r"^\d{5}$") & (state != "") & (state != "*")
    return (
        F.when(~_col(known), "invalid")
        .when(name == "Not disclosed", "nds")
        .when((country != "") & (country != "US"), "abroad")
        .when(is_county, "county")
        .when((country == "US") & (name != "") & (name != "INVALID"), "territory")
        .otherwise("invalid")
    )


def seniority(title: Column | str, appointment: Column | str) -> Column:
    """0 (head) to 6, from title and appointment type. 'ADMINISTRATOR' and 'DIRECTOR' must match in full."""
    title, appointment = F.upper(_col(title)), _col(appointment)

    def starts(*words: str) -> Column:
        return title.rlike("^(" + "|".join(words) + ")")

    head = starts("SECRETARY", "ATTORNEY GENERAL") | (title == "ADMINISTRATOR")
    return (
        F.when(head | ((title == "DIRECTOR") & (appointment == "PAS")), 0)
        .when(starts("DEPUTY SECRETARY", "DEPUTY ATTORNEY GENERAL", "DEPUTY ADMINISTRATOR"), 1)
        .when(starts("UNDER SECRETARY", "ASSOCIATE ATTORNEY GENERAL"), 2)
        .when(starts("ASSISTANT SECRETARY", "GENERAL COUNSEL", "INSPECTOR GENERAL", "CHIEF"), 3)
        .when(appointment == "PAS", 4)
        .when(appointment.isin("PA", "NA"), 5)
        .otherwise(6)
    )


def money_reason(mapped: Column, reported: Column) -> Column:
    """Why a unit has no money figures; null if it has."""
    return F.when(~mapped, "no agency mapped").when(~reported, "no obligations reported")


def dim_label(dim: Column | str, value: Column | str, label: Column | str) -> Column:
    """Label of a dimension value: fixed labels first, then the lookup's, then the code itself."""
    dim, value = _col(dim), _col(value)
    return (
        F.when(value == fixed.OTHER, "All other")
        .when(value == fixed.BLANK, "Not reported")
        .when((dim == "pay_band") & (value == fixed.REDACTED_BAND), "Redacted")
        .when(dim == "pay_band", F.concat(F.lit("$"), value, F.lit("k")))
        .otherwise(F.coalesce(_col(label), value))
    )


def dim_order(value: Column | str) -> Column:
    """Sort key: numbers by size, then text, the redacted band after all others."""
    value = _col(value)
    number = F.regexp_extract(value, r"^(\d+)", 1).try_cast("int")
    group = F.when(value == fixed.REDACTED_BAND, 2).when(number.isNull(), 1).otherwise(0)
    return F.struct(group.alias("group"), number.alias("number"), value.alias("text"))
