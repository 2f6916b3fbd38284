"""Field cleaning, names and classifiers."""

import pytest
from pyspark.sql import functions as F

from tallywell.functions import classify, clean, names


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "one, other",
    [
        ("DEPARTMENT OF TREASURY", "Department of the Treasury"),
        ("NAT AERONAUTICS AND SPACE ADMINISTRATION", "National Aeronautics and Space Administration"),
        ("U.S.AGENCY FOR INTERNATIONAL DEVELOPMENT", "U.S. Agency for International Development"),
    ],
)
def test_match_keys_agree(spark, one, other):
    assert value(spark, names.match_key(F.lit(one))) == value(spark, names.match_key(F.lit(other)))


@pytest.mark.parametrize(
    "code, bucket",
    [("11.1", "personnel"), ("12.1", "personnel"), ("11.7", "military"), ("25.1", "contracted"), ("25.2", "contracted"),
     ("25.3", "federal_services"), ("25.7", "operations_other"), ("41.0", "administered"), ("42.0", "administered"),
     ("13.0", "administered"), ("99.0", "other"), (" 11.1 ", "personnel"), ("", "other"), (None, "other")],
)
def test_object_class(spark, code, bucket):
    assert value(spark, classify.object_class(F.lit(code).cast("string"))) == bucket


@pytest.mark.parametrize(
    "text, expected",
    [("OFC OF THE U.S. TREASURY", "Office of the U.S. Treasury"), ("NAT CTR FOR HR-IT DEV", "National Center for HR-IT Development"),
     ("THE FED CORP", "The Federal Corporation")],
)
def test_title(spark, text, expected):
    assert value(spark, names.title(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("ANNA MCCARTHY", "Anna McCarthy"), ("LUDWIG VAN DER BERG", "Ludwig van der Berg"), ("JEAN O'NEIL-SMITH", "Jean O'Neil-Smith"), ("Ian deWitt", "Ian deWitt")],
)
def test_person_name(spark, text, expected):
    assert value(spark, names.person_name(F.lit(text))) == expected


def test_item_key(spark):
    assert value(spark, names.item_key(F.lit("My  agency’s “goals”. ? "))) == "my agency's \"goals\""


@pytest.mark.parametrize("bracket, floor", [("LESS THAN 20", 15), ("25-29", 25), ("65 OR MORE", 65), ("UNSPECIFIED", None), ("??", None)])
def test_age_floor(spark, bracket, floor):
    assert value(spark, clean.age_floor(F.lit(bracket))) == floor


@pytest.mark.parametrize("pay, band, strict", [("84999", "80", "80"), ("REDACTED", "R", "R"), ("", "R", None), (None, "R", None), ("x", "R", None)])
def test_pay_band_modes(spark, pay, band, strict):
    column = F.lit(pay).cast("string")
    assert value(spark, clean.pay_band(column)) == band
    assert value(spark, clean.pay_band(column, undisclosed_only=True)) == strict


def test_unit_code(spark):
    def code(unit, agency, missing=None):
        return value(spark, clean.unit_code(F.lit(unit).cast("string"), F.lit(agency).cast("string"), missing))

    assert code("AG01", "AG") == "AG01" and code("", "AG") == "AG__" and code(None, None) is None
    assert code(None, "", "UN") == "UN__"


def test_seniority_keeps_precedence(spark):
    def rank(title, appointment):
        return value(spark, classify.seniority(F.lit(title), F.lit(appointment)))

    assert rank("Secretary of State", "CA") == 0 and rank("Director", "PAS") == 0
    assert rank("Director", "CA") == 6 and rank("Administrator", "CA") == 0 and rank("Administrator, West", "CA") == 6
    assert rank("Deputy Administrator", "CA") == 1 and rank("Chief of Staff", "SC") == 3 and rank("Envoy", "PA") == 5


def test_entities_and_dates(spark):
    assert value(spark, clean.decode_entities(F.lit(" A &amp; B&#039;s "))) == "A & B's"
    assert str(value(spark, clean.us_date(F.lit("01/20/2025")))) == "2025-01-20"
    assert value(spark, clean.us_date(F.lit(""))) is None
    assert value(spark, clean.plain_number(F.lit("$1,234.5"))) == 1234.5
    assert value(spark, clean.plain_number(F.lit("n/a"))) is None


def test_location_classes(spark):
    def kind(name, country, county, state, known=True):
        return value(spark, classify.location_class(*(F.lit(x).cast("string") for x in (name, country, county, state)), F.lit(known)))

    assert kind("X", "US", "11001", "DC") == "county" and kind("X", "GM", "11001", "DC") == "abroad"
    assert kind("San Juan", "US", "", "*") == "territory" and kind("INVALID", "US", "", "") == "invalid"
    assert kind("Not disclosed", None, None, None) == "nds" and kind(None, None, None, None, False) == "invalid"
    assert kind("X", "US", "11001", "*") == "territory"
