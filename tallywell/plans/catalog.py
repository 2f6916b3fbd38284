"""The measure catalog: what each measure is, where it exists and, if derived, how it follows from others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywell.operators.evaluate import Measure, Term, depth
from tallywell.session import literal_table

WORKFORCE = ("gov", "department", "agency", "subelement")
GROUPS = ("group",)
AGENCIES = ("gov", "department", "agency", "subelement")

_STOCK = (
    ("headcount", "Employees on the rolls"),
    ("supervisors", "Supervisors and managers"),
    ("permanent_employees", "Permanent appointments"),
    ("temporary_employees", "Temporary and term appointments"),
    ("fulltime_employees", "Full-time schedules"),
    ("gs_employees", "General Schedule employees"),
    ("gs13_plus_employees", "General Schedule grade 13 and above"),
    ("under_30", "Employees under 30"),
    ("age_55_plus", "Employees aged 55 and over"),
    ("retirement_eligible", "Estimated retirement-eligible"),
    ("bachelors_plus", "Bachelor's degree or higher"),
    ("service_years_total", "Years of service, total"),
    ("pay_total", "Annual basic pay, total of the disclosed"),
    ("pay_disclosed_employees", "Employees with disclosed pay"),
    ("location_disclosed_employees", "Employees with a disclosed location"),
    ("veterans", "Veterans"),
    ("stem_employees", "STEM occupations"),
    ("bargaining_unit_employees", "In a bargaining unit"),
    ("bargaining_disclosed_employees", "Bargaining status disclosed"),
)
_FLOWS = (
    ("accessions", "All accessions", "2005-01-01"),
    ("new_hires", "New hires", "2005-01-01"),
    ("transfers_in", "Transfers in", "2005-01-01"),
    ("separations", "All separations", "2005-01-01"),
    ("quits", "Quits", "2005-01-01"),
    ("retirements", "Retirements", "2005-01-01"),
    ("rifs", "Reductions in force", "2005-01-01"),
    ("transfers_out", "Transfers out", "2005-01-01"),
    ("terminations", "Terminations", "2005-01-01"),
    ("deferred_resignations", "Deferred resignations", "2025-01-01"),
    ("first_year_separations", "Separations within the first year", "2005-01-01"),
)
_MONEY = (
    ("personnel_obligations", "Personnel"),
    ("military_personnel_obligations", "Military personnel"),
    ("contracted_services_obligations", "Contracted services"),
    ("federal_services_obligations", "Services bought from other agencies"),
    ("administered_obligations", "Administered payments"),
    ("operations_obligations", "Operations"),
)
_SURVEY = (
    ("fevs_engagement", "index"), ("fevs_global_satisfaction", "index"), ("fevs_performance_confidence", "index"),
    ("fevs_leave_any", "percentage_points"), ("fevs_leave_outside", "percentage_points"),
    ("fevs_leave_within", "percentage_points"), ("fevs_leave_other", "percentage_points"),
    ("fevs_pay_satisfaction", "percentage_points"), ("fevs_recommend", "percentage_points"),
    ("fevs_workload_reasonable", "percentage_points"),
    ("va_aes_recommend", "percentage_points"), ("va_aes_job_satisfaction", "percentage_points"),
    ("va_aes_pay_satisfaction", "percentage_points"), ("va_aes_org_satisfaction", "percentage_points"),
    ("va_aes_workload_reasonable", "percentage_points"), ("va_aes_encouraged", "percentage_points"),
    ("va_aes_accomplishment", "percentage_points"), ("va_aes_talents_used", "percentage_points"),
    ("va_aes_engagement", "index"),
)
_ROSTER = ("plum_positions", "plum_filled", "plum_vacant", "plum_political", "plum_career")
_INJURY = ("osha_total_case_rate", "osha_lost_time_case_rate")

_HEADCOUNT_DIMS = ("grade", "age_bracket", "supervisory", "appointment_type", "pay_band", "work_schedule", "series", "step")
_SHARES = (
    ("supervisor_share", "supervisors", "process", None),
    ("permanent_share", "permanent_employees", "input", None),
    ("temp_share", "temporary_employees", "input", None),
    ("fulltime_share", "fulltime_employees", "input", None),
    ("under_30_share", "under_30", "contextual", None),
    ("age_55_plus_share", "age_55_plus", "contextual", None),
    ("retirement_eligible_share", "retirement_eligible", "outcome", "estimate"),
    ("bachelors_plus_share", "bachelors_plus", "input", None),
    ("pay_disclosed_share", "pay_disclosed_employees", "contextual", None),
    ("location_disclosed_share", "location_disclosed_employees", "contextual", None),
    ("veteran_share", "veterans", "input", None),
    ("stem_share", "stem_employees", "input", None),
)
_RATES = (
    ("quit_rate", "quits"), ("retirement_rate", "retirements"), ("separation_rate", "separations"),
    ("rif_rate", "rifs"), ("accession_rate", "accessions"), ("transfer_out_rate", "transfers_out"),
)


def _title(code: str) -> str:
    return code.replace("_", " ").capitalize()


def _ratio(code: str, num: Term | str, den: Term | str, unit: str = "percentage", cadence: str = "month",
           levels: tuple[str, ...] = WORKFORCE, category: str = "input", notation: str | None = None) -> Measure:
    terms = tuple(Term(t) if isinstance(t, str) else t for t in (num, den))
    return Measure(code, _title(code), unit, cadence, levels, category, pattern="ratio", terms=terms,
                   aggregation="average", notation=notation)


def _sum(code: str, *terms: Term, unit: str = "people", cadence: str = "month", levels: tuple[str, ...] = WORKFORCE,
         category: str = "output", display: bool = True) -> Measure:
    return Measure(code, _title(code), unit, cadence, levels, category, pattern="additive", terms=terms,
                   aggregation="sum", display=display)


def build_catalog() -> dict[str, Measure]:
    base: list[Measure] = []
    for code, title in _STOCK:
        dims = _HEADCOUNT_DIMS if code == "headcount" else ()
        unit = {"service_years_total": "years", "pay_total": "currency"}.get(code, "people")
        base.append(Measure(code, title, unit, "month", (*WORKFORCE, *GROUPS) if code == "headcount" else WORKFORCE, dimensions=dims))
    for code, title, since in _FLOWS:
        dims = {"accessions": ("accession_category",), "separations": ("separation_category",)}.get(code, ())
        base.append(Measure(code, title, "people", "month", WORKFORCE, "output", since, "sum", dimensions=dims))
    base += [Measure(code, title, "currency", "quarter", GROUPS, since="2017-10-01") for code, title in _MONEY]
    base.append(Measure("omb_fte", "Full-time equivalents", "people", "fiscal_year", GROUPS, since="2023-10-01"))
    base += [Measure(code, _title(code), unit, "survey_year", AGENCIES, "outcome", "2018-01-01", "average") for code, unit in _SURVEY]
    base += [Measure(code, _title(code), "people", "month", AGENCIES, "input", "2026-01-01") for code in _ROSTER]
    base += [Measure(code, _title(code), "per_hundred", "fiscal_year", AGENCIES, "outcome", "2010-10-01", "average") for code in _INJURY]

    prior = "headcount_prior_month"
    derived = [_ratio(code, part, "headcount", category=category, notation=note) for code, part, category, note in _SHARES]
    derived += [
        _ratio("gs13_plus_share", "gs13_plus_employees", "gs_employees"),
        _ratio("bargaining_unit_share", "bargaining_unit_employees", "bargaining_disclosed_employees", category="process"),
        _sum("non_supervisors", Term("headcount"), Term("supervisors", -1), category="input", display=False),
        _ratio("span_of_control", "non_supervisors", "supervisors", unit="ratio", category="process"),
        _ratio("avg_service_years", "service_years_total", "headcount", unit="years", category="contextual"),
        _ratio("avg_pay", "pay_total", "pay_disclosed_employees", unit="currency"),
        Measure(prior, "Headcount of the month before", "people", "month", WORKFORCE, pattern="time_offset",
                terms=(Term("headcount", offset=-1, carry=2),), display=False),
    ]
    derived += [_ratio(code, part, prior, category="outcome") for code, part in _RATES]
    derived += [
        _sum("net_change", Term("accessions"), Term("separations", -1)),
        _sum("accessions_trailing_12", *[Term("accessions", offset=-k) for k in range(1, 13)], display=False),
        _ratio("first_year_attrition_rate", "first_year_separations", "accessions_trailing_12", category="outcome"),
        _sum("total_actions", Term("accessions"), Term("separations"), display=False),
        _ratio("churn", "total_actions", prior, category="outcome"),
        _sum("personnel_plus_contracted", Term("personnel_obligations"), Term("contracted_services_obligations"),
             unit="currency", cadence="quarter", levels=GROUPS, display=False),
        _ratio("insourcing_ratio", "personnel_obligations", "personnel_plus_contracted", unit="ratio", cadence="quarter", levels=GROUPS),
        _ratio("personnel_per_head", "personnel_obligations", "headcount", unit="currency", cadence="quarter", levels=GROUPS),
    ]
    return {m.code: m for m in (*base, *derived)}


CATALOG = build_catalog()


def flows(catalog=None) -> list[tuple[str, str]]:
    """(code, first month) of the monthly base flows."""
    catalog = CATALOG if catalog is None else catalog
    return [(m.code, m.since) for m in catalog.values() if not m.derived and m.aggregation == "sum" and m.cadence == "month"]


def shown(catalog=None, cadence: str | None = None) -> list[str]:
    catalog = CATALOG if catalog is None else catalog
    return [m.code for m in catalog.values() if m.display and (cadence is None or m.cadence == cadence)]


def as_table(spark: SparkSession, catalog=None) -> DataFrame:
    """The catalog as rows, one per measure, with its depth in the calculations."""
    catalog = CATALOG if catalog is None else catalog
    return literal_table(
        spark,
        "code string, title string, unit string, cadence string, category string, since string, aggregation string, "
        "pattern string, level int, display boolean, levels array<string>, components array<string>",
        [
            (m.code, m.title, m.unit, m.cadence, m.category, m.since, m.aggregation, m.pattern, depth(catalog, m.code),
             m.display, list(m.levels), [t.measure for t in m.terms])
            for m in catalog.values()
        ],
    )
