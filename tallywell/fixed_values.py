"""Fixed values.

Everything in this file is a constant that published results depend on: sentinels, code lists, word lists,
thresholds and formats. They are data, not design, and stay as the sources define them.
"""

# Sentinels in raw records and in the value table.
REDACTED = "REDACTED"
NOT_DISCLOSED = "NDS"
UNKNOWN_AGENCY = "UN"
REDACTED_BAND = "R"
BLANK = "_blank"
OTHER = "_other"
NO_NAME = ("", "NO DATA REPORTED")
UNNAMED_UNIT = "UNSPECIFIED SUB-ELEMENT"

# Notation vocabulary.
ESTIMATE = "estimate"
INCOMPLETE = "incomplete"
SUPPRESSED = "suppressed"
NOT_AVAILABLE = "not_available"

# File naming: dataset, month and version.
RECORD_FILE_PATTERN = r"(employment|accessions|separations)_(\d{6})_(\d+)"
ROSTER_FILE_PATTERN = r"plum_(\d{4}-\d{2}-\d{2})"

# Columns every era of the record files carries.
CORE_EMPLOYMENT = (
    "agency_code", "agency_subelement_code", "count", "snapshot_yyyymm", "age_bracket", "grade",
    "pay_plan_code", "appointment_type_code", "supervisory_status_code", "work_schedule_code",
    "education_level_code", "length_of_service_years", "annualized_adjusted_basic_pay",
)
CORE_ACTIONS = (
    "agency_code", "agency_subelement_code", "count", "personnel_action_effective_date_yyyymm",
    "length_of_service_years",
)

# Monthly fact grain: raw column to fact column.
COMMON_DIMS = {
    "agency_subelement_code": "org_code",
    "duty_station_code": "duty_station_code",
    "occupational_series_code": "series_code",
    "pay_plan_code": "pay_plan_code",
    "grade": "grade",
    "step_or_rate_type_code": "step_code",
    "supervisory_status_code": "supervisory_code",
    "work_schedule_code": "work_schedule_code",
    "appointment_type_code": "appointment_type_code",
    "position_occupied_code": "position_occupied_code",
    "tenure_code": "tenure_code",
    "age_bracket": "age_bracket",
    "education_level_bracket": "education_bracket",
    "veteran_indicator": "veteran",
    "flsa_category_code": "flsa_code",
    "pay_basis_code": "pay_basis_code",
}
DATASET_DIMS = {
    "employment": {"snapshot_yyyymm": "snapshot_yyyymm"},
    "accessions": {
        "personnel_action_effective_date_yyyymm": "effective_yyyymm",
        "accession_category_code": "accession_category_code",
        "pathways_group": "pathways_group",
    },
    "separations": {
        "personnel_action_effective_date_yyyymm": "effective_yyyymm",
        "separation_category_code": "separation_category_code",
        "drp_indicator": "drp_indicator",
    },
}

# Code lists behind the base measures.
SUPERVISOR_CODES = ("2", "4", "5")
PERMANENT_CODES = ("10", "15", "30", "32", "35", "36", "38", "50", "55", "67")
TEMPORARY_CODES = ("20", "40", "42", "44", "45", "46", "48", "60", "65", "68")
FULLTIME_CODES = ("F", "G")
SENIOR_GRADES = ("13", "14", "15")
DEGREE_CODES = ("13", "22")
NEW_HIRE_CODES = ("AC", "AD", "AE")
TRANSFER_IN_CODES = ("AA", "AB")
QUIT_CODES = ("SC",)
RETIREMENT_CODES = ("SD", "SE", "SG")
RIF_CODES = ("SH",)
TRANSFER_OUT_CODES = ("SA", "SB")
TERMINATION_CODES = ("SJ", "SL")
YOUNGEST_BRACKET, OLDEST_BRACKET, NO_BRACKET = "LESS THAN 20", "65 OR MORE", "UNSPECIFIED"

# Retirement eligibility: lower age bound and years of service, any pair suffices.
RETIREMENT_RULES = ((62, 5), (60, 20), (55, 30))

# Object classes of obligations.
PERSONNEL_CLASSES = ("11.1", "11.3", "11.5", "11.8", "11.9", "12.1")
MILITARY_CLASSES = ("11.7", "12.2")
CONTRACTED_CLASSES = ("25.1", "25.2")
FEDERAL_SERVICE_CLASSES = ("25.3",)
ADMINISTERED_CLASSES = ("41.0", "42.0", "43.0", "44.0", "33.0", "94.0", "13.0")
OPERATIONS_PREFIXES = ("11", "12", "21", "22", "23", "24", "25", "26", "31", "32")
MONEY_MEASURES = {
    "personnel_obligations": ("personnel",),
    "military_personnel_obligations": ("military",),
    "contracted_services_obligations": ("contracted",),
    "federal_services_obligations": ("federal_services",),
    "administered_obligations": ("administered",),
    "operations_obligations": ("personnel", "military", "contracted", "federal_services", "operations_other"),
}

# Survey answers and index items (2019 item numbers), and leaving codes per year.
POSITIVE_ANSWERS = ("4", "5")
VALID_ANSWERS = ("1", "2", "3", "4", "5")
LEAVING_ANSWERS = ("A", "B", "C", "D")
ENGAGEMENT_ITEMS_2019 = {
    "leaders": ("Q53", "Q54", "Q56", "Q60", "Q61"),
    "supervisors": ("Q47", "Q48", "Q49", "Q51", "Q52"),
    "intrinsic": ("Q3", "Q4", "Q6", "Q11", "Q12"),
}
LEAVING_CODES = {
    2019: {"no": "A", "within": "B", "outside": "C", "other": "D"},
    2020: {"no": "A", "other": "B", "within": "C", "outside": "D"},
    2021: {"no": "A", "other": "B", "within": "C", "outside": "D"},
    2022: {"no": "A", "other": "B", "within": "C", "outside": "D"},
    2023: {"no": "A", "other": "B", "within": "C", "outside": "D"},
}
SURVEY_COLUMNS = {
    "fevs_engagement": "eei",
    "fevs_global_satisfaction": "gsi",
    "fevs_performance_confidence": "pci",
    "fevs_leave_any": "leave_any",
    "fevs_leave_outside": "leave_outside",
    "fevs_leave_within": "leave_within",
    "fevs_leave_other": "leave_other",
    "fevs_pay_satisfaction": "pp_pay_sat",
    "fevs_recommend": "pp_recommend",
    "fevs_workload_reasonable": "pp_workload",
}
POOLED_UNIT, WHOLE_UNIT = "XX", "ALL"
RESIDUAL_SUFFIX = "ZZ"

# Appointment types of leadership positions: code, label, class.
APPOINTMENTS = (
    ("PAS", "Presidential appointment with Senate confirmation", "political"),
    ("PA", "Presidential appointment", "political"),
    ("SC", "Schedule C", "political"),
    ("NA", "Noncareer SES", "political"),
    ("TA", "Time-limited SES", "political"),
    ("CA", "Career", "career"),
    ("XS", "Excepted service", "career"),
    ("CG", "Career SES, general", "career"),
    ("DA", "Other", "career"),
)
HTML_ENTITIES = (("&#039;", "'"), ("&amp;", "&"), ("&quot;", '"'), ("&nbsp;", " "))

# Organisation-name matching.
NAME_ABBREVIATIONS = {
    "NAT": "NATIONAL", "DEVELOPM": "DEVELOPMENT", "OFFENDR": "OFFENDER", "SUPERVSN": "SUPERVISION",
    "AGY": "AGENCY", "ADMIN": "ADMINISTRATION", "COMM": "COMMISSION", "CORP": "CORPORATION",
}
NAME_PREFIXES = ("DEPARTMENT OF THE ", "DEPARTMENT OF ", "UNITED STATES ", "US ", "THE ")
ROSTER_FILLERS = r"\b(OFFICE OF THE|OFFICE OF|BUREAU OF|DIVISION OF|ADMINISTRATION FOR|THE)\b"
SURVEY_FILLERS = r"\b(OFFICE OF THE|OFFICE OF|BUREAU OF|DIVISION OF|THE|US|U S)\b"
INVALID_NAMES = ("INVALID", "NO DATA REPORTED", "UNKNOWN")

# Display titles.
TITLE_ABBREVIATIONS = {
    "nat": "National", "natl": "National", "developm": "Development", "offendr": "Offender",
    "supervsn": "Supervision", "agy": "Agency", "cmsn": "Commission", "comm": "Commission",
    "corp": "Corporation", "fed": "Federal", "internat": "International", "internatl": "International",
    "admin": "Administration", "ofc": "Office", "dept": "Department", "svcs": "Services", "svc": "Service",
    "mgmt": "Management", "hq": "Headquarters", "ctr": "Center", "asst": "Assistant", "sec": "Secretary",
    "dev": "Development",
}
TITLE_ACRONYMS = (
    "u.s.", "us", "dc", "epa", "nasa", "fdic", "dfc", "osd", "irs", "fbi", "dea", "atf", "cbp", "ice", "tsa",
    "fema", "cisa", "faa", "nih", "cdc", "fda", "cms", "va", "bls", "osha", "msha", "eta", "ebsa", "owcp", "ig",
    "oig", "cfo", "cio", "hr", "it",
)
TITLE_SMALL_WORDS = ("of", "and", "the", "for", "on", "in", "to", "at", "&")

# Smart punctuation folded to ASCII in survey items.
SMART_FROM = "\u0080\u0092\u0091‘’\u0093\u0094“”\u0096\u0097"
SMART_TO = "'''''\"\"\"\"--"

# Thresholds.
MIN_RESPONDENTS = 300
MIN_MOVER_HEADCOUNT = 250
MIN_MOVER_UNITS = 4
MOVER_ROWS = 12
MOVER_WINDOWS = {"3": 3, "12": 12, "60": 60, "all": None}
CHANGE_WINDOWS = {"12": 12, "60": 60}
MIN_TREND_HEADCOUNT = 500
TREND_TOP, NOW_TOP, MIX_TOP = 8, 14, 25
TREND_MONTHS = 72
TREND_DIMS = ("grade", "age_bracket", "supervisory", "appointment_type", "work_schedule", "pay_band")
PLACES_TOP = 15
CHILDREN_TOP = 20
SMALL_UNIT_HEADS = 1000
BREAKDOWN_ROWS = 40
INPUT_GUARD = 0.8
RATE_TOLERANCE, RATE_AGREEMENT = 0.05, 0.95
SUM_TOLERANCE = 0.5
FTE_BAND = (0.75, 1.35)
POSITIONS_PER_1000 = 40.0
PAY_PER_HEAD_BAND = (40_000.0, 400_000.0)
RESPONSE_BAND = (0.02, 1.0)
UNKNOWN_CODE_SHARE = 0.01
UNIT_SCALE = {"percentage": 100.0, "rate": 1000.0}
PERIOD_MONTHS = {"month": 1, "quarter": 3, "fiscal_year": 12, "survey_year": 12}
PERIOD_RANK = {"month": 0, "quarter": 1, "fiscal_year": 2, "survey_year": 2}
PERIODS_PER_YEAR = {"month": 12, "quarter": 4, "fiscal_year": 1, "survey_year": 1}

# Record columns that must never appear beside named people.
WORKFORCE_ONLY_COLUMNS = ("age_bracket", "length_of_service", "grade", "pay_band", "veteran", "education")

# Particles kept lower case inside personal names.
SURNAME_PARTICLES = ("de", "del", "della", "der", "di", "du", "la", "le", "van", "von", "y")

# Published names of nodes that no current file knows; %s is the code.
HISTORICAL_AGENCY = "Agency %s (historical; not in current OPM files)"
HISTORICAL_UNIT = "%s (historical sub-element; name not in current OPM files)"
UNRECORDED_UNIT = "Unrecorded sub-element (%s)"
