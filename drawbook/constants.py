"""Word lists, codes, bands and limits that results depend on. Kept as plain text."""

# Words that mean "not performed".
NOT_PERFORMED_WORDS = ["tnp", "test not performed", "not performed"]

# Result words read literally.
QUALITATIVE_WORDS = [
    "negative", "positive", "detected", "not detected", "none detected", "trace", "normal", "abnormal",
    "reactive", "non-reactive", "nonreactive", "yellow", "straw", "amber", "colorless", "clear", "hazy",
    "cloudy", "turbid", "none seen",
]

# The expected (good) words of a categorical result.
EXPECTED_WORDS = ["negative", "not detected", "none detected", "normal", "non-reactive", "nonreactive"]

# Printed words that count as a text result of an independent read.
READ_STATUS_WORDS = [
    "negative", "positive", "none seen", "yellow", "clear", "no culture indicated", "see note: not reported",
    "not applicable", "test not performed", "not performed", "tnp", "detected", "not detected", "trace",
    "normal", "abnormal", "reactive", "non-reactive",
]

# Multi-word cells, joined before cells are read.
MULTIWORD_CELLS = ["test not performed", "not performed", "not detected", "none detected", "none seen"]

# Printed flag words and the flag each one states.
FLAG_WORDS = {"H": "H", "L": "L", "HH": "HH", "LL": "LL", "HIGH": "H", "LOW": "L"}
FLAG_DISPLAY = {"H": "High", "L": "Low", "HH": "Critical high", "LL": "Critical low"}

# Month names.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5,
    "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9,
    "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

# A printed date in any accepted form.
PRINTED_DATE = (
    r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|"
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+\d{1,2},?\s+\d{4})"
)

# Phrases that mark a methodology note, never a result line.
METHODOLOGY_PHRASES = [
    "effective", "this test was performed", "please refer to", "validated pursuant to", "this assay",
    "for additional information", "compared to historical results", "developed and its analytical performance",
]
EVIDENCE_LINE_LIMIT = 240

# The systems scores roll up to, and the data category each one covers.
CATEGORY_SYSTEM = {
    "Hormones": "Drive", "Thyroid": "Pace", "Metabolic": "Fuel", "Lipids": "Flow", "Inflammation": "Repair",
    "Foundational": "Reserves",
}
SYSTEMS = ["Drive", "Pace", "Fuel", "Flow", "Repair", "Reserves"]
CATEGORY_ORDER = ["Inflammation", "Lipids", "Metabolic", "Hormones", "Thyroid", "Foundational", "Also Monitored"]
EMPTY_SYSTEM_SCORE = 50

# Order of the groups of results shown as the lab reported them.
REPORTED_GROUPS = [
    "Complete Blood Count", "Chemistry", "Iron Studies", "Lipids", "Fatty Acids (OmegaCheck)", "Cardiovascular",
    "Inflammation", "Hormones", "Tumor Markers", "Infectious Disease", "Urinalysis", "Other Lab-Flagged Results",
]

# Half-open body-fat bands per sex and visceral-fat-area bands, with the score of each tier.
TIER_SCORES = {"optimal": 96, "suboptimal": 75, "borderline": 50, "poor": 20}
BODY_FAT_BANDS = [
    ("female", 0.0, 10.0, "poor"), ("female", 10.0, 14.0, "suboptimal"), ("female", 14.0, 21.0, "optimal"),
    ("female", 21.0, 25.0, "optimal"), ("female", 25.0, 32.0, "borderline"), ("female", 32.0, None, "poor"),
    ("male", 0.0, 2.0, "poor"), ("male", 2.0, 6.0, "suboptimal"), ("male", 6.0, 14.0, "optimal"),
    ("male", 14.0, 18.0, "optimal"), ("male", 18.0, 25.0, "borderline"), ("male", 25.0, None, "poor"),
]
VAT_BANDS = [(0.0, 100.0, "optimal"), (100.0, 160.0, "borderline"), (160.0, None, "poor")]

# The seven answer domains.
VITALITY_DOMAINS = [
    "Energy", "Sleep", "Mental Clarity & Focus", "Mood & Emotional Balance", "Cravings", "Sexual Desire",
    "Sexual Function",
]
VITALITY_VALUES = {"No Concern": 0, "Some Concern": 1, "Significant Concern": 2, "Not Assessed": None}

# Note sections and the lines of the treatment section.
NOTE_SECTIONS = [
    "consultation note", "patient concerns", "protocol", "marker targets", "vitality index", "treatment status",
]
PATIENT_SYSTEMS = ["Drive", "Pace", "Fuel", "Flow", "Repair", "Reserves", "Structure"]

# Limits and windows.
UNDATED_MIN_MATCHES = 10
SCAN_WINDOW_DAYS = 60
AGE_TOLERANCE_YEARS = 2
BONE_MINERAL_MAX = 15.0
RANGE_BASIS_RATIO = 5
READ_AGREEMENT = 2
STALE_SECONDS = 120
EXPIRY_SECONDS = 6 * 60 * 60
GOAL_SCORE = 88
PLACEHOLDER_TIMES = ["00:01"]

# Table column labels, and the words a repeated header line is made of.
COLUMN_LABELS = [
    ("name", "test name"), ("name", "test"), ("name", "tests"), ("name", "analyte"),
    ("current", "current"), ("current", "current result"), ("current", "result"), ("current", "in range"),
    ("current", "out of range"), ("current", "optimal"), ("current", "moderate"), ("current", "high"),
    ("historical", "historical"), ("historical", "historical result"),
    ("range", "reference range"), ("range", "reference interval"), ("range", "range"),
    ("units", "units"), ("units", "unit"), ("lab", "lab"), ("flag", "flag"),
    ("comment", "comments"), ("comment", "comment"),
]
HEADER_WORDS = [
    "test", "name", "tests", "analyte", "current", "historical", "result", "results", "relative", "risk",
    "optimal", "moderate", "high", "low", "non-optimal", "nonoptimal", "in", "out", "of", "range", "reference",
    "interval", "units", "unit", "flag", "lab",
]
TREND_TITLES = ["progress summary", "trend summary", "cumulative summary"]
LINE_TOLERANCE = 3.0
DATE_COLUMN_PAD = 6.0

# Words of header lines under a table's first header line, and what they name.
TIER_WORDS = ["optimal", "moderate", "high", "low", "borderline"]
UPPER_TIER_WORDS = ["moderate", "high", "borderline"]
CURRENT_SUBLABELS = ["non-optimal", "in range", "out of range"]
STANDALONE_FLAGS = ["H", "L", "HH", "LL"]
PHRASE_GAP = 12.0
RULE_LEFT_TOLERANCE = 12.0
SECTION_TITLE = r"(?i)^[A-Za-z][A-Za-z&/-]*(?:\s+[A-Za-z][A-Za-z&/-]*){0,7}\s+Report\z"
# The layout with four labelled columns, one accession and one collection date a page.
ACCESSION_HEADER = ["Test", "Name", "Results", "Reference", "Range", "Units"]
ACCESSION_LABELS = ["Acc#", "Coll. Date:", "Report Status:"]
ACCESSION_WORDS = [
    "negative", "positive", "trace", "normal", "abnormal", "yellow", "straw", "amber", "colorless", "clear", "hazy",
    "cloudy", "turbid", "n/a", "none seen", "not detected", "detected", "rare", "few", "moderate", "many", "small",
    "large", "1+", "2+", "3+", "4+",
]
ACCESSION_NOTES = ["stage", "grade", "class", "risk", "probability", "morning", "afternoon", "evening", "note", "comment",
                   "method", "performed", "reference"]
ACCESSION_INDENT = 8.0
