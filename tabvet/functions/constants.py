"""Fixed values that must equal the reference's for the same results.

They are stated here together, in natural order, and used everywhere else
by name.
"""

# --- fixed values (must match the reference) ------------------------------
# Placeholder texts that mean "missing" (compared lower-cased after trimming).
MISSING_MARKERS = (
    "", "-", "--", "?", "n/a", "na", "n.a.", "none", "null", "nil",
    "missing", "unknown", "not available", "#n/a", "\\n", ".",
)
# Column-name keywords that hint at a prediction target.
TARGET_KEYWORDS = (
    "target", "label", "class", "outcome", "churn", "price", "sales",
    "revenue", "score", "result", "y", "survived", "default", "fraud",
)
# Keywords at least this long may also match as substrings.
MIN_SUBSTRING_KEYWORD = 5
# Tokens a delimited-file reader maps to null by default (pandas' NA set).
READER_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Profiling.
MAX_PROFILE_ROWS = 200_000
CATEGORICAL_MAX_UNIQUE = 50
TOP_CORRELATION_PAIRS = 15
CORRELATION_MIN_ABS = 0.30
IDENTIFIER_UNIQUE_RATIO = 0.98
DATETIME_PARSE_THRESHOLD = 0.9
TEXT_MIN_AVG_LENGTH = 40
TOP_VALUES = 10
SAMPLE_VALUES = 5
HIGH_NULL_PCT = 50
OUTLIER_WARN_PCT = 5
SKEW_WARN_ABS = 2
COLLINEAR_ABS = 0.95
FEW_ROWS = 100
TARGET_MAX_NULL_PCT = 20
MAX_TARGET_CANDIDATES = 5
# Training and leakage.
RANDOM_STATE = 42
TEST_SIZE = 0.2
FEATURE_MAX_NULL_PCT = 80
FEATURE_MAX_CATEGORIES = 100
LEAKAGE_NMI_THRESHOLD = 0.95
ADDITIVE_LEAKAGE_R2 = 0.99
LEAK_BINS = 12
MAX_TREE_DEPTH = 12
TREES = 120
MAX_TRAINING_ROWS = 100_000
INTERACTIVE_ROW_LIMIT = 20_000
# Explanation.
MAX_SHAP_ROWS = 500
MIN_SHAP_ROWS = 60
SHAP_ROW_NODE_BUDGET = 60_000_000
SHAP_MAX_MODEL_NODES = 2_500_000
PERMUTATION_REPEATS = 5
TOP_FEATURES_REPORTED = 15
# Quality gate.
MIN_ROC_AUC = 0.65
MIN_F1 = 0.60
MIN_R2 = 0.30
MIN_TRAINING_ROWS = 200
IMPLAUSIBLE_SCORE = 0.98
MIN_IMPROVEMENT = 0.02
DEAD_FEATURE_SHARE = 0.02
STRONG_F1 = 0.75
STRONG_R2 = 0.60
MAX_REFLECTION_ROUNDS = 2
# Ad-hoc queries.
MAX_GROUPS_RETURNED = 25
MAX_ROWS_SCANNED = 200_000
HISTORY_LIMIT = 50
# Ingestion.
ALLOWED_SUFFIXES = (".csv", ".tsv", ".txt")
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
SNIFF_BYTES = 64_000
CANDIDATE_DELIMITERS = (",", ";", "\t", "|")
# --- end of fixed values ---------------------------------------------------

SEMANTIC_TYPES = (
    "empty", "constant", "boolean", "datetime", "identifier", "binary",
    "categorical_numeric", "numeric", "datetime_string", "categorical", "text",
    "high_cardinality_categorical", "unsupported",
)

# Every format below starts like this; anything else is not tried at all.
DATE_SHAPE = r"^([0-9]{1,2}[0-9/-]|[A-Z][a-z]{2} [0-9])"
# Date formats a text column is tried against (first match wins): a shape
# regex that gates the parse, the Spark pattern and the equivalent strptime
# pattern. The gate keeps failing parses cheap and makes both engines agree.
DATETIME_FORMATS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd", "%Y-%m-%d"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d", "%Y/%m/%d"),
    (r"^[0-9]{1,2}-[A-Z][a-z]{2}-[0-9]{4}$", "d-MMM-yyyy", "%d-%b-%Y"),
    (r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}$", "MMM d yyyy", "%b %d %Y"),
    (r"^[0-9]{8}$", "yyyyMMdd", "%Y%m%d"),
)
# Dates of which only the column tells whether the day or the month comes
# first: shape, then the Spark and strptime patterns for each of the two.
AMBIGUOUS_FORMATS = (
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ("M/d/yyyy", "%m/%d/%Y"), ("d/M/yyyy", "%d/%m/%Y")),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$", ("M/d/yyyy H:mm", "%m/%d/%Y %H:%M"), ("d/M/yyyy H:mm", "%d/%m/%Y %H:%M")),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", ("M/d/yyyy H:mm:ss", "%m/%d/%Y %H:%M:%S"), ("d/M/yyyy H:mm:ss", "%d/%m/%Y %H:%M:%S")),
)
AMBIGUOUS_SHAPE = r"^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}"
# ISO times with a fraction of a second, a zone, or both.
ISO_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
