"""The fixed values of the rules once more, for the comparison SQL, so that a changed value in the library shows."""

# --- fixed values: value patterns, first match in order wins -----------------
VALUE_PATTERNS = [
    ("UUID", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("Email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"),
    ("URL", r"^https?://"),
    ("Date String", r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2})?"),
    ("Phone", r"^\+?[\d\s\-\(\)\.]{7,20}$"),
    ("IP Address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("JSON", r"(?s)^\{.*\}$|^\[.*\]$"),
]
PATTERN_SHARE_PCT = 70
PATTERN_SAMPLE = 40
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]

# --- fixed values: personal data by value, first match in order wins ---------
PII_VALUE_PATTERNS = [
    ("Email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"),
    ("SSN", r"^\d{3}-\d{2}-\d{4}$"),
    ("IP Address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
    ("Phone", r"^\+?[\d\s\-\(\)\.]{7,20}$"),
    ("UUID", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
]
PII_SHARE_PCT = 65

# --- fixed values: personal data by column name, first match wins ------------
PII_NAME_PATTERNS = [
    ("Email", r"email|e_mail|emailaddress"),
    ("Phone", r"phone|mobile|cell_no|telephone|fax"),
    ("SSN", r"ssn|social_security|sin\b"),
    ("Passport", r"passport"),
    ("Credit Card", r"credit_card|card_number|cardnum|\bpan\b|card_no"),
    ("Address", r"\baddress\b|street|addr\b"),
    ("Date of Birth", r"birth_date|dob\b|date_of_birth|birthdate"),
    ("IP Address", r"ip_address|ip_addr|ipaddr|\bip\b"),
    ("Person Name", r"first_name|last_name|full_name|fname|lname|surname|forename|given_name"),
    ("Financial", r"salary|income|wage\b|compensation\b"),
    ("National ID", r"national_id|nationalid|\bnid\b|\bnic\b"),
    ("Password", r"password|passwd|_pwd\b"),
    ("Tax ID", r"tax_id|taxid|\bein\b|\bvat\b"),
    ("Demographic", r"gender|sex\b"),
    ("Demographic", r"race|ethnicity|religion|nationality"),
    ("Location", r"location|latitude|longitude|\blat\b|\blon\b|\blng\b"),
]

# --- fixed values: lineage tags, every matching rule contributes -------------
LINEAGE_RULES = [
    (r"^created_at$|^create_date$|^created_date$|^insert_date$|^inserted_at$|^creation_date$",
     ["temporal", "audit", "created_at"]),
    (r"^updated_at$|^modified_at$|^last_modified$|^update_date$|^last_updated$|^modified_date$",
     ["temporal", "audit", "updated_at"]),
    (r"^deleted_at$|^delete_date$|^removed_at$|^archived_at$", ["temporal", "audit", "soft_delete"]),
    (r"^created_by$|^inserted_by$|^added_by$", ["audit", "created_by"]),
    (r"^updated_by$|^modified_by$|^last_modified_by$|^changed_by$", ["audit", "updated_by"]),
    (r"^deleted_by$|^removed_by$", ["audit", "deleted_by"]),
    (r"^is_deleted$|^deleted$|^is_removed$|^is_archived$", ["soft_delete"]),
    (r"^is_active$|^active$|^is_enabled$|^enabled$|^is_visible$", ["status", "soft_delete"]),
    (r"^status$|^state$|^stage$|^phase$|^workflow_state$", ["status"]),
    (r"^version$|^row_version$|^etag$|^revision$|^seq_no$|^sequence_no$", ["versioning"]),
    (r"^id$|_id$", ["surrogate_key"]),
    (r"^code$|_code$|^sku$|^uuid$|^guid$|^external_id$|^reference_id$|^business_key$", ["natural_key"]),
    (r"amount|price|cost|fee\b|tax\b|discount|total\b|subtotal|revenue|balance|charge", ["financial"]),
    (r"latitude|longitude|\blat\b|\blon\b|\blng\b|coordinate|geo_|_geo", ["geographic"]),
    (r"_date$|_at$|_time$|_datetime$|_timestamp$", ["temporal"]),
    (r"^is_|^has_|^can_|^should_|^flag_|_flag$|_yn$", ["boolean_flag"]),
]

# --- fixed values: naming styles, first full match wins ----------------------
NAMING_STYLES = [
    ("snake_case", r"[a-z][a-z0-9]*(_[a-z0-9]+)*"),
    ("camelCase", r"[a-z][a-zA-Z0-9]+"),
    ("PascalCase", r"[A-Z][a-zA-Z0-9]+"),
    ("UPPER_SNAKE", r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)*"),
]

# --- fixed values: table class hints ------------------------------------------
JUNCTION_HINTS = ["_map", "_xref", "_link", "_assoc", "_rel",
                  "_bridge", "_junction", "_pivot", "_through", "_m2m"]
AUDIT_HINTS = ["_audit", "_log", "_history", "_archive", "_trail",
               "_changelog", "audit_", "log_", "_change", "_event_log"]
LOOKUP_HINTS = ["lookup_", "_lookup", "_code", "_type", "_status", "_ref",
                "reference", "config", "setting", "parameter", "constant",
                "currency", "country", "language", "timezone"]
DIMENSION_HINTS = ["dim_", "_dim", "dimension", "customer", "product", "employee",
                   "user", "account", "store", "location", "category", "supplier",
                   "vendor", "region", "territory", "department", "brand"]
FACT_HINTS = ["fact_", "_fact", "transaction", "sale", "order", "event",
              "activity", "metric", "measure", "record", "entry", "purchase",
              "payment", "invoice", "shipment", "booking"]

# --- fixed values: display of table classes ------------------------------------
CLASS_COLORS = {"fact": "#7c3aed", "dimension": "#2563eb", "lookup": "#059669",
                "audit": "#d97706", "junction": "#0891b2", "unknown": "#4f46e5"}
CLASS_LABELS = {"fact": "Fact", "dimension": "Dimension", "lookup": "Lookup",
                "audit": "Audit", "junction": "Junction", "unknown": ""}

# --- fixed values: limits and thresholds ----------------------------------------
TOP_N = 10
SAMPLE_ROWS = 5
HISTOGRAM_BINS = 10
IQR_FACTOR = 1.5
TREND_SHARE_PCT = 70
TREND_BAD_PCT = 50

# --- fixed values: issue texts, in rule order ------------------------------------
ISSUE_DUPLICATES = "High duplicate rate: {}%"
ISSUE_NULL = "Column '{}' is {}% null"
ISSUE_MAJORITY_NULL = "Column '{}' has majority nulls ({}%)"
ISSUE_CONSTANT = "Column '{}' has only one distinct value"
ISSUE_PII = "Column '{}' may contain PII ({}) — verify"
ISSUE_FOREIGN_KEY = "FK violation: {} → {}.{} ({} orphans)"
NAMING_NO_STYLE = "Non-standard naming (mixed/special chars)"
NAMING_OTHER_STYLE = "Expected {}, found {}"

# --- fixed values: phrases of column hints, in order ------------------------------
HINT_FULL = "always populated"
HINT_NEVER = "{}% null (almost never set)"
HINT_OFTEN = "{}% null (often absent)"
HINT_NULL = "{}% null"
HINT_CONSTANT = 'constant: always "{}"'
HINT_UNIQUE = "all values unique (identifier)"
HINT_FEW = "{} distinct values: {}"
HINT_SOME = "{} distinct (top: {})"
HINT_MANY = "{} distinct ({}% unique)"
HINT_RANGE = "range: {}–{}"
HINT_DATES = "date range: {} → {}"
HINT_FIXED = "fixed {}-char code"
HINT_SHORT = "short code ({}–{} chars)"
HINT_PATTERN = "pattern: {}"
HINT_PII = "contains: {}"

# --- fixed values: lines of column and table context -------------------------------
LINE_COLUMN = "- {} [{}]"
LINE_KEYS = "({})"
LINE_HINTS = "| {}"
LINE_PII = "| PII:{}"
LINE_TAGS = "| tags:{}"
LINE_COMMENT = '| db-comment:"{}"'
CONTEXT_ROWS = "Row count: {}"
CONTEXT_CLASS = "Classification: {} table"
CONTEXT_NULLS = "Overall null rate: {}%"
CONTEXT_DUPLICATES = "Duplicate rows: {}%"
CONTEXT_ISSUES = "Data issues: {}"
CONTEXT_COLUMNS = "Columns: {}"

# --- fixed values: label of a histogram bin ------------------------------------------
BIN_LABEL = "{}–{}"

# --- fixed values: headers of the CSV reports -----------------------------------------
CSV_FIELDS = {
    "tables": ["table", "schema", "row_count", "column_count", "table_type", "quality_score", "null_pct",
               "duplicate_pct", "fk_violation_count", "issue_count", "llm_description"],
    "columns": ["table", "table_type", "column", "type", "nullable", "is_pk", "is_fk", "fk_to", "default_value",
                "pii_type", "lineage_tags", "naming_issue", "description"],
    "profiling": ["table", "column", "dtype", "null_count", "null_pct", "distinct_count", "distinct_pct",
                  "min_val", "max_val", "mean_val", "median_val", "std_val", "q25", "q75", "outlier_count",
                  "outlier_pct", "detected_pattern", "pii_detected", "min_length", "max_length", "avg_length",
                  "min_date", "max_date", "is_constant", "is_unique", "top_values_json"],
    "relationships": ["from_table", "from_columns", "to_table", "to_columns", "fk_name", "cardinality",
                      "orphan_count", "integrity_status"],
    "issues": ["table", "issue", "category"],
    "pii_report": ["table", "column", "type", "pii_from_name", "pii_from_values", "pii_type"],
}

# --- fixed values: names of inferred keys, labels, fingerprints ---------------------
INFERRED_NAME = "inferred__{}__{}"
KEY_LABEL = "{} → {}.{}"
EDGE_LABEL = "{} → {}"
EDGE_ID = "{}_{}_{}"
FINGERPRINT = "{}{}:{}"
FINGERPRINT_HEX = 16

# --- fixed values: reading answers ---------------------------------------------------
# characters that count as white space at the ends of a text
WHITE_SPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
               "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CONFIDENCE_AT_END = r"(?s)\A(.*?)\s*\[(\d{1,3})\]\s*\z"
CONFIDENCE_PHRASE = r"(?i)\bconfidence[:\s]+(\d{1,3})\b"
CONFIDENCE_REMOVED = r"(?i)\n?\s*confidence[:\s]+\d+\s*\.?"
FENCE = "```"
FENCE_OPEN = r"(?m)^```(?:json)?\s*"
FENCE_CLOSE = r"(?m)\s*```$"
JSON_BLOCK = r"(?s)\{.*\}"
TRAILING_COMMA = r",\s*([}\]])"
# possessive loops, so that a long text does not deepen the matcher's stack
JSON_PAIR = r'"([^"]+)"\s*:\s*"((?:[^"\\]++|\\.)*+)"'
