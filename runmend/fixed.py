"""Enumerations, limits, texts and formats that results depend on."""

# --- fixed values: labels, confidences, parse outcomes ----------------------
TRANSIENT = "Transient"
PERMANENT = "Permanent"
UNKNOWN = "Unknown"
LABELS = [TRANSIENT, PERMANENT, UNKNOWN]

HIGH = "High"
MEDIUM = "Medium"
LOW = "Low"

PARSED = "OK"
PARSE_FAILED = "PARSE_FAILED"
INVALID_LABEL = "INVALID_LABEL"

# --- fixed values: incident statuses ----------------------------------------
DETECTED = "detected"
CLASSIFIED = "classified"
RETRY_SCHEDULED = "retry_scheduled"
RETRIED = "retried"
RESOLVED = "resolved"
PERMANENT_NO_ACTION = "permanent_no_action"
UNKNOWN_FLAGGED = "unknown_flagged"
MAX_RETRIES_REACHED = "max_retries_reached"

OPEN_STATUSES = [DETECTED, RETRY_SCHEDULED, RETRIED]
TERMINAL_STATUSES = [RESOLVED, PERMANENT_NO_ACTION, UNKNOWN_FLAGGED, MAX_RETRIES_REACHED]

# --- fixed values: run states ------------------------------------------------
SUCCESS = "SUCCESS"
FAILED = "FAILED"
TERMINATED = "TERMINATED"
ACTIVE_STATES = ["RUNNING", "PENDING"]

# --- fixed values: limits ----------------------------------------------------
LOOKBACK_HOURS = 24
RUNS_PER_JOB = 5
SAFETY_RUNS_PER_JOB = 10
RETRY_DELAY_MINUTES = 15
MAX_RETRIES = 3

# --- fixed values: default texts ----------------------------------------------
NO_ERROR_TEXT = "No error message available"
UNPARSED_REASONING = "AI response could not be parsed"
UNKNOWN_JOB = "unknown"
NO_ROOT_CAUSE = "No root cause provided"
REVIEW_ERROR = "Review error message manually"
FIX_FAILED = "Fix suggestion generation failed"
NOT_AVAILABLE = "N/A"

# --- fixed values: notification text -------------------------------------------
RULE_LINE = "=" * 60
NOTICE_TITLE = "\U0001f534 PERMANENT JOB FAILURE NOTIFICATION"
NOTICE_JOB = "\U0001f4cb Job ID: "
NOTICE_OWNER = "\U0001f464 Owner: "
NOTICE_TIME = "\U0001f550 Detected: "
NOTICE_ERROR = "--- Actual Error (Technical Details) ---"
NOTICE_FIX_TITLE = "\U0001f916 AI ANALYSIS & FIX SUGGESTION"
NOTICE_ROOT_CAUSE = "Root Cause: "
NOTICE_STEPS = "Fix Steps:"
NOTICE_PREVENTION = "Prevention: "
NOTICE_FOOTER = "ℹ️  This job will NOT be retried automatically."
NOTICE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"

# --- fixed values: labelled example errors ---------------------------------------
LABELLED_ERRORS = [
    ("TimeoutError: Connection to external service timed out after 30 seconds. "
     "The service may be temporarily unavailable.", TRANSIENT),
    ("NameError: name 'undefined_variable' is not defined", PERMANENT),
    ("Error: Something went wrong.", UNKNOWN),
    ("Job failed with exit code 1", UNKNOWN),
    ("PermissionDenied: User does not have SELECT privilege on table 'finance.transactions'",
     PERMANENT),
    ("AnalysisException: cannot resolve column 'customer_id' due to data type mismatch", PERMANENT),
    ("429 Too Many Requests: Rate limit exceeded, please retry after some time", TRANSIENT),
]
PROMPT_EXAMPLES = [
    ("TimeoutError: Connection to external service timed out after 30 seconds.", TRANSIENT),
    ("FileNotFoundError: Table 'sales.transactions_2023' not found.", PERMANENT),
    ("NameError: name 'undefined_variable' is not defined", PERMANENT),
    ("Job failed with exit code 1", UNKNOWN),
    ("Something went wrong.", UNKNOWN),
]
NOT_FOUND_ERROR = (
    "FileNotFoundError: Table 'sales.transactions_2023' not found. "
    "Please verify the table exists and the path is correct."
)

# --- fixed values: evidence patterns of the rule labels (Java and RE2) -----------
TRANSIENT_PATTERN = (
    "timeout|timed out|temporarily unavailable|too many requests|rate limit|throttl"
    "|connection (reset|refused|aborted)"
)
PERMANENT_PATTERN = (
    "not found|does not exist|no such (file|table)|nameerror|is not defined|syntaxerror"
    "|permission ?denied|does not have .* privilege|unauthorized|access denied"
    "|invalid credential|cannot resolve|(type|schema) mismatch"
)

# --- fixed values: legal status changes (None = the incident does not exist yet) --
LEGAL_TRANSITIONS = [
    (None, DETECTED),
    (DETECTED, RETRY_SCHEDULED),
    (DETECTED, PERMANENT_NO_ACTION),
    (DETECTED, UNKNOWN_FLAGGED),
    (RETRY_SCHEDULED, RESOLVED),
    (RETRY_SCHEDULED, RETRIED),
    (RETRIED, RESOLVED),
    (RETRIED, MAX_RETRIES_REACHED),
    (RETRIED, RETRY_SCHEDULED),
    (RETRIED, PERMANENT_NO_ACTION),
    (RETRIED, UNKNOWN_FLAGGED),
]

# --- status changes that a person's label makes, beyond the automatic ones --------
CORRECTION_TRANSITIONS = [
    (UNKNOWN_FLAGGED, RETRY_SCHEDULED),
    (UNKNOWN_FLAGGED, PERMANENT_NO_ACTION),
]

# The fields of a model's answers, and the values they may have.
CLASSIFICATION_FORM = '{"classification": "Transient|Permanent|Unknown", "reasoning": "one sentence explanation", "confidence": "High|Medium|Low"}'

# --- not fixed: this library's own words; the names of the fields alone are given -------
FIX_FORM = '{"root_cause": "<what is wrong>", "fix_steps": ["<first change>", "<next change>"], "prevention": "<what keeps it from coming back>"}'
REVIEW_ERROR_AND_LOGS = "Review the error message and job logs manually"
