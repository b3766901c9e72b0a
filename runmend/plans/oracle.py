"""The registered queries as SQL for DuckDB, over the same tables.

Written from the definitions, not from the plans: runs are ranked before they are
filtered, successors come from LEAD over all runs, retries are ranked per job.
"""

from __future__ import annotations

from runmend import fixed
from runmend.functions import prompts
from runmend.operators import fixes
from runmend.sources import sample_tables as sample


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
NO_ERROR = text(fixed.NO_ERROR_TEXT)


def evidence(pattern: str, column: str) -> str:
    return f"regexp_matches(lower(coalesce({column}, '')), {text(pattern)})"


def label(column: str) -> str:
    t, p = evidence(fixed.TRANSIENT_PATTERN, column), evidence(fixed.PERMANENT_PATTERN, column)
    return (f"CASE WHEN {t} AND NOT {p} THEN 'Transient' "
            f"WHEN {p} AND NOT {t} THEN 'Permanent' ELSE 'Unknown' END")


def reasoning(column: str) -> str:
    t, p = evidence(fixed.TRANSIENT_PATTERN, column), evidence(fixed.PERMANENT_PATTERN, column)

    def found(pattern: str) -> str:
        return f"regexp_extract(lower({column}), {text(pattern)})"

    return (f"CASE WHEN {t} AND {p} THEN 'evidence of both kinds' "
            f"WHEN {t} THEN 'transient evidence: ' || {found(fixed.TRANSIENT_PATTERN)} "
            f"WHEN {p} THEN 'permanent evidence: ' || {found(fixed.PERMANENT_PATTERN)} "
            f"ELSE 'no specific evidence' END")


def status(column: str) -> str:
    return (f"CASE {column} WHEN 'Transient' THEN 'retry_scheduled' "
            f"WHEN 'Permanent' THEN 'permanent_no_action' ELSE 'unknown_flagged' END")


def _rule(column: str) -> str:
    found = " ".join(
        f"WHEN regexp_matches(lower({column}), {text(pattern)}) THEN {n}"
        for n, (pattern, *_) in enumerate(fixes.FIX_RULES))
    return f"CASE {found} ELSE -1 END"


ERROR_BY_DIGIT = "CASE k % 10 " + " ".join(
    f"WHEN {digit} THEN {text(error)}" for digit, (error, _) in sample.ERRORS.items()) + " END"
EXPECTED = ", ".join(f"({text(error)}, {text(expected)})" for error, expected in sample.ERRORS.values())

NEWEST = "ORDER BY start_time DESC, TRY_CAST(run_id AS HUGEINT) DESC NULLS LAST, run_id DESC"
SEEN = "TIMESTAMP '2024-01-25 00:00:00'"
STATE = "job_id, run_id, start_time, life_cycle_state, result_state"

CTES = {
    "runs": f"""runs AS (
  SELECT *, {ERROR_BY_DIGIT} AS raw_error, coalesce({ERROR_BY_DIGIT}, {NO_ERROR}) AS error_message,
    CASE WHEN k % 10 <> 9 THEN 't' || run_id END AS task_run_id
  FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(event_id AS VARCHAR) AS run_id, event_id,
      ts AS start_time, k,
      CASE WHEN event_type = 'view' AND k < 10 THEN 'RUNNING'
           WHEN event_type = 'view' AND k < 15 THEN 'PENDING' ELSE 'TERMINATED' END AS life_cycle_state,
      CASE WHEN event_type = 'view' AND k < 15 THEN NULL
           WHEN event_type = 'purchase' THEN 'SUCCESS'
           WHEN event_type = 'view' AND k >= 60 THEN 'SUCCESS'
           WHEN event_type = 'signup' AND k < 50 THEN 'CANCELED'
           WHEN event_type = 'signup' THEN 'TIMEDOUT' ELSE 'FAILED' END AS result_state
    FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)))""",
    "incidents": f"""incidents AS (
  SELECT run_id AS tracking_id, job_id, run_id AS original_run_id,
    CASE WHEN retried THEN nxt ELSE run_id END AS latest_run_id, error_message, classification,
    CAST(CASE WHEN retried THEN 1 + event_id % 4 ELSE 0 END AS INTEGER) AS retry_count,
    CASE WHEN classification = 'Permanent' THEN 'permanent_no_action'
         WHEN classification = 'Unknown' THEN 'unknown_flagged'
         WHEN retried THEN 'retried' ELSE 'retry_scheduled' END AS status,
    start_time AS first_failed_at, start_time + INTERVAL 5 MINUTE AS last_updated_at,
    CASE WHEN retried THEN [run_id, nxt] ELSE [run_id] END AS all_run_ids
  FROM (SELECT *, classification = 'Transient' AND event_id % 2 = 1 AND nxt IS NOT NULL AS retried
    FROM (SELECT *, {label('raw_error')} AS classification,
        lead(run_id) OVER (PARTITION BY job_id ORDER BY start_time, event_id) AS nxt FROM runs)
    WHERE result_state = 'FAILED'
      AND start_time < TIMESTAMP '2024-01-30 12:00:00'))""",
    "known": "known AS (SELECT DISTINCT unnest(all_run_ids) AS run_id FROM incidents)",
    "detected": f"""detected AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs)
  WHERE rn <= 5 AND start_time >= {AS_OF} - INTERVAL 24 HOUR AND result_state = 'FAILED'
    AND run_id NOT IN (SELECT run_id FROM known))""",
    "labelled": f"""labelled AS (
  SELECT *, {label('error_message')} AS classification, {reasoning('error_message')} AS reasoning
  FROM runs WHERE result_state = 'FAILED')""",
    "top10": f"""top10 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs)
  WHERE rn <= 10)""",
    "activity": """activity AS (
  SELECT job_id, max(CASE WHEN result_state = 'SUCCESS' THEN start_time END) AS last_success_at,
    bool_or(life_cycle_state IN ('RUNNING', 'PENDING')) AS in_progress
  FROM top10 GROUP BY job_id)""",
    "log": """log AS (
  SELECT tracking_id, 1 AS seq, 'detected' AS event, first_failed_at AS ts, job_id,
    original_run_id AS run_id, NULL AS classification, 'detected' AS status FROM incidents
  UNION ALL
  SELECT tracking_id, 2, 'classified', first_failed_at + INTERVAL 5 MINUTE, job_id, original_run_id,
    classification,
    CASE WHEN classification = 'Transient' THEN 'retry_scheduled' ELSE status END FROM incidents
  UNION ALL
  SELECT tracking_id, CAST(CASE WHEN retry_count < 4 THEN 1 + 2 * a ELSE 2 + a END AS INTEGER), 'retried',
    first_failed_at + to_minutes(CAST(5 + 20 * a AS INTEGER)), job_id,
    CASE WHEN a = retry_count THEN latest_run_id ELSE original_run_id || '-r' || a END, NULL, 'retried'
  FROM (SELECT *, unnest(range(1, retry_count + 1)) AS a FROM incidents)
  UNION ALL
  SELECT tracking_id, CAST(2 + 2 * a AS INTEGER), 'classified',
    first_failed_at + to_minutes(CAST(15 + 20 * a AS INTEGER)), job_id,
    original_run_id || '-r' || a, 'Transient', 'retry_scheduled'
  FROM (SELECT *, unnest(range(1, retry_count)) AS a FROM incidents WHERE retry_count < 4))""",
    "state": """state AS (
  SELECT l.tracking_id, any_value(i.job_id) AS job_id, any_value(i.original_run_id) AS original_run_id,
    any_value(i.latest_run_id) AS latest_run_id, any_value(i.error_message) AS error_message,
    arg_max(l.classification, l.seq) FILTER (WHERE l.classification IS NOT NULL) AS classification,
    CAST(count(*) FILTER (WHERE l.event = 'retried') AS INTEGER) AS retry_count,
    arg_max(l.status, l.seq) AS status, min(l.ts) AS first_failed_at, max(l.ts) AS last_updated_at,
    list(l.run_id ORDER BY l.seq) FILTER (WHERE l.event IN ('detected', 'retried')) AS run_ids,
    CASE WHEN arg_max(l.status, l.seq) = 'retry_scheduled'
         THEN max(l.ts) + INTERVAL 15 MINUTE END AS next_retry_at,
    max(l.seq) AS version
  FROM log l JOIN incidents i ON i.tracking_id = l.tracking_id GROUP BY l.tracking_id)""",
    "judged": f"""judged AS (
  SELECT i.tracking_id, i.job_id, i.first_failed_at, i.retry_count,
    CASE WHEN NOT i.due THEN 'not_due'
         WHEN date_trunc('millisecond', a.last_success_at) > date_trunc('millisecond', i.first_failed_at)
           THEN 'resolved'
         WHEN a.in_progress THEN 'skip_in_progress' ELSE 'free' END AS verdict
  FROM (SELECT *, last_updated_at <= {AS_OF} - INTERVAL 15 MINUTE AS due FROM incidents
        WHERE status = 'retry_scheduled') i LEFT JOIN activity a ON a.job_id = i.job_id)""",
    "judged_v2": f"""judged AS (
  SELECT i.tracking_id, i.job_id, i.first_failed_at, i.retry_count,
    CASE WHEN NOT i.due THEN 'not_due'
         WHEN date_trunc('millisecond', a.last_success_at) > date_trunc('millisecond', i.first_failed_at)
           THEN 'resolved'
         WHEN a.in_progress THEN 'skip_in_progress' ELSE 'free' END AS verdict
  FROM (SELECT *, coalesce(next_retry_at <= {AS_OF}, last_updated_at <= {AS_OF} - INTERVAL 15 MINUTE) AS due FROM state
        WHERE status = 'retry_scheduled') i LEFT JOIN activity a ON a.job_id = i.job_id)""",
    "plan": """plan AS (
  SELECT tracking_id, job_id, retry_count,
    CASE WHEN verdict <> 'free' THEN verdict
         WHEN row_number() OVER (PARTITION BY job_id, verdict ORDER BY first_failed_at, tracking_id) = 1
           THEN 'retry' ELSE 'skip_same_pass' END AS action
  FROM judged)""",
    "outcome": f"""outcome AS (
  SELECT i.tracking_id, i.job_id, i.latest_run_id AS run_id, i.retry_count,
    CASE WHEN again THEN r.error_message END AS error_message,
    CASE WHEN again THEN {label('r.error_message')} END AS classification,
    CASE WHEN r.result_state IS NULL THEN 'still_running'
         WHEN r.result_state = 'SUCCESS' THEN 'resolved'
         WHEN i.retry_count >= 3 THEN 'max_retries_reached'
         ELSE {status(label('r.error_message'))} END AS status
  FROM (SELECT * FROM incidents WHERE status = 'retried') i
  LEFT JOIN (SELECT *, result_state IS NOT NULL AND result_state <> 'SUCCESS' AS bad FROM runs) r
    ON r.run_id = i.latest_run_id
  CROSS JOIN LATERAL (SELECT r.bad AND i.retry_count < 3 AS again))""",
    "jobs": """jobs AS (
  SELECT CAST(c_custkey AS VARCHAR) AS job_id, CASE WHEN c_acctbal >= 0 THEN c_name END AS creator,
    c_mktsegment AS tag FROM customer)""",
    "fixed": f"""fixed AS (
  SELECT *, {_rule('error_message')} AS rule FROM incidents WHERE status = 'permanent_no_action')""",
    "calls": f"""calls AS (
  SELECT *, CASE k // 10 WHEN 0 THEN '```json' || chr(10) || plain || chr(10) || '```'
      WHEN 1 THEN plain || ' I hope this helps.' WHEN 2 THEN lower(plain)
      WHEN 3 THEN '{{"reasoning": "no label given"}}' WHEN 4 THEN NULL ELSE plain END AS raw_response
  FROM (SELECT *, '{{"classification": "' || {label('error_message')}
      || '", "reasoning": "read from the text", "confidence": "High"}}' AS plain
    FROM runs WHERE result_state = 'FAILED'))""",
}


def with_tables(names: str, select: str) -> str:
    return "WITH " + ",\n".join(CTES[name] for name in names.split()) + "\n" + select


def _fix_part(position: int) -> str:
    parts = [rule[position + 1] for rule in fixes.FIX_RULES] + [fixes.OTHER_FIX[position]]
    values = ["|".join(p) if isinstance(p, list) else p for p in parts]
    cases = " ".join(f"WHEN {n} THEN {text(v)}" for n, v in enumerate(values[:-1]))
    return f"CASE rule {cases} ELSE {text(values[-1])} END"


def _steps_lines() -> str:
    parts = [rule[2] for rule in fixes.FIX_RULES] + [fixes.OTHER_FIX[1]]
    values = ["\n".join(f"  {n}. {step}" for n, step in enumerate(steps, 1)) for steps in parts]
    cases = " ".join(f"WHEN {n} THEN {text(v)}" for n, v in enumerate(values[:-1]))
    return f"CASE rule {cases} ELSE {text(values[-1])} END"


OWNER = "coalesce(j.creator, 'unassigned')"
DETECTION = "runs incidents known detected"
STATE_LOG = "runs incidents log state"
PLAN = "runs incidents top10 activity judged plan"
TEMPLATE = text(prompts.CLASSIFICATION_PROMPT)

_BODY = " || chr(10) || ".join([
    text(fixed.RULE_LINE), text(fixed.NOTICE_TITLE), text(fixed.RULE_LINE),
    f"{text(fixed.NOTICE_JOB)} || f.job_id",
    f"{text(fixed.NOTICE_OWNER)} || {OWNER}",
    f"{text(fixed.NOTICE_TIME)} || strftime(f.first_failed_at, '%Y-%m-%d %H:%M:%S UTC')",
    "''", text(fixed.NOTICE_ERROR), "f.error_message", "''",
    text(fixed.RULE_LINE), text(fixed.NOTICE_FIX_TITLE), text(fixed.RULE_LINE),
    f"{text(fixed.NOTICE_ROOT_CAUSE)} || {_fix_part(0)}", "''",
    text(fixed.NOTICE_STEPS), _steps_lines(), "''",
    f"{text(fixed.NOTICE_PREVENTION)} || {_fix_part(2)}", "''",
    text(fixed.RULE_LINE), text(fixed.NOTICE_FOOTER), text(fixed.RULE_LINE),
])

ORACLE: dict[str, str] = {
    "runs_scan": with_tables("runs", f"SELECT {STATE}, task_run_id FROM runs"),
    "latest_runs_per_job": with_tables("runs", f"""SELECT {STATE} FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs) WHERE rn <= 5"""),
    "recent_runs_top10": with_tables("runs top10", f"SELECT {STATE} FROM top10"),
    "failed_runs": with_tables("runs", f"SELECT {STATE} FROM runs WHERE result_state = 'FAILED'"),
    "lookback": with_tables(
        "runs", f"SELECT {STATE} FROM runs WHERE start_time >= {AS_OF} - INTERVAL 24 HOUR"),
    "last_success_per_job": with_tables(
        "runs top10 activity",
        "SELECT job_id, last_success_at FROM activity WHERE last_success_at IS NOT NULL"),
    "in_progress_jobs": with_tables(
        "runs top10 activity", "SELECT job_id FROM activity WHERE in_progress"),
    "latest_run_status": with_tables("runs", f"""SELECT {STATE} FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs) WHERE rn = 1"""),
    "monitored_runs": with_tables("runs jobs", f"""SELECT {STATE} FROM runs
WHERE job_id IN (SELECT job_id FROM jobs WHERE tag <> 'MACHINERY')"""),
    "monitored_by_tag": with_tables("runs jobs", """SELECT job_id, run_id, result_state FROM runs
WHERE job_id IN (SELECT job_id FROM jobs WHERE tag IN ('BUILDING', 'FURNITURE'))"""),
    "known_run_ids": with_tables("runs incidents known", "SELECT run_id FROM known"),
    "untracked_runs": with_tables(
        "runs incidents known",
        f"SELECT {STATE} FROM runs WHERE run_id NOT IN (SELECT run_id FROM known)"),
    "error_text": with_tables(
        "runs", "SELECT run_id, task_run_id, error_message FROM runs WHERE result_state = 'FAILED'"),
    "detect_new_failures": with_tables(
        DETECTION, "SELECT job_id, run_id, error_message, start_time FROM detected"),
    "detect_monitored_failures": with_tables(
        DETECTION + " jobs", """SELECT job_id, run_id, error_message, start_time FROM detected
WHERE job_id IN (SELECT job_id FROM jobs WHERE tag <> 'MACHINERY')"""),
    "detect_uncapped": with_tables(
        "runs incidents known", f"""SELECT job_id, run_id, error_message, start_time FROM runs
WHERE result_state = 'FAILED' AND start_time >= {AS_OF} - INTERVAL 24 HOUR
  AND run_id NOT IN (SELECT run_id FROM known)"""),
    "valid_events": with_tables("runs", """SELECT run_id,
  CASE WHEN raw_error IS NULL THEN 'scan' ELSE 'event' END AS mode
FROM runs WHERE result_state = 'FAILED'"""),
    "merged_failures": with_tables(DETECTION, f"""
SELECT job_id, run_id, raw_error AS error_message,
  CASE WHEN k % 2 = 0 THEN start_time ELSE {AS_OF} END AS start_time
FROM runs WHERE result_state = 'FAILED' AND raw_error IS NOT NULL
UNION ALL
SELECT job_id, run_id, error_message, start_time FROM detected WHERE raw_error IS NULL"""),
    "classify_rules": with_tables("runs labelled", """SELECT run_id, error_message, classification,
  reasoning, CASE classification WHEN 'Unknown' THEN 'Low' ELSE 'High' END AS confidence,
  'OK' AS parse_status FROM labelled"""),
    "classify_dedup": with_tables("runs labelled", """SELECT run_id, error_message, classification,
  CASE classification WHEN 'Unknown' THEN 'Low' ELSE 'High' END AS confidence FROM labelled"""),
    "decide_status": with_tables(
        "runs labelled",
        f"SELECT run_id, classification, {status('classification')} AS status FROM labelled"),
    "label_confusion": with_tables("runs labelled", f"""SELECT expected, actual, n,
  CASE WHEN expected = actual THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM (SELECT expected, classification AS actual, count(*) AS n FROM labelled
  JOIN (VALUES {EXPECTED}) AS e(error_message, expected) USING (error_message) GROUP BY 1, 2)"""),
    "build_prompt": with_tables(
        "runs labelled", f"SELECT run_id, {TEMPLATE} || error_message AS prompt FROM labelled"),
    "build_fix_prompt": with_tables("runs labelled", f"""SELECT run_id,
  'This failure was judged not to go away by itself.' || chr(10) || chr(10) || 'Job '
  || CASE WHEN k % 3 <> 0 THEN job_id ELSE 'unknown' END
  || ' stopped with this error:' || chr(10) || error_message || chr(10) || chr(10) || 'Why it was judged so:' || chr(10)
  || CASE WHEN k % 2 = 0 THEN 'seen in {{run}} ' || run_id ELSE '' END
  || {text(prompts.FIX_ANSWER)} AS prompt
FROM labelled""".replace("{{", "{").replace("}}", "}")),
    "parse_response": with_tables("runs calls", f"""SELECT run_id,
  CASE WHEN k >= 50 THEN {label('error_message')} ELSE 'Unknown' END AS classification,
  CASE WHEN k < 20 OR k // 10 = 4 THEN 'AI response could not be parsed'
       WHEN k // 10 = 3 THEN 'no label given' ELSE 'read from the text' END AS reasoning,
  CASE WHEN k < 20 OR k // 10 = 4 THEN 'Low' WHEN k // 10 = 3 THEN NULL
       WHEN k // 10 = 2 THEN 'high' ELSE 'High' END AS confidence,
  CASE WHEN k < 20 OR k // 10 = 4 THEN 'PARSE_FAILED' WHEN k < 40 THEN 'INVALID_LABEL'
       ELSE 'OK' END AS parse_status FROM calls"""),
    "parse_status_counts": with_tables("runs calls", """SELECT
  CASE WHEN k < 20 OR k // 10 = 4 THEN 'PARSE_FAILED' WHEN k < 40 THEN 'INVALID_LABEL'
       ELSE 'OK' END AS parse_status, count(*) AS n FROM calls GROUP BY 1"""),
    "parse_fix": with_tables("runs labelled", """SELECT run_id,
  CASE k % 4 WHEN 0 THEN 'cause ' || run_id WHEN 1 THEN 'No root cause provided'
    WHEN 2 THEN 'Fix suggestion generation failed' ELSE said END AS root_cause,
  CASE k % 4 WHEN 0 THEN 'first|second' WHEN 1 THEN 'Review error message manually'
    WHEN 2 THEN CASE said WHEN '' THEN 'Review error message manually' ELSE said END
    ELSE 'Review the error message and job logs manually' END AS fix_steps,
  CASE WHEN k % 4 < 2 THEN 'watch' ELSE 'N/A' END AS prevention
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN '' ELSE 'because of ' || run_id END AS said FROM labelled)"""),
    "model_usage": with_tables("runs calls", f"""SELECT CAST(start_time AS DATE) AS day, count(*) AS calls,
  CAST(sum(length({TEMPLATE}) + length(error_message)) AS BIGINT) AS prompt_chars,
  CAST(sum(coalesce(length(raw_response), 0)) AS BIGINT) AS response_chars FROM calls GROUP BY 1"""),
    "rows_by_status": with_tables("runs incidents", """SELECT tracking_id, job_id, classification,
  retry_count, last_updated_at FROM incidents WHERE status = 'retry_scheduled'"""),
    "insert_incidents": with_tables(DETECTION, f"""SELECT sha256(job_id || ':' || run_id) AS tracking_id,
  job_id, run_id AS original_run_id, run_id AS latest_run_id, error_message,
  CAST(NULL AS VARCHAR) AS classification, 0 AS retry_count, 'detected' AS status,
  start_time AS first_failed_at, {AS_OF} AS last_updated_at, run_id AS all_run_ids FROM detected"""),
    "detect_classify_decide": with_tables(DETECTION, f"""SELECT sha256(job_id || ':' || run_id) AS tracking_id,
  job_id, run_id, error_message, {label('error_message')} AS classification,
  {status(label('error_message'))} AS status FROM detected"""),
    "new_incident_state": with_tables(DETECTION, f"""SELECT sha256(job_id || ':' || run_id) AS tracking_id,
  job_id, run_id AS original_run_id, run_id AS latest_run_id, error_message,
  {label('error_message')} AS classification, 0 AS retry_count,
  {status(label('error_message'))} AS status, run_id AS all_run_ids FROM detected"""),
    "current_state": with_tables(STATE_LOG, """SELECT tracking_id, job_id, original_run_id, latest_run_id,
  error_message, classification, retry_count, status, first_failed_at, last_updated_at,
  array_to_string(run_ids, ',') AS all_run_ids, next_retry_at, version FROM state"""),
    "run_history": with_tables(STATE_LOG, """SELECT tracking_id, CAST(i - 1 AS INTEGER) AS pos, run_ids[i] AS run_id
FROM (SELECT tracking_id, run_ids, unnest(range(1, len(run_ids) + 1)) AS i FROM state)"""),
    "apply_updates": with_tables(STATE_LOG, """SELECT tracking_id, latest_run_id, classification, retry_count,
  status, last_updated_at, array_to_string(run_ids, ',') AS all_run_ids, version FROM state"""),
    "evolve_schema": with_tables("runs incidents", """SELECT tracking_id, status,
  CAST(NULL AS TIMESTAMP) AS next_retry_at, CAST(NULL AS VARCHAR) AS fix_suggestion FROM incidents"""),
    "backfill_run_ids": with_tables("runs incidents", """SELECT tracking_id, original_run_id, latest_run_id,
  array_to_string(all_run_ids, ',') AS all_run_ids FROM incidents"""),
    "illegal_transitions": with_tables("runs incidents log", """SELECT tracking_id, seq, from_status, to_status
FROM (SELECT tracking_id, seq, status AS to_status,
    lag(status) OVER (PARTITION BY tracking_id ORDER BY ts, seq) AS from_status FROM log)
WHERE coalesce(from_status, '') || '>' || to_status NOT IN ("""
    + ", ".join(text(f"{a or ''}>{b}") for a, b in fixed.LEGAL_TRANSITIONS) + ")"),
    "due_rows": with_tables("runs incidents", f"""SELECT tracking_id, job_id, last_updated_at,
  epoch_us({AS_OF}) - epoch_us(last_updated_at) AS waited_micros FROM incidents
WHERE status = 'retry_scheduled' AND {AS_OF} - last_updated_at >= INTERVAL 15 MINUTE"""),
    "due_rows_v2": with_tables(STATE_LOG, f"""SELECT tracking_id, job_id, next_retry_at FROM state
WHERE status = 'retry_scheduled' AND coalesce(next_retry_at <= {AS_OF}, last_updated_at <= {AS_OF} - INTERVAL 15 MINUTE)"""),
    "newer_success": with_tables("runs incidents top10 activity", """
SELECT i.tracking_id, i.job_id, i.first_failed_at, a.last_success_at
FROM incidents i JOIN activity a ON a.job_id = i.job_id
WHERE EXISTS (SELECT 1 FROM top10 t WHERE t.job_id = i.job_id AND t.result_state = 'SUCCESS'
  AND epoch_ms(t.start_time) > epoch_ms(i.first_failed_at))"""),
    "plan_retries": with_tables(PLAN, "SELECT tracking_id, job_id, action FROM plan"),
    "plan_retries_v2": with_tables(
        STATE_LOG + " top10 activity judged_v2 plan", "SELECT tracking_id, job_id, action FROM plan"),
    "retry_requests": with_tables(PLAN, f"""SELECT sha256(tracking_id || ':' || (retry_count + 1)) AS request_id,
  tracking_id, job_id, {AS_OF} AS requested_at FROM plan WHERE action = 'retry'"""),
    "apply_retry_acks": with_tables("runs incidents", """SELECT tracking_id,
  'a' || original_run_id AS latest_run_id, retry_count + 1 AS retry_count, 'retried' AS status,
  original_run_id || ',a' || original_run_id AS all_run_ids
FROM incidents WHERE status = 'retry_scheduled' AND CAST(original_run_id AS BIGINT) % 3 <> 0"""),
    "check_outcomes": with_tables("runs incidents outcome", """SELECT tracking_id, job_id, run_id, retry_count,
  error_message, classification, status FROM outcome"""),
    "fix_suggestions": with_tables("runs incidents fixed", f"""SELECT tracking_id, {_fix_part(0)} AS root_cause,
  {_fix_part(1)} AS fix_steps, {_fix_part(2)} AS prevention FROM fixed"""),
    "store_fix": with_tables(STATE_LOG + " fixed", f"""SELECT s.tracking_id, s.status, s.last_updated_at,
  CASE WHEN f.rule IS NOT NULL THEN {_fix_part(0)} END AS root_cause,
  CASE WHEN f.rule IS NOT NULL THEN {_fix_part(2)} END AS prevention,
  CASE WHEN f.rule IS NOT NULL THEN 3 END AS n_steps
FROM state s LEFT JOIN fixed f ON f.tracking_id = s.tracking_id"""),
    "notify_owner": with_tables("runs incidents jobs", f"""SELECT i.tracking_id, i.job_id, {OWNER} AS owner
FROM incidents i LEFT JOIN jobs j ON j.job_id = i.job_id"""),
    "notifications": with_tables("runs incidents fixed jobs", f"""SELECT f.job_id, {OWNER} AS notified_user,
  f.error_message, {reasoning('f.error_message')} AS ai_reasoning, {_fix_part(0)} AS root_cause,
  {AS_OF} AS notification_time, strftime({AS_OF}, '%Y-%m-%d %H:%M:%S UTC') AS sent_text
FROM fixed f LEFT JOIN jobs j ON j.job_id = f.job_id"""),
    "notification_body": with_tables("runs incidents fixed jobs", f"""SELECT f.tracking_id, {_BODY} AS body
FROM fixed f LEFT JOIN jobs j ON j.job_id = f.job_id"""),
    "status_counts": with_tables(
        "runs incidents", "SELECT status, count(*) AS n FROM incidents GROUP BY status"),
    "recent_incidents": with_tables("runs incidents", """SELECT tracking_id, job_id, classification, status,
  retry_count, first_failed_at FROM incidents ORDER BY first_failed_at DESC, tracking_id DESC LIMIT 5"""),
    "job_history": with_tables("runs incidents", """SELECT job_id, first_failed_at, tracking_id, original_run_id,
  latest_run_id, status FROM incidents ORDER BY job_id, first_failed_at DESC, tracking_id DESC"""),
    "review_queue": with_tables("runs incidents", """SELECT tracking_id, job_id, error_message, first_failed_at
FROM incidents WHERE status = 'unknown_flagged'"""),
    "escalations": with_tables("runs incidents outcome", """SELECT tracking_id, job_id, retry_count
FROM outcome WHERE status = 'max_retries_reached'"""),
    "audit_report": with_tables("runs incidents", """SELECT job_id, classification, count(*) AS incidents,
  CAST(sum(retry_count) AS BIGINT) AS retries,
  count(*) FILTER (WHERE status IN ('detected', 'retry_scheduled', 'retried')) AS still_open,
  min(first_failed_at) AS first_failure, max(last_updated_at) AS last_update
FROM incidents GROUP BY job_id, classification"""),
    "apply_corrections": with_tables("runs incidents", """SELECT tracking_id,
  CASE WHEN status <> 'unknown_flagged' THEN classification
       WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'Transient' ELSE 'Permanent' END AS classification,
  CASE WHEN status <> 'unknown_flagged' THEN status
       WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'retry_scheduled'
       ELSE 'permanent_no_action' END AS status FROM incidents"""),
    "run_cycle": with_tables("runs top10 activity", f"""
, first_pass AS (
  SELECT *, {label('error_message')} AS classification
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs)
  WHERE rn <= 5 AND start_time >= {AS_OF} - INTERVAL 24 HOUR AND result_state = 'FAILED'),
judged AS (
  SELECT f.*, CASE WHEN classification <> 'Transient' THEN 'other'
    WHEN date_trunc('millisecond', a.last_success_at) > date_trunc('millisecond', f.start_time) THEN 'resolved'
    WHEN a.in_progress THEN 'wait' ELSE 'free' END AS verdict
  FROM first_pass f JOIN activity a ON a.job_id = f.job_id)
SELECT job_id, run_id AS original_run_id, classification,
  CASE WHEN verdict = 'resolved' THEN 'resolved' ELSE {status('classification')} END AS status,
  verdict = 'free' AND row_number() OVER (PARTITION BY job_id, verdict
    ORDER BY start_time, sha256(job_id || ':' || run_id)) = 1 AS requested
FROM judged"""),
    "stream_runs": with_tables("runs labelled", f"""SELECT job_id, run_id AS original_run_id, error_message,
  classification, {status('classification')} AS status FROM labelled"""),
    "stream_failure_events": with_tables(
        "runs labelled", f"""SELECT job_id, run_id AS original_run_id,
  error_message, classification, {status('classification')} AS status,
  raw_error IS NOT NULL AND k % 2 <> 0 AS undated,
  CASE WHEN raw_error IS NULL OR k % 2 = 0 THEN start_time END AS first_failed_at,
  CASE WHEN classification = 'Permanent' THEN {_fix_part(0)} END AS root_cause
FROM (SELECT *, {_rule('error_message')} AS rule FROM labelled)"""),
    "stream_failure_events_scanned": with_tables(
        "runs labelled", f"""SELECT job_id, run_id AS original_run_id,
  error_message, classification, {status('classification')} AS status,
  raw_error IS NOT NULL AND k % 2 <> 0 AS undated,
  CASE WHEN raw_error IS NULL OR k % 2 = 0 THEN start_time END AS first_failed_at,
  CASE WHEN classification = 'Permanent' THEN {_fix_part(0)} END AS root_cause
FROM (SELECT *, {_rule('error_message')} AS rule FROM labelled)"""),
}

ORACLE |= {
    "timeline_runs": with_tables("runs", """SELECT job_id, run_id, start_time,
  CASE WHEN result_state IS NULL THEN 'RUNNING' ELSE 'TERMINATED' END AS life_cycle_state, result_state FROM runs"""),
    "detect_from_timeline": ORACLE["detect_new_failures"],
    "latest_runs_tied": with_tables("runs", f"""SELECT {STATE} FROM (
  SELECT * REPLACE (date_trunc('day', start_time)::TIMESTAMP AS start_time),
    row_number() OVER (PARTITION BY job_id ORDER BY date_trunc('day', start_time) DESC, event_id DESC) AS rn FROM runs) WHERE rn <= 5"""),
    "recent_runs_merged": ORACLE["recent_runs_top10"],
    "in_progress_merged": ORACLE["in_progress_jobs"],
    "newer_success_merged": ORACLE["newer_success"],
    "plan_retries_merged": ORACLE["plan_retries"],
    "store_state": ORACLE["apply_updates"],
    "store_known_ids": with_tables("runs incidents log", f"""SELECT run_id FROM log
WHERE event IN ('detected', 'retried') AND ts >= {AS_OF} - INTERVAL 48 HOUR"""),
    "run_retries": with_tables("runs incidents log", f"""
, seen AS (SELECT * FROM runs WHERE start_time <= {SEEN}),
past AS (
  SELECT l.tracking_id, any_value(l.job_id) AS job_id,
    arg_max(l.classification, l.seq) FILTER (WHERE l.classification IS NOT NULL) AS classification,
    CAST(count(*) FILTER (WHERE l.event = 'retried') AS INTEGER) AS retry_count, arg_max(l.status, l.seq) AS status,
    min(l.ts) AS first_failed_at, max(l.ts) AS last_updated_at,
    arg_max(l.run_id, l.seq) FILTER (WHERE l.event IN ('detected', 'retried')) AS latest_run_id
  FROM log l WHERE l.ts <= {SEEN} GROUP BY l.tracking_id),
outcome AS (
  SELECT p.*, CASE WHEN p.status = 'detected' THEN {label('i.error_message')}
      WHEN p.status = 'retried' AND r.result_state NOT IN ('SUCCESS') AND p.retry_count < 3 THEN {label('r.error_message')} END AS new_label,
    CASE WHEN p.status = 'detected' THEN {status(label('i.error_message'))}
      WHEN p.status <> 'retried' THEN NULL WHEN r.result_state IS NULL THEN 'still_running'
      WHEN r.result_state = 'SUCCESS' THEN 'resolved' WHEN p.retry_count >= 3 THEN 'max_retries_reached'
      ELSE {status(label('r.error_message'))} END AS outcome
  FROM past p JOIN incidents i ON i.tracking_id = p.tracking_id LEFT JOIN seen r ON r.run_id = p.latest_run_id),
lease AS (SELECT DISTINCT job_id FROM outcome WHERE outcome = 'still_running'),
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM seen) WHERE rn <= 10),
act AS (SELECT job_id, max(start_time) FILTER (WHERE result_state = 'SUCCESS') AS last_success_at,
  bool_or(life_cycle_state IN ('RUNNING', 'PENDING')) AS in_progress FROM ten GROUP BY job_id),
judged AS (
  SELECT o.*, CASE WHEN o.status <> 'retry_scheduled' THEN 'other'
    WHEN o.last_updated_at + INTERVAL 24 HOUR > {SEEN} THEN 'not_due'
    WHEN epoch_ms(a.last_success_at) > epoch_ms(o.first_failed_at) THEN 'resolved'
    WHEN a.in_progress OR o.job_id IN (SELECT job_id FROM lease) THEN 'wait' ELSE 'free' END AS verdict
  FROM outcome o LEFT JOIN act a ON a.job_id = o.job_id),
done AS (
  SELECT *, CASE WHEN verdict = 'resolved' THEN 'resolved' WHEN outcome IS NULL OR outcome = 'still_running' THEN status ELSE outcome END AS now,
    verdict = 'free' AND row_number() OVER (PARTITION BY job_id, verdict ORDER BY first_failed_at, tracking_id) = 1 AS requested
  FROM judged)
SELECT tracking_id, coalesce(new_label, classification) AS classification, retry_count, now AS status,
  CASE WHEN now <> 'retry_scheduled' THEN NULL WHEN status = 'retry_scheduled' THEN last_updated_at + INTERVAL 24 HOUR
    ELSE {SEEN} + INTERVAL 24 HOUR END AS next_retry_at, requested FROM done"""),
    "run_cycle_acked": with_tables("runs top10 activity", f"""
, first_pass AS (
  SELECT *, {label('error_message')} AS classification
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id {NEWEST}) AS rn FROM runs)
  WHERE rn <= 5 AND start_time >= {AS_OF} - INTERVAL 24 HOUR AND result_state = 'FAILED'),
judged AS (
  SELECT f.*, event_id % 3 AS third, CASE WHEN event_id % 2 = 0 THEN {text(sample.ERRORS[3][0])} ELSE {text(sample.ERRORS[0][0])} END AS again,
    CASE WHEN classification <> 'Transient' THEN 'other'
    WHEN date_trunc('millisecond', a.last_success_at) > date_trunc('millisecond', f.start_time) THEN 'resolved'
    WHEN a.in_progress THEN 'wait' ELSE 'free' END AS verdict
  FROM first_pass f JOIN activity a ON a.job_id = f.job_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id, verdict ORDER BY start_time, sha256(job_id || ':' || run_id)) AS place FROM judged),
tried AS (SELECT *, verdict = 'free' AND place = 1 AS tried, max(CASE WHEN verdict = 'free' AND place = 1 THEN third END) OVER (PARTITION BY job_id) AS came FROM placed)
SELECT job_id, run_id AS original_run_id, CASE WHEN tried THEN 'a' || run_id ELSE run_id END AS latest_run_id,
  CASE WHEN tried AND third = 1 THEN {label('again')} ELSE classification END AS classification,
  CASE WHEN tried THEN 1 ELSE 0 END AS retry_count,
  CASE WHEN verdict = 'other' THEN {status('classification')} WHEN verdict = 'resolved' THEN 'resolved' WHEN verdict = 'wait' THEN 'retry_scheduled'
    WHEN tried THEN CASE third WHEN 0 THEN 'resolved' WHEN 1 THEN {status(label('again'))} ELSE 'retried' END
    WHEN came = 0 THEN 'resolved' ELSE 'retry_scheduled' END AS status,
  tried OR (verdict = 'free' AND place = 2 AND came = 1) AS requested
FROM tried"""),
    "store_corrections": with_tables("runs incidents", f"""SELECT tracking_id, s.classification, s.status,
  CASE WHEN s.status = 'retry_scheduled' THEN {AS_OF} + INTERVAL 15 MINUTE END AS next_retry_at,
  CAST(CASE WHEN i.status = 'unknown_flagged' THEN 3 ELSE 2 END AS INTEGER) AS version, false AS illegal
FROM (SELECT tracking_id, status FROM incidents WHERE classification <> 'Transient') i JOIN (
  SELECT tracking_id AS id,
  CASE WHEN status <> 'unknown_flagged' THEN classification WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'Transient' ELSE 'Permanent' END AS classification,
  CASE WHEN status <> 'unknown_flagged' THEN status WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'retry_scheduled' ELSE 'permanent_no_action' END AS status
  FROM incidents) s ON s.id = i.tracking_id"""),
    "state_as_of": with_tables("runs incidents log", f"""SELECT tracking_id,
  arg_max(classification, seq) FILTER (WHERE classification IS NOT NULL) AS classification,
  CAST(count(*) FILTER (WHERE event = 'retried') AS INTEGER) AS retry_count, arg_max(status, seq) AS status,
  max(ts) AS last_updated_at, max(seq) AS version FROM log WHERE ts <= {SEEN} GROUP BY tracking_id"""),
}
_CORRECTED = """
, given AS (SELECT * FROM log UNION ALL SELECT tracking_id, 3, 'corrected', first_failed_at + INTERVAL 2 HOUR, job_id, NULL,
  CASE WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'Transient' ELSE 'Permanent' END,
  CASE WHEN CAST(original_run_id AS BIGINT) % 2 = 0 THEN 'retry_scheduled' ELSE 'permanent_no_action' END
  FROM incidents WHERE status = 'unknown_flagged')"""
ORACLE |= {
    "audit_report_log": with_tables("runs incidents log", f"""{_CORRECTED},
folded AS (SELECT tracking_id, any_value(job_id) AS job_id, arg_max(classification, seq) FILTER (WHERE classification IS NOT NULL) AS classification,
  arg_max(status, seq) AS status, count(*) FILTER (WHERE event = 'retried') AS retries, count(DISTINCT classification) > 1 AS changed,
  bool_or(event = 'corrected') AS by_person, min(ts) AS first_failed_at, max(ts) AS last_updated_at
  FROM given WHERE ts <= {SEEN} GROUP BY tracking_id)
SELECT job_id, classification, count(*) AS incidents, CAST(sum(retries) AS BIGINT) AS retries,
  count(*) FILTER (WHERE status IN ('detected', 'retry_scheduled', 'retried')) AS still_open,
  count(*) FILTER (WHERE changed) AS reclassified, count(*) FILTER (WHERE by_person) AS corrected,
  min(first_failed_at) AS first_failure, max(last_updated_at) AS last_update FROM folded GROUP BY job_id, classification"""),
    "label_lineage": with_tables("runs incidents log", f"""{_CORRECTED}
SELECT tracking_id, seq, event, classification AS label, lag(classification) OVER (PARTITION BY tracking_id ORDER BY seq) AS label_before
FROM given WHERE classification IS NOT NULL"""),
    "stream_timeline": with_tables("runs", """SELECT job_id, run_id, start_time, result_state, task_run_id
FROM runs WHERE result_state IS NOT NULL"""),
}
