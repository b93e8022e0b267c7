"""The SQL counterpart of every query, answered by DuckDB straight from the events."""

from __future__ import annotations

import re

from contract.flat import FLAT_SQL
from contract.registry import AS_OF, EMAIL, TODAY

D = f"DATE '{AS_OF[:10]}'"
TODAY_D = f"DATE '{TODAY[:10]}'"


def isum(expression: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT)"


def cnt(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def r6(expression: str) -> str:
    return f"round({expression}, 6)"


def div(numerator: str, denominator: str) -> str:
    return f"CAST({numerator} AS DOUBLE) / nullif(CAST({denominator} AS DOUBLE), 0)"


USAGE = f"""count(*) AS request_count, count(DISTINCT {{U}}) AS distinct_users,
 {isum('input_tokens')} AS total_input_tokens, {isum('output_tokens')} AS total_output_tokens,
 {isum('total_tokens')} AS total_tokens, avg(duration_ms) AS average_duration_ms,
 count(error_code) AS error_count"""

PROJECT_LOG = "projects/demo/logs/gemini_cli"

# Each CTE may use the ones above it. {U} is the user column.
CTES = {
    "flat": FLAT_SQL,
    "av": """SELECT *, ts AS "timestamp", CAST(ts AS DATE) AS day,
 ts + to_seconds(event_id % 90) AS "receiveTimestamp",
 sha256(coalesce(user_email, 'unknown')) AS user_pseudonym FROM flat""",
    "daily_metrics": f"SELECT day, event_name, model, {USAGE} FROM av GROUP BY ALL",
    "user_activity": f"""SELECT {{U}}, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS total_requests,
 count(DISTINCT session_id) AS total_sessions, avg(duration_ms) AS average_request_duration_ms,
 {isum('total_tokens')} AS total_tokens_used FROM av WHERE {{U}} IS NOT NULL GROUP BY {{U}}""",
    "token_usage": f"""SELECT day, {{U}}, model, {isum('input_tokens')} AS total_input_tokens,
 {isum('output_tokens')} AS total_output_tokens, {isum('cached_tokens')} AS total_cached_tokens,
 {isum('total_tokens')} AS grand_total_tokens FROM av WHERE total_tokens IS NOT NULL GROUP BY ALL""",
    "error_analysis": """SELECT day, cli_version, model, error_code, error_message, count(*) AS error_count,
 count(DISTINCT {U}) AS distinct_users_affected FROM av WHERE error_code IS NOT NULL GROUP BY ALL""",
    "malformed_json_responses": """SELECT day, model, {U}, count(*) AS malformed_json_count FROM av
 WHERE event_name = 'gemini_cli.malformed_json_response' GROUP BY ALL""",
    "feature_adoption": f"""SELECT day, {{U}}, cli_version,
 {cnt("event_name = 'gemini_cli.slash_command'")} AS slash_command_usage_count,
 {cnt("event_name = 'gemini_cli.agent.start'")} AS agent_mode_usage_count,
 {cnt("event_name = 'gemini_cli.extension_install'")} AS extension_install_count FROM av
 WHERE event_name IN ('gemini_cli.slash_command', 'gemini_cli.agent.start', 'gemini_cli.extension_install')
 GROUP BY ALL""",
    "conversation_analysis": """SELECT day, {U}, cli_version, approval_mode, count(*) AS conversation_count,
 avg(turn_count) AS avg_turn_count, min(turn_count) AS min_turn_count, max(turn_count) AS max_turn_count
 FROM av WHERE event_name = 'gemini_cli.conversation_finished' GROUP BY ALL""",
    "tool_performance": f"""SELECT day, model, function_name, count(*) AS total_calls,
 {cnt('error_code IS NULL')} AS successful_calls, count(error_code) AS failed_calls,
 {div(cnt('error_code IS NULL'), 'count(*)')} AS success_rate, avg(duration_ms) AS average_execution_duration_ms
 FROM av WHERE function_name IS NOT NULL GROUP BY ALL""",
    "cli_resilience": f"""SELECT day, model, {cnt("event_name = 'gemini_cli.flash_fallback'")} AS flash_fallback_count,
 {cnt("event_name = 'gemini_cli.chat.content_retry'")} AS content_retry_count,
 {cnt("event_name = 'gemini_cli.chat.content_retry_failure'")} AS content_retry_failure_count,
 avg(tokens_before) AS avg_tokens_before_compression, avg(tokens_after) AS avg_tokens_after_compression,
 {div('sum(tokens_before - tokens_after)', 'sum(tokens_before)')} AS avg_compression_ratio FROM av
 WHERE event_name IN ('gemini_cli.flash_fallback', 'gemini_cli.chat.content_retry',
  'gemini_cli.chat.content_retry_failure', 'gemini_cli.chat_compression') GROUP BY ALL""",
    "model_routing_analysis": f"""SELECT day, decision_source, decision_model, count(*) AS decision_count,
 {cnt('failed')} AS failure_count, {div(cnt('failed'), 'count(*)')} AS failure_rate,
 avg(routing_latency_ms) AS avg_routing_latency_ms
 FROM av WHERE event_name = 'gemini_cli.model_routing' GROUP BY ALL""",
    "minutes": f"""SELECT day, date_trunc('hour', ts) AS "hour", date_trunc('minute', ts) AS "minute", {{U}}, model,
 {cnt("event_name = 'gemini_cli.api_response'")} AS requests_per_minute,
 {cnt('status_code = 429')} AS error_429_count_per_minute, {cnt('status_code >= 400')} AS total_errors_per_minute,
 {isum('input_tokens')} AS input_tokens_per_minute, {isum('output_tokens')} AS output_tokens_per_minute,
 {isum('total_tokens')} AS total_tokens_per_minute FROM av
 WHERE {{U}} IS NOT NULL AND event_name IN ('gemini_cli.api_response', 'gemini_cli.api_error') GROUP BY ALL""",
    "quota_tracking": """SELECT *,
 CAST(sum(error_429_count_per_minute) OVER (PARTITION BY day, "hour", {U}, model) AS BIGINT) AS error_429_count_per_hour,
 CAST(sum(error_429_count_per_minute) OVER (PARTITION BY day, {U}, model) AS BIGINT) AS error_429_count_per_day,
 CAST(sum(requests_per_minute) OVER (PARTITION BY day, {U}, model) AS BIGINT) AS requests_per_day FROM minutes""",
    "user_configuration": """SELECT {U}, cli_version, CAST(sandbox_enabled AS VARCHAR) AS sandbox_enabled,
 CAST(log_user_prompts_enabled AS VARCHAR) AS log_prompts_enabled, output_format, extensions, extension_count,
 ts AS last_config_timestamp FROM av WHERE event_name = 'gemini_cli.config'
 QUALIFY row_number() OVER (PARTITION BY {U} ORDER BY ts DESC, insert_id DESC) = 1""",
    "sample_429": """SELECT ts AS "timestamp", model, error_message, status_code, {U}, insert_id FROM av
 WHERE status_code = 429 ORDER BY ts DESC, insert_id DESC LIMIT 250""",
    "summary_429": """SELECT count(*) AS total_429_errors,
 (SELECT count(*) FROM av WHERE status_code = 429) AS all_429_errors, min("timestamp") AS oldest_error,
 max("timestamp") AS newest_error, concat('Patterns: ', (SELECT string_agg(concat(n, 'x ', message), '; '
  ORDER BY n DESC, message) FROM (SELECT coalesce(error_message, 'No message') AS message, count(*) AS n
  FROM sample_429 GROUP BY 1)), '. Models: ',
  (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT coalesce(model, 'unknown') AS m FROM sample_429)),
  '. Users affected: ', count(DISTINCT coalesce({U}, 'unknown'))) AS error_summary
 FROM sample_429 HAVING count(*) > 0""",
    "rollup": f"SELECT day, model, {USAGE} FROM av GROUP BY ALL",
    "weekly": f"SELECT day - CAST(dayofweek(day) AS INTEGER) AS week_start_date, model, {USAGE} FROM av GROUP BY ALL",
    "alerts": f"""SELECT {D} AS alert_date, {{U}} AS user_identifier, model, 'RPM_EXCEEDED' AS alert_type,
 requests_per_minute AS current_value, CAST({{RPM}} AS BIGINT) AS quota_limit, "minute" AS violation_time
 FROM quota_tracking WHERE requests_per_minute > {{RPM}} AND "minute" >= TIMESTAMP '{AS_OF}' - INTERVAL {{LOOKBACK}} MINUTE
 UNION ALL SELECT {D}, {{U}}, model, 'RPD_EXCEEDED', requests_per_day, CAST({{RPD}} AS BIGINT), NULL
 FROM (SELECT * FROM quota_tracking WHERE requests_per_day > {{RPD}} AND day = {D} - 1
 QUALIFY row_number() OVER (PARTITION BY {{U}}, model, day ORDER BY "minute" DESC) = 1)""",
    "conversations": "SELECT * FROM av WHERE event_name = 'gemini_cli.conversation_finished'",
}


def _used(text: str) -> list[str]:
    """CTEs that a text needs, in definition order."""
    needed: set[str] = set()
    pending = [text]
    while pending:
        words = set(re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z_0-9]+)", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    return [name for name in CTES if name in needed]


def query(final: str, user: str = "user_email", rpm: int = 0, rpd: int = 2, lookback: int = 1440) -> str:
    values = {"{U}": user, "{RPM}": str(rpm), "{RPD}": str(rpd), "{LOOKBACK}": str(lookback)}

    def fill(text: str) -> str:
        for mark, value in values.items():
            text = text.replace(mark, value)
        return text

    ctes = ",\n".join(f"{name} AS ({fill(CTES[name])})" for name in _used(final))
    return f"WITH {ctes}\n{fill(final)}" if ctes else fill(final)


def rounded(table: str, columns: str, *doubles: str) -> str:
    """Select with the listed double columns rounded."""
    replaced = ", ".join(f'{r6(d)} AS {d}' for d in doubles)
    return f"SELECT {columns}{' REPLACE (' + replaced + ')' if replaced else ''} FROM {table}"


RAW_TEXT = """severity,
 '{"type":"global","labels":{"project_id":"' || resource_project_id || '"}}' AS resource_json,
 CASE WHEN cli_version IS NOT NULL THEN '{"cli_version":"' || cli_version || '"}' END AS labels_json,
 CASE WHEN operation_id IS NOT NULL THEN '{"id":"' || operation_id || '"}' END AS operation_json,
 CAST(NULL AS VARCHAR) AS "httpRequest_json", trace, CAST(NULL AS VARCHAR) AS "spanId" """

RAW = f"""SELECT ts AS "timestamp", "receiveTimestamp", '{PROJECT_LOG}' AS "logName", insert_id AS "insertId",
 {RAW_TEXT}, event_name AS payload_event FROM av"""

VIEW_COLUMNS = """event_name, CAST(NULL AS VARCHAR) AS event_domain, CAST(NULL AS VARCHAR) AS event_timestamp,
 session_id, installation_id, model, CAST(NULL AS VARCHAR) AS model_name, CAST(NULL AS VARCHAR) AS auth_type,
 CAST(NULL AS VARCHAR) AS prompt_id, CAST(NULL AS VARCHAR) AS gen_ai_request_model, temperature, top_p, top_k,
 max_output_tokens, finish_reason, input_tokens, output_tokens, cached_tokens, thoughts_tokens, tool_tokens,
 total_tokens, gen_ai_input_tokens, gen_ai_output_tokens, function_name, function_args,
 duration_ms AS function_duration_ms, function_success, tool_type, mcp_server_name, duration_ms, status_code,
 error, error_message, error_code, resource_project_id, {U}, cli_version"""

VIEW = f"""SELECT ts AS "timestamp", "receiveTimestamp", '{PROJECT_LOG}' AS "logName", insert_id AS "insertId",
 {RAW_TEXT}, {VIEW_COLUMNS.replace('duration_ms AS', 'round(duration_ms, 6) AS').replace(', duration_ms,', ', round(duration_ms, 6) AS duration_ms,')}
 FROM av"""

EXTRACTED = [
    "event_name", "event_domain", "event_timestamp", "session_id", "installation_id", "model", "model_name",
    "auth_type", "prompt_id", "gen_ai_request_model", "temperature", "top_p", "top_k", "max_output_tokens",
    "finish_reason", "input_tokens", "output_tokens", "cached_tokens", "thoughts_tokens", "tool_tokens",
    "total_tokens", "gen_ai_input_tokens", "gen_ai_output_tokens", "function_name", "function_args",
    "function_duration_ms", "function_success", "tool_type", "mcp_server_name", "duration_ms", "status_code",
    "error", "error_message", "error_code", "resource_project_id", "user_email", "cli_version",
]
# Filled by the faults that the registry adds, in every third event that is no inference event.
ADDED = {"event_domain", "event_timestamp", "model_name", "auth_type", "prompt_id", "gen_ai_request_model"}


def _coverage() -> str:
    def filled(name: str) -> str:
        if name in ADDED:
            return cnt("event_id % 3 = 0 AND event_id % 31 <> 0")
        if name == "cli_version":
            return cnt("cli_version IS NOT NULL AND event_id % 17 <> 0")
        return f"count({name.replace('function_duration', 'duration')})"

    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {filled(name)} AS filled, count(*) AS total_rows FROM av" for name in EXTRACTED
    )
    return f"SELECT *, round(CAST(filled AS DOUBLE) / total_rows, 6) AS share FROM ({rows})"


def _validity() -> str:
    present = {
        "resource_json": "count(*)", "labels_json": "count(cli_version)", "operation_json": "count(operation_id)",
        "httpRequest_json": cnt("event_id % 29 = 0"), "jsonPayload_json": "count(*)",
    }
    invalid = {"labels_json": cnt("cli_version IS NOT NULL AND event_id % 17 = 0")}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, {n} AS present, {n} - {invalid.get(name, '0')} AS valid, "
        f"CAST({invalid.get(name, '0')} AS BIGINT) AS invalid FROM av"
        for name, n in present.items()
    )


# Column, type and description of the raw table, written out once more so that the check has its own text.
RAW_DOC = """timestamp|timestamp|When the event happened, in UTC; the day partition follows it
receiveTimestamp|timestamp|When the message arrived; the earliest copy of a message is kept
logName|string|Log that the message was routed from; files are sorted by it
insertId|string|Id that redelivered copies share; without it a row is never a copy
severity|string|Level as sent, not interpreted
resource_json|string|Where it ran, as JSON text; holds the project
labels_json|string|Client labels as JSON text; holds the version of the client
operation_json|string|Operation that the event belongs to, as JSON text
httpRequest_json|string|HTTP details as JSON text, for events that have them
jsonPayload_json|string|The event itself as JSON text, keys with dots kept flat; the base view types it
trace|string|Trace that the event belongs to, if any
spanId|string|Span within that trace, if any
day|date|Partition: date of timestamp, empty where that can't be read
batch|string|Partition: ingest batch that owns the row""".split("\n")


def _schema_doc() -> str:
    filled = {
        "labels_json": "count(cli_version)", "operation_json": "count(operation_id)", "httpRequest_json": "count(NULL)",
        "trace": "count(trace)", "spanId": "count(NULL)",
    }
    rows = []
    for position, line in enumerate(RAW_DOC, 1):
        name, kind, text = line.split("|")
        text = text.replace("'", "''")
        rows.append(
            f"SELECT {position} AS position, '{name}' AS column_name, '{kind}' AS data_type, '{text}' AS description, "
            f"CAST({filled.get(name, 'count(*)')} AS BIGINT) AS filled_rows FROM av"
        )
    return " UNION ALL ".join(rows)


OUTPUT_COUNTS = {
    "daily_metrics": "daily_metrics", "vw_user_activity": "user_activity", "vw_error_analysis": "error_analysis",
    "vw_tool_performance": "tool_performance", "vw_cli_performance_and_resilience": "cli_resilience",
    "vw_model_routing_analysis": "model_routing_analysis", "vw_token_usage": "token_usage",
    "vw_malformed_json_responses": "malformed_json_responses", "vw_feature_adoption": "feature_adoption",
    "vw_conversation_analysis": "conversation_analysis", "vw_quota_tracking": "quota_tracking",
    "vw_user_configuration": "user_configuration", "vw_429_error_summary": "summary_429",
    "daily_rollup_table": f"rollup WHERE day = {D} - 1", "quota_alerts_table": "alerts",
    "weekly_rollup_table": f"weekly WHERE week_start_date = {D} - 10",
}


def _catalog(extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, '{'table' if name.endswith('_table') else 'view'}' AS kind, {extra}"
        f"true AS present, (SELECT count(*) FROM {source}) AS row_count"
        for name, source in OUTPUT_COUNTS.items()
    )


def _user_views() -> dict[str, str]:
    prompt = """'Each line below is one request that was refused with status 429, newest first. Which single change to ' ||
 'quotas or to the choice of model would have avoided most of them, and what share is that?' || chr(10) || """
    lines = """string_agg(concat('Timestamp: ', strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f'), ', User: ',
 coalesce({U}, 'unknown'), ', Model: ', coalesce(model, 'unknown'), ', Error: ',
 substr(coalesce(error_message, 'No message'), 1, 200)), chr(10) ORDER BY "timestamp" DESC, insert_id DESC)"""
    return {
        "daily_metrics": rounded("daily_metrics", "*", "average_duration_ms"),
        "user_activity": rounded("user_activity", "*", "average_request_duration_ms"),
        "token_usage": "SELECT * FROM token_usage",
        "error_analysis": "SELECT * FROM error_analysis",
        "malformed_json_responses": "SELECT * FROM malformed_json_responses",
        "feature_adoption": "SELECT * FROM feature_adoption",
        "conversation_analysis": rounded("conversation_analysis", "*", "avg_turn_count"),
        "quota_tracking": "SELECT * FROM quota_tracking",
        "user_configuration": "SELECT * FROM user_configuration",
        "error_429_sample": "SELECT * EXCLUDE (insert_id) FROM sample_429",
        "error_429_prompt": f"""SELECT count(*) AS total_429_errors, min("timestamp") AS oldest_error,
 max("timestamp") AS newest_error, {prompt}{lines} AS prompt FROM sample_429 HAVING count(*) > 0""",
        "error_429_summary": "SELECT * FROM summary_429",
        "quota_alerts": "SELECT * FROM alerts",
        "daily_rollup": rounded("rollup", "*", "average_duration_ms") + f" WHERE day = {D} - 1",
        "weekly_rollup": rounded("weekly", "*", "average_duration_ms")
        + f" WHERE week_start_date = ({D} - 7) - CAST(dayofweek({D} - 7) AS INTEGER)",
    }


def _finals() -> dict[str, str]:
    last7, last14, last30 = f"day >= {D} - 7", f"day >= {D} - 14", f"day >= {D} - 30"
    per_day = f"SELECT day, {isum('error_429_count_per_minute')} AS e, {isum('requests_per_minute')} AS r"
    share = "{0}, {1}, round(CAST({1} AS DOUBLE) / sum({1}) OVER (), 6) AS share"
    api_ids = "event_id % 97 = 0"
    tools7 = f"av WHERE function_name IS NOT NULL AND {last7}"
    raw_days = "SELECT day, count(*) AS row_count FROM av"
    not_user = f"coalesce(user_email, '') <> '{EMAIL}'"
    tp7 = f"tool_performance WHERE {last7} GROUP BY function_name"
    return {
        "ingest_raw_logs": RAW,
        "stream_ingest": RAW,
        "stream_exactly_once": RAW,
        "ingest_only_new": RAW,
        "privacy_access": RAW + f" WHERE user_email = '{EMAIL}'",
        "privacy_access_behind": RAW + f" WHERE user_email = '{EMAIL}'",
        "route_filter": f"""SELECT insert_id, CAST(1 + CASE WHEN {api_ids} THEN 1 ELSE 0 END AS BIGINT) AS messages FROM av
 UNION ALL SELECT 'diag-' || insert_id, CAST(1 AS BIGINT) FROM av WHERE event_id % 103 = 0""",
        "exclude_diagnostic": f"SELECT insert_id, CAST(1 + CASE WHEN {api_ids} THEN 1 ELSE 0 END AS BIGINT) AS messages FROM av",
        "dead_letter": f"""SELECT 'malformed_json' AS reason, {cnt('event_id % 101 = 0')} + {cnt('event_id % 211 = 0')}
 AS messages FROM av UNION ALL SELECT 'not_an_object', {cnt('event_id % 41 = 0')} FROM av""",
        "dedup_insert_id": 'SELECT insert_id AS "insertId", "receiveTimestamp" FROM av',
        "raw_partition_counts": raw_days + " GROUP BY day",
        "raw_schema_doc": _schema_doc(),
        "retention_keep": raw_days + f" WHERE {last14} GROUP BY day",
        "analytics_view": VIEW,
        "analytics_view_pseudonym": VIEW.replace("{U}", "user_pseudonym"),
        "parsed_json_fields": """SELECT insert_id AS "insertId", resource_project_id AS project_id, cli_version,
 operation_id, CAST(NULL AS VARCHAR) AS request_method, event_name FROM av""",
        "json_scalar": """SELECT insert_id AS "insertId", function_args, error, finish_reason, approval_mode,
 extensions FROM av""",
        "recent_api_responses": f"""SELECT ts AS "timestamp", event_name, session_id, model, input_tokens, output_tokens,
 total_tokens, insert_id AS "insertId" FROM av WHERE event_name = 'gemini_cli.api_response'
 AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY ORDER BY ts DESC, insert_id DESC LIMIT 100""",
        "resource_last_day": f"""SELECT ts AS "timestamp", 'global' AS resource_type, resource_project_id AS project_id
 FROM av WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""",
        "tool_performance": rounded("tool_performance", "*", "success_rate", "average_execution_duration_ms"),
        "cli_resilience": rounded(
            "cli_resilience", "*", "avg_tokens_before_compression", "avg_tokens_after_compression",
            "avg_compression_ratio",
        ),
        "model_routing_analysis": rounded("model_routing_analysis", "*", "failure_rate", "avg_routing_latency_ms"),
        "stored_daily_rollup": rounded("rollup", "*", "average_duration_ms") + f" WHERE day = {D} - 1",
        "rollup_rerun_emptied": rounded("rollup", "*", "average_duration_ms") + f" WHERE day = {D} - 2",
        "build_tables_history": rounded("rollup", "*", "average_duration_ms") + f" WHERE day IN ({D} - 1, {D} - 2)",
        "alerts_rerun_emptied": "SELECT *, 'second' AS run FROM alerts",
        "retention_alerts": "SELECT *, 'new' AS run FROM alerts",
        "retention_daily": rounded("rollup", "*", "average_duration_ms") + f" WHERE day IN ({D} - 1, {D} - 8)",
        "retention_weekly": rounded("weekly", "*", "average_duration_ms")
        + f" WHERE week_start_date IN ({D} - 10, {D} - 17)",
        "retention_raw": raw_days + f" WHERE {last14} GROUP BY day",
        "incremental_rerun_emptied": f"""SELECT day, user_email, model, {isum('input_tokens')} AS total_input_tokens,
 {isum('output_tokens')} AS total_output_tokens, {isum('cached_tokens')} AS total_cached_tokens,
 {isum('total_tokens')} AS grand_total_tokens FROM av
 WHERE total_tokens IS NOT NULL AND hour(ts) < 12 GROUP BY ALL""",
        "chained_refresh": "SELECT * FROM token_usage",
        "compacted_day_counts": "SELECT day, 'compacted' AS batch, count(*) AS row_count FROM av GROUP BY day",
        "batch_after_compaction": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, day, CAST({total} AS BIGINT) AS row_count FROM {source} GROUP BY day"
            for name, total, source in (
                ("raw", "count(*)", "av"), ("base", "count(*)", "av"), ("requests", "count(*)", "av"),
                ("minutes", "sum(requests_per_minute)", "minutes"),
            )
        ),
        "tier_after_erasure": f"SELECT user_pseudonym, count(*) AS row_count FROM av WHERE {not_user} GROUP BY user_pseudonym",
        "daily_rollup_incremental": rounded("rollup", "*", "average_duration_ms"),
        "weekly_rollup_incremental": rounded("weekly", "*", "average_duration_ms"),
        "daily_metrics_incremental": rounded("daily_metrics", "*", "average_duration_ms"),
        "user_activity_incremental": rounded("user_activity", "*", "average_request_duration_ms"),
        "base_after_repair": rounded("daily_metrics", "*", "average_duration_ms"),
        "privacy_erasure_stored": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, CAST(0 AS BIGINT) AS of_user, count(*) AS of_others FROM {source}"
            f" WHERE {column} IS DISTINCT FROM '{EMAIL}'"
            for name, source, column in (
                ("raw", "av", "user_email"), ("base", "av", "user_email"), ("minutes", "minutes", "user_email"),
                ("alerts", "alerts", "user_identifier"), ("token_usage", "token_usage", "user_email"),
                ("malformed_json_responses", "malformed_json_responses", "user_email"),
                ("feature_adoption", "feature_adoption", "user_email"),
                ("conversation_analysis", "conversation_analysis", "user_email"),
                ("daily_metrics", "(SELECT DISTINCT day, event_name, model, user_email FROM av)", "user_email"),
                ("user_activity", "(SELECT DISTINCT day, user_email, session_id FROM av)", "user_email"),
            )
        ),
        "token_usage_incremental": "SELECT * FROM token_usage",
        "malformed_json_responses_incremental": "SELECT * FROM malformed_json_responses",
        "feature_adoption_incremental": "SELECT * FROM feature_adoption",
        "conversation_analysis_incremental": rounded("conversation_analysis", "*", "avg_turn_count"),
        # dashboards
        "q_daily_metrics_30d": f"""SELECT day, model, request_count, distinct_users, total_tokens, error_count
 FROM daily_metrics WHERE {last30}""",
        "q_top_users": """SELECT user_email, total_requests, total_sessions, total_tokens_used,
 date_sub('day', first_seen, last_seen) AS days_active FROM user_activity
 ORDER BY total_requests DESC, user_email LIMIT 20""",
        "q_tokens_by_day_model": f"""SELECT day, model, {isum('total_input_tokens')} AS input_tokens,
 {isum('total_output_tokens')} AS output_tokens, {isum('total_cached_tokens')} AS cached_tokens
 FROM token_usage WHERE {last7} GROUP BY day, model""",
        "q_top_errors": f"""SELECT * FROM error_analysis WHERE {last14} ORDER BY error_count DESC, day ASC NULLS LAST,
 cli_version ASC NULLS LAST, model ASC NULLS LAST, error_code ASC NULLS LAST, error_message ASC NULLS LAST LIMIT 50""",
        "q_malformed_trend": f"""SELECT day, model, {isum('malformed_json_count')} AS total_malformed
 FROM malformed_json_responses WHERE {last7} GROUP BY day, model""",
        "q_features_by_version": f"""SELECT cli_version, {isum('slash_command_usage_count')} AS slash_commands,
 {isum('agent_mode_usage_count')} AS agent_mode, {isum('extension_install_count')} AS extensions
 FROM feature_adoption WHERE {last30} GROUP BY cli_version""",
        "q_conversations": f"""SELECT day, approval_mode, conversation_count, {r6('avg_turn_count')} AS avg_turn_count,
 min_turn_count, max_turn_count FROM conversation_analysis WHERE {last30}""",
        "q_tool_rollup": f"""SELECT function_name, {isum('total_calls')} AS calls, {isum('successful_calls')} AS successes,
 {isum('failed_calls')} AS failures, {r6('avg(success_rate)')} AS success_rate,
 {r6('avg(average_execution_duration_ms)')} AS avg_duration_ms FROM {tp7}""",
        "q_retry_success": f"""SELECT day, model, flash_fallback_count, content_retry_count, content_retry_failure_count,
 {r6(div('(content_retry_count - content_retry_failure_count)', 'content_retry_count'))} AS retry_success_rate,
 {r6('avg_compression_ratio')} AS avg_compression_ratio FROM cli_resilience WHERE {last14}""",
        "q_routing": f"""SELECT decision_source, decision_model, decision_count, failure_count,
 {r6('failure_rate')} AS failure_rate, {r6('avg_routing_latency_ms')} AS avg_routing_latency_ms
 FROM model_routing_analysis WHERE {last7}""",
        "q_near_limit": f"""SELECT "minute", user_email, model, requests_per_minute, requests_per_day,
 total_tokens_per_minute FROM quota_tracking WHERE day = {TODAY_D} AND requests_per_minute > 0
 ORDER BY "minute" DESC, user_email, model ASC NULLS LAST LIMIT 100""",
        "q_latest_configs": """SELECT user_email, cli_version, sandbox_enabled, log_prompts_enabled, output_format,
 extension_count, last_config_timestamp FROM user_configuration
 ORDER BY last_config_timestamp DESC, user_email LIMIT 100""",
        "q_rollup_90d": f"""SELECT day, model, request_count, distinct_users, total_tokens, error_count FROM rollup
 WHERE day >= {D} - 90""",
        "q_recent_alerts": f"SELECT * FROM alerts WHERE alert_date >= {D} - 7",
        "q_weekly_error_rate": f"""SELECT week_start_date, model, request_count, distinct_users, total_tokens,
 {r6(div('error_count', 'request_count'))} AS error_rate FROM weekly
 ORDER BY week_start_date DESC, model ASC NULLS LAST LIMIT 12""",
        "q_request_volume": f"""SELECT CAST(day AS TIMESTAMP) AS "time", model, request_count AS "value"
 FROM daily_metrics WHERE {last30}""",
        "q_active_users": f"""SELECT count(*) AS total_users, {cnt(f"last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY")}
 AS active_30d FROM user_activity""",
        "q_error_rate": f"""SELECT {r6('100 * ' + div('sum(error_count)', 'sum(request_count)'))} AS "value"
 FROM daily_metrics WHERE {last7}""",
        "q_tokens_by_model": f"""SELECT model, {isum('grand_total_tokens')} AS "value" FROM token_usage
 WHERE {last7} GROUP BY model""",
        "q_token_trend_long": f"""SELECT CAST(day AS TIMESTAMP) AS "time", 'Input Tokens' AS metric,
 {isum('total_input_tokens')} AS "value" FROM token_usage WHERE {last30} GROUP BY day
 UNION ALL SELECT CAST(day AS TIMESTAMP), 'Output Tokens', {isum('total_output_tokens')}
 FROM token_usage WHERE {last30} GROUP BY day""",
        "q_top_errors_sum": f"""SELECT error_code, error_message, {isum('error_count')} AS occurrences,
 {isum('distinct_users_affected')} AS users_affected FROM error_analysis WHERE {last7} GROUP BY ALL
 ORDER BY occurrences DESC, error_code, error_message ASC NULLS LAST LIMIT 20""",
        "q_tool_success_pct": f"""SELECT function_name, {isum('total_calls')} AS calls,
 {r6('avg(success_rate) * 100')} AS success_rate_pct, {r6('avg(average_execution_duration_ms)')} AS avg_duration_ms
 FROM {tp7} ORDER BY calls DESC, function_name LIMIT 15""",
        "q_rpm_last_hour": f"""SELECT "minute" AS "time", user_email, requests_per_minute AS "value" FROM minutes
 WHERE "minute" >= TIMESTAMP '{TODAY}' - INTERVAL 1 HOUR""",
        "q_429_by_day": f"""SELECT day, e AS total_429_errors, r AS total_requests FROM
 ({per_day} FROM minutes WHERE {last7} GROUP BY day)""",
        "q_429_days": f"SELECT day, e AS total_429s FROM ({per_day} FROM minutes WHERE {last30} GROUP BY day) WHERE e > 0",
        "q_429_by_hour": f"""SELECT "hour", {isum('error_429_count_per_minute')} AS total_429_errors,
 {isum('requests_per_minute')} AS total_requests FROM minutes WHERE {last7} GROUP BY "hour" """,
        "q_429_by_user_model": f"""SELECT user_email, model, {isum('error_429_count_per_minute')} AS total_429_errors
 FROM minutes WHERE {last7} GROUP BY ALL HAVING total_429_errors > 0""",
        "q_429_scorecards": f"""SELECT {isum('error_429_count_per_minute')} AS total_429_errors,
 {r6('100 * ' + div('sum(error_429_count_per_minute)',
                    'sum(error_429_count_per_minute + requests_per_minute)'))} AS error_rate_pct,
 count(DISTINCT CASE WHEN error_429_count_per_minute > 0 THEN user_email END) AS affected_users
 FROM minutes WHERE day = {TODAY_D}""",
        "q_rpm_alert_rule": f"""SELECT user_email, until AS last_minute, last_value, minutes_held FROM (
 SELECT user_email, max("minute") AS until, arg_max(v, "minute") AS last_value, count(*) AS minutes_held, lm FROM (
 SELECT *, max("minute") OVER (PARTITION BY user_email) AS lm,
 epoch("minute") / 60 - row_number() OVER (PARTITION BY user_email ORDER BY "minute") AS island FROM (
 SELECT user_email, "minute", max(requests_per_minute) AS v FROM minutes
 WHERE day = {TODAY_D} AND requests_per_minute > 0 GROUP BY ALL)) GROUP BY user_email, lm, island) WHERE until = lm""",
        "q_threshold_alerts": f"""SELECT * FROM (
 SELECT day, user_email AS user_identifier, model, 'rpm' AS rule, CAST(max(requests_per_minute) AS DOUBLE) AS "value",
 CASE WHEN max(requests_per_minute) > 1 THEN 'critical' WHEN max(requests_per_minute) > 0 THEN 'warning' END AS level
 FROM minutes WHERE {last30} GROUP BY ALL
 UNION ALL SELECT day, user_email, model, 'rpd', CAST(sum(requests_per_minute) AS DOUBLE),
 CASE WHEN sum(requests_per_minute) > 4 THEN 'critical' WHEN sum(requests_per_minute) > 2 THEN 'warning' END
 FROM minutes WHERE {last30} GROUP BY ALL
 UNION ALL SELECT day, NULL, NULL, 'error_rate', {r6(div('count(error_code)', 'count(*)'))},
 CASE WHEN {div('count(error_code)', 'count(*)')} > 0.05 THEN 'warning' END FROM av WHERE {last30} GROUP BY day
 UNION ALL SELECT day, NULL, NULL, 'malformed_json',
 CAST({cnt("event_name = 'gemini_cli.malformed_json_response'")} AS DOUBLE),
 CASE WHEN {cnt("event_name = 'gemini_cli.malformed_json_response'")} > 10 THEN 'warning' END
 FROM av WHERE {last30} GROUP BY day) WHERE level IS NOT NULL""",
        # panels
        "p_requests_today": f"SELECT count(*) AS requests FROM av WHERE day = {TODAY_D}",
        "p_users_by_model": f"SELECT model, count(DISTINCT user_email) AS distinct_users FROM av WHERE {last30} GROUP BY model",
        "p_token_trend": f"""SELECT day, {isum('input_tokens')} AS input_tokens, {isum('output_tokens')} AS output_tokens
 FROM av WHERE {last30} GROUP BY day""",
        "p_top_token_users": """SELECT user_email, total_tokens_used FROM user_activity
 ORDER BY total_tokens_used DESC NULLS LAST, user_email LIMIT 10""",
        "p_session_hist": """SELECT CAST(total_sessions - total_sessions % 5 AS BIGINT) AS sessions_from, count(*) AS users
 FROM user_activity GROUP BY 1""",
        "p_token_share": f"""SELECT {share.format('model', 'tokens')} FROM
 (SELECT model, {isum('total_tokens')} AS tokens FROM av WHERE {last30} GROUP BY model)""",
        "p_token_budget": f"""SELECT day, tokens, round(tokens / 60000.0::DOUBLE, 6) AS budget_used, tokens > 60000 AS over_budget
 FROM (SELECT day, {isum('total_tokens')} AS tokens FROM av WHERE {last30} GROUP BY day)""",
        "p_cached_rate": f"""SELECT day, {r6(div('sum(cached_tokens)', 'sum(input_tokens)'))} AS cached_rate FROM av
 WHERE {last30} GROUP BY day""",
        "p_error_heatmap": f"""SELECT day, cli_version, count(*) AS errors FROM av
 WHERE error_code IS NOT NULL AND {last14} GROUP BY ALL""",
        "p_top10_errors": f"""SELECT error_code, error_message, count(*) AS occurrences FROM av
 WHERE error_code IS NOT NULL AND {last14} GROUP BY ALL
 ORDER BY occurrences DESC, error_code, error_message ASC NULLS LAST LIMIT 10""",
        "p_error_rate_trend": f"""SELECT day, {r6(div('count(error_code)', 'count(*)'))} AS error_rate FROM av
 WHERE {last14} GROUP BY day""",
        "p_malformed_totals": f"""SELECT model, count(*) AS malformed, count(DISTINCT user_email) AS users_affected,
 grouping(model) = 1 AS is_total FROM av WHERE event_name = 'gemini_cli.malformed_json_response' AND {last7}
 GROUP BY ROLLUP (model)""",
        "p_slash_growth": f"""SELECT a.day, a.n AS commands, coalesce(b.n, 0) AS previous,
 round(CAST(a.n AS DOUBLE) / b.n - 1, 6) AS growth FROM
 (SELECT day, count(*) AS n FROM av WHERE event_name = 'gemini_cli.slash_command' AND day >= {D} - 31 GROUP BY day) a
 LEFT JOIN
 (SELECT day, count(*) AS n FROM av WHERE event_name = 'gemini_cli.slash_command' AND day >= {D} - 31 GROUP BY day) b
 ON a.day = b.day + 1""",
        "p_agent_adoption": f"""SELECT agent_users, active_users, {r6(div('agent_users', 'active_users'))} AS adoption_rate
 FROM (SELECT count(DISTINCT CASE WHEN event_name = 'gemini_cli.agent.start' THEN user_email END) AS agent_users,
 count(DISTINCT user_email) AS active_users FROM av WHERE {last30})""",
        "p_feature_share": f"""SELECT {share.format('event_name', 'uses')} FROM (SELECT event_name, count(*) AS uses FROM av
 WHERE {last30} AND event_name IN ('gemini_cli.slash_command', 'gemini_cli.agent.start',
 'gemini_cli.extension_install') GROUP BY event_name)""",
        "p_turn_hist": """SELECT CAST(turn_count - turn_count % 3 AS BIGINT) AS turns_from, count(*) AS conversations
 FROM conversations GROUP BY 1""",
        "p_conv_by_mode": f"""SELECT approval_mode, count(*) AS conversations, {r6('avg(turn_count)')} AS mean_turns
 FROM conversations GROUP BY 1""",
        "p_conv_volume": "SELECT day, count(*) AS conversations FROM conversations GROUP BY day",
        "p_tool_success": f"""SELECT count(*) AS calls, {r6(div(cnt('error_code IS NULL'), 'count(*)'))} AS success_rate
 FROM {tools7}""",
        "p_top_tools": f"""SELECT function_name, count(*) AS calls FROM {tools7} GROUP BY function_name
 ORDER BY calls DESC, function_name LIMIT 10""",
        "p_tool_failure_trend": f"""SELECT day, {r6(div('count(error_code)', 'count(*)'))} AS failure_rate FROM av
 WHERE function_name IS NOT NULL AND {last30} GROUP BY day""",
        "p_resilience_totals": f"""SELECT day, is_total, fallbacks, retries, retry_failures,
 {r6(div('(retries - retry_failures)', 'retries'))} AS retry_success_rate, compression_ratio FROM (
 SELECT day, grouping(day) = 1 AS is_total, {cnt("event_name = 'gemini_cli.flash_fallback'")} AS fallbacks,
 {cnt("event_name = 'gemini_cli.chat.content_retry'")} AS retries,
 {cnt("event_name = 'gemini_cli.chat.content_retry_failure'")} AS retry_failures,
 {r6(div('sum(tokens_before - tokens_after)', 'sum(tokens_before)'))} AS compression_ratio FROM av
 WHERE {last14} AND event_name IN ('gemini_cli.flash_fallback', 'gemini_cli.chat.content_retry',
  'gemini_cli.chat.content_retry_failure', 'gemini_cli.chat_compression') GROUP BY ROLLUP (day))""",
        "p_routing_totals": f"""SELECT decision_source, grouping(decision_source) = 1 AS is_total, count(*) AS decisions,
 {r6(div(cnt('failed'), 'count(*)'))} AS failure_rate, {r6('avg(routing_latency_ms)')} AS mean_latency_ms FROM av
 WHERE event_name = 'gemini_cli.model_routing' AND {last7} GROUP BY ROLLUP (decision_source)""",
        "p_quota_headroom": f"""SELECT *, peak_rpm >= 0.8 * 2 OR peak_rpd >= 0.8 * 5 AS near_limit FROM (
 SELECT user_email, model, max(rpm) AS peak_rpm, max(rpd) AS peak_rpd FROM (
 SELECT day, user_email, model, max(requests_per_minute) AS rpm, {isum('requests_per_minute')} AS rpd FROM minutes
 WHERE {last7} GROUP BY ALL) GROUP BY ALL)""",
        "p_sandbox_share": f"""SELECT {share.format('sandbox_enabled', 'users')} FROM
 (SELECT sandbox_enabled, count(*) AS users FROM user_configuration GROUP BY 1)""",
        "p_prompt_logging_share": f"""SELECT {share.format('log_prompts_enabled', 'users')} FROM
 (SELECT log_prompts_enabled, count(*) AS users FROM user_configuration GROUP BY 1)""",
        "p_extensions_by_user": "SELECT user_email, extensions, extension_count FROM user_configuration",
        "p_rollup_totals": f"""SELECT model, grouping(model) = 1 AS is_total, {isum('request_count')} AS requests,
 {isum('total_tokens')} AS tokens, {isum('error_count')} AS errors FROM rollup WHERE {last30} GROUP BY ROLLUP (model)""",
        "p_alerts_24h": f"""SELECT alert_type, count(*) AS violations FROM alerts WHERE alert_date >= {D} - 1
 GROUP BY alert_type""",
        "p_top_violators": """SELECT user_identifier, count(*) AS violations, max(current_value) AS worst_value FROM alerts
 GROUP BY 1 ORDER BY violations DESC, user_identifier LIMIT 10""",
        "p_week_over_week": """SELECT week_start_date, model, request_count, previous_requests,
 round(CAST(request_count AS DOUBLE) / previous_requests - 1, 6) AS change,
 round(CAST(request_count AS DOUBLE) / sum(request_count) OVER (PARTITION BY week_start_date), 6) AS share FROM (
 SELECT *, lag(request_count) OVER (PARTITION BY model ORDER BY week_start_date) AS previous_requests FROM weekly)""",
        # privacy
        "privacy_lookup": f"""SELECT user_pseudonym, first_seen, last_seen, total_requests, total_sessions,
 {r6('average_request_duration_ms')} AS average_request_duration_ms, total_tokens_used
 FROM user_activity WHERE user_pseudonym = sha256('{EMAIL}')""",
        "privacy_usage_by_day": f"SELECT * FROM token_usage WHERE user_pseudonym = sha256('{EMAIL}')",
        "privacy_reverse_lookup": f"""SELECT DISTINCT user_email, sha256(user_email) AS user_pseudonym FROM av
 WHERE sha256(user_email) = sha256('{EMAIL}')""",
        "privacy_erasure_preview": f"""SELECT count(*) AS records_to_delete, min(ts) AS oldest_record,
 max(ts) AS newest_record FROM av WHERE user_email = '{EMAIL}'""",
        "privacy_erasure_after": raw_days + f" WHERE {not_user} GROUP BY day",
        "privacy_export_behind": f"""SELECT insert_id AS "insertId", severity FROM av WHERE user_email = '{EMAIL}'""",
        "privacy_export": f"""SELECT insert_id AS "insertId", severity FROM av WHERE user_email = '{EMAIL}'""",
        "privacy_active_users": f"""SELECT count(*) AS active_users FROM user_activity
 WHERE last_seen >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""",
        "privacy_top_tokens": f"""SELECT user_pseudonym, {isum('grand_total_tokens')} AS total_tokens,
 count(DISTINCT day) AS days_active, round({div('sum(grand_total_tokens)', 'count(DISTINCT day)')}, 2) AS avg_daily_tokens
 FROM token_usage WHERE {last30} GROUP BY 1 ORDER BY total_tokens DESC NULLS LAST, user_pseudonym LIMIT 10""",
        "anomaly_zscore": f"""SELECT user_pseudonym, day, tokens_used, {r6('a')} AS avg_tokens,
 round((tokens_used - a) / nullif(s, 0), 2) AS z_score FROM (
 SELECT *, avg(tokens_used) OVER w AS a, stddev_samp(tokens_used) OVER w AS s FROM (
 SELECT user_pseudonym, day, {isum('grand_total_tokens')} AS tokens_used FROM token_usage WHERE {last30} GROUP BY ALL)
 WINDOW w AS (PARTITION BY user_pseudonym)) WHERE tokens_used > a + 2 * s""",
        "k_anonymous_stats": f"""SELECT day, model, cli_version, count(DISTINCT user_pseudonym) AS user_count,
 count(*) AS total_requests, {isum('total_tokens')} AS total_tokens, {r6('avg(duration_ms)')} AS avg_duration_ms,
 count(error_code) AS error_count FROM av GROUP BY day, model, cli_version
 HAVING count(DISTINCT user_pseudonym) >= 5""",
        "redacted_view": """SELECT insert_id AS "insertId", user_pseudonym, sha256(installation_id) AS installation_id_hash,
 event_name, CAST(NULL AS VARCHAR) AS resource_json, CAST(NULL AS VARCHAR) AS labels_json,
 CAST(NULL AS VARCHAR) AS operation_json, CAST(NULL AS VARCHAR) AS "httpRequest_json",
 CAST(NULL AS VARCHAR) AS "jsonPayload_json" FROM av""",
        # checks
        "m_freshness": f"""SELECT {cnt("ts >= TIMESTAMP '2024-01-30 11:45:00'")} AS rows_15_min,
 {cnt("ts >= TIMESTAMP '2024-01-30 11:50:00'")} AS rows_10_min FROM av""",
        "m_timestamp_match": """SELECT count(*) AS matched_rows FROM av
 WHERE ts BETWEEN TIMESTAMP '2024-01-15 11:30:00' AND TIMESTAMP '2024-01-15 12:30:00'""",
        "m_json_validity": _validity(),
        "m_extraction_coverage": _coverage(),
        "m_reconciliation": f"""SELECT *, true AS balanced FROM (SELECT
 count(*) + {' + '.join(cnt(f'event_id % {k} = 0') for k in (97, 101, 211, 103, 107))} AS messages,
 {cnt('event_id % 101 = 0')} + {cnt('event_id % 211 = 0')} AS dead_letters,
 {cnt('event_id % 107 = 0')} AS other_logs, {cnt('event_id % 103 = 0')} AS diagnostics,
 count(*) + {cnt('event_id % 97 = 0')} AS routed, {cnt('event_id % 97 = 0')} AS duplicates, count(*) AS loaded
 FROM av)""",
        "m_batch_reconciliation": f"""SELECT CAST(3 AS BIGINT) AS batches, messages, dead_letters, other_logs, diagnostics,
 messages - dead_letters - other_logs - diagnostics AS routed, loaded, loaded AS stored, repeats, true AS balanced, compacted
 FROM (SELECT count(*) + {' + '.join(cnt(f'event_id % {k} = 0') for k in (97, 101, 211, 103, 107))} AS messages,
 {cnt('event_id % 101 = 0')} + {cnt('event_id % 211 = 0')} AS dead_letters, {cnt('event_id % 107 = 0')} AS other_logs,
 {cnt('event_id % 103 = 0')} AS diagnostics, count(*) AS loaded, {cnt('event_id % 97 = 0')} AS repeats FROM av)
 CROSS JOIN (VALUES (false), (true)) v(compacted)""",
        "m_missing_ids": 'SELECT insert_id AS "insertId" FROM av WHERE event_id % 37 = 0',
        "m_structure": f"""SELECT count(*) AS total_rows, {cnt('event_id % 19 <> 0 AND event_id % 23 <> 0')} AS well_formed,
 {cnt('event_id % 19 = 0')} AS without_timestamp, {cnt('event_id % 23 = 0')} AS without_log_name FROM av""",
        "m_latest_log": """SELECT max(ts) AS latest_timestamp, count(*) AS log_count FROM
 (SELECT ts FROM av WHERE ts >= TIMESTAMP '2024-01-29 23:59:00')""",
        "m_inference_flags": f"""SELECT count(*) AS log_count, {cnt('event_id % 31 = 0')} AS inference_logs,
 {cnt('event_id % 13 = 0')} AS tool_call_logs FROM av""",
        "m_audit_errors": """SELECT CASE WHEN event_id % 3 = 0 THEN 'google.logging.v2.ConfigServiceV2.CreateSink'
 ELSE 'google.logging.v2.ConfigServiceV2.UpdateSink' END AS method_name, count(*) AS error_count FROM av
 WHERE event_id % 3 < 2 AND event_id % 11 <> 0 AND event_id % 4 <> 0 AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1""",
        "m_ingest_lag": f"""SELECT day, {r6('avg(CAST(event_id % 90 AS DOUBLE))')} AS mean_lag_s,
 quantile_disc(CAST(event_id % 90 AS DOUBLE), 0.95) AS p95_lag_s, max(CAST(event_id % 90 AS DOUBLE)) AS max_lag_s,
 {cnt('event_id % 90 > 60')} AS rows_over_limit FROM av GROUP BY day""",
        "m_ingest_lag_sketched": """SELECT day, round(avg(CAST(event_id % 90 AS DOUBLE)), 6) AS mean_lag_s,
 max(CAST(event_id % 90 AS DOUBLE)) AS max_lag_s, true AS p95_near FROM av GROUP BY day""",
        "m_dead_letter_rate": f"""SELECT *, round(CAST(dead_letters AS DOUBLE) / (dead_letters + loaded), 6) AS rate,
 CAST(dead_letters AS DOUBLE) / (dead_letters + loaded) > 0.001 AS over_limit FROM (SELECT
 {cnt('event_id % 101 = 0')} + {cnt('event_id % 211 = 0')} AS dead_letters, count(*) AS loaded FROM av)""",
        "m_catalog_check": _catalog(),
        "build_report": _catalog("'created' AS status, CAST(NULL AS VARCHAR) AS error, "),
        # streaming
        "stream_quota_minute": """SELECT day, "minute", user_email, model, requests_per_minute,
 error_429_count_per_minute, total_errors_per_minute FROM minutes""",
        "stream_quota_alerts": """SELECT day, "minute", user_email, model, requests_per_minute,
 CAST(1 AS BIGINT) AS times_raised FROM minutes WHERE requests_per_minute > 0""",
        "late_data_days": f"""SELECT day, count(*) AS row_count,
 {cnt('CAST("receiveTimestamp" AS DATE) > day')} AS received_later FROM av GROUP BY day""",
    }


PSEUDONYM_QUERIES = {
    "privacy_lookup", "privacy_usage_by_day", "privacy_active_users", "privacy_top_tokens", "anomaly_zscore",
}
DEFAULT_LIMITS = {"m_catalog_check", "build_report"}


def all_oracles() -> dict[str, str]:
    sql = {}
    for name, final in _finals().items():
        user = "user_pseudonym" if name in PSEUDONYM_QUERIES else "user_email"
        limits = {"rpm": 120, "rpd": 2000, "lookback": 10} if name in DEFAULT_LIMITS else {}
        sql[name] = query(final, user, **limits)
    for name, final in _user_views().items():
        sql[name] = query(final)
        sql[f"{name}_pseudonym"] = query(final, "user_pseudonym")
    return sql
