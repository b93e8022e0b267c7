"""The schema-on-read base view: typed columns over raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybeam.config import USER_EMAIL, USER_PSEUDONYM
from tallybeam.functions.identity import pseudonym
from tallybeam.functions.jsonx import (
    STRICT_OPTIONS,
    as_bigint,
    as_boolean,
    as_double,
    json_scalar,
    key_scalar,
    text_struct,
)
from tallybeam.functions.timex import AsOf, moment_before, time_range, ts_lit

# View column, payload key and type, in view order.
PAYLOAD_COLUMNS = (
    ("event_name", "event.name", "string"),
    ("event_domain", "event.domain", "string"),
    ("event_timestamp", "event.timestamp", "string"),
    ("session_id", "session.id", "string"),
    ("installation_id", "installation.id", "string"),
    ("model", "model", "string"),
    ("model_name", "model_name", "string"),
    ("auth_type", "auth_type", "string"),
    ("prompt_id", "prompt_id", "string"),
    ("gen_ai_request_model", "gen_ai.request.model", "string"),
    ("temperature", "gen_ai.request.temperature", "double"),
    ("top_p", "gen_ai.request.top_p", "double"),
    ("top_k", "gen_ai.request.top_k", "bigint"),
    ("max_output_tokens", "gen_ai.request.max_tokens", "bigint"),
    ("finish_reason", "gen_ai.response.finish_reasons", "string"),
    ("input_tokens", "input_token_count", "bigint"),
    ("output_tokens", "output_token_count", "bigint"),
    ("cached_tokens", "cached_content_token_count", "bigint"),
    ("thoughts_tokens", "thoughts_token_count", "bigint"),
    ("tool_tokens", "tool_token_count", "bigint"),
    ("total_tokens", "total_token_count", "bigint"),
    ("gen_ai_input_tokens", "gen_ai.usage.input_tokens", "bigint"),
    ("gen_ai_output_tokens", "gen_ai.usage.output_tokens", "bigint"),
    ("function_name", "function_name", "string"),
    ("function_args", "function_args", "string"),
    ("function_duration_ms", "duration_ms", "double"),
    ("function_success", "success", "boolean"),
    ("tool_type", "tool_type", "string"),
    ("mcp_server_name", "mcp_server_name", "string"),
    ("duration_ms", "duration_ms", "double"),
    ("status_code", "status_code", "bigint"),
    ("error", "error", "string"),
    ("error_message", "error.message", "string"),
    ("error_code", "error.type", "string"),
)
EMAIL_KEY = "user.email"

PASSTHROUGH = ("timestamp", "receiveTimestamp", "logName", "insertId", "severity", "trace", "spanId")
PARSED = {
    "resource": "resource_json",
    "labels": "labels_json",
    "operation": "operation_json",
    "httpRequest": "httpRequest_json",
    "payload": "jsonPayload_json",
}
BLOBS = tuple(PARSED.values())
PARTITIONS = ("day", "batch")

# Options of the general-access copy: no emails, no installations, no payload text.
GENERAL_ACCESS = {"pseudonymize": True, "hash_installation": True, "redact_payload": True}


def _typed(parsed: Column, blob: Column, key: str, kind: str) -> Column:
    if kind == "string":
        return key_scalar(parsed, blob, key)
    text = parsed.getField(key)
    return {"bigint": as_bigint, "double": as_double, "boolean": as_boolean}[kind](text)


def analytics_view(
    raw: DataFrame,
    pseudonymize: bool = False,
    hash_installation: bool = False,
    redact_payload: bool = False,
) -> DataFrame:
    """The 54 base columns, in order, followed by the raw table's partition columns.

    One parse of the payload serves every extracted column, and columns that a query does not
    select are never computed. ``hash_installation`` and ``redact_payload`` tighten the pseudonym
    mode, which by itself leaves the payload text readable.
    """
    keys = list(dict.fromkeys([key for _, key, _ in PAYLOAD_COLUMNS] + [EMAIL_KEY]))
    blob, parsed = F.col("jsonPayload_json"), F.col("_payload")
    typed = [_typed(parsed, blob, key, kind).alias(name) for name, key, kind in PAYLOAD_COLUMNS]
    email = key_scalar(parsed, blob, EMAIL_KEY)
    user = pseudonym(email).alias(USER_PSEUDONYM) if pseudonymize else email.alias(USER_EMAIL)

    view = raw.withColumn("_payload", F.from_json(blob, text_struct(keys), STRICT_OPTIONS)).select(
        *PASSTHROUGH,
        *[F.try_parse_json(source).alias(name) for name, source in PARSED.items()],
        *typed,
        json_scalar(F.col("resource_json"), "$.labels.project_id").alias("resource_project_id"),
        user,
        json_scalar(F.col("labels_json"), "$.cli_version").alias("cli_version"),
        *BLOBS,
        *[c for c in PARTITIONS if c in raw.columns],
    )
    if hash_installation:
        view = hashed_installation(view)
    if redact_payload:
        view = redacted(view)
    return view


def hashed_installation(view: DataFrame) -> DataFrame:
    hashed = F.when(F.col("installation_id").isNotNull(), F.sha2("installation_id", 256))
    return view.withColumn("installation_id", hashed).withColumnRenamed("installation_id", "installation_id_hash")


def redacted(view: DataFrame) -> DataFrame:
    """Blank the columns through which a clear email could still be read."""
    nothing = {name: F.lit(None).cast("variant") for name in PARSED if name in view.columns}
    nothing |= {name: F.lit(None).cast("string") for name in BLOBS}
    return view.withColumns(nothing)


def with_pseudonyms(view: DataFrame) -> DataFrame:
    """Pseudonym mode over a base view that holds emails."""
    return view.withColumn(USER_EMAIL, pseudonym(F.col(USER_EMAIL))).withColumnRenamed(USER_EMAIL, USER_PSEUDONYM)


def stored_columns(view: DataFrame) -> DataFrame:
    """The base view without the parsed JSON columns, which are derived again on reading."""
    return view.drop(*PARSED)


def parsed_json(stored: DataFrame) -> DataFrame:
    return stored.withColumns({name: F.try_parse_json(source) for name, source in PARSED.items()})


def recent_events(
    view: DataFrame, event_name: str, as_of: AsOf, days: int = 1, limit: int = 100
) -> DataFrame:
    """Newest rows of one event in the last ``days`` days."""
    return (
        time_range(view, moment_before(as_of, days=days))
        .filter((F.col("event_name") == event_name) & (F.col("timestamp") > ts_lit(as_of, days=days)))
        .select(
            "timestamp", "event_name", "session_id", "model",
            "input_tokens", "output_tokens", "total_tokens", "insertId",
        )
        .orderBy(F.col("timestamp").desc(), F.col("insertId").desc())
        .limit(limit)
    )


def recent_resources(raw: DataFrame, as_of: AsOf, days: int = 1) -> DataFrame:
    """Resource type and project of the raw rows of the last ``days`` days."""
    return (
        time_range(raw, moment_before(as_of, days=days))
        .filter(F.col("timestamp") > ts_lit(as_of, days=days))
        .select(
            "timestamp",
            json_scalar(F.col("resource_json"), "$.type").alias("resource_type"),
            json_scalar(F.col("resource_json"), "$.labels.project_id").alias("project_id"),
        )
    )
