"""The thirteen derived views over the base view.

Every function takes the base view and the name of its user column and returns a lazy frame, so
a filter on ``day`` above any of them reaches the partition filter of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.functions.jsonx import as_bigint, as_boolean, with_payload_keys
from tallybeam.functions.measures import ratio, usage_measures
from tallybeam.functions.timex import event_day


def _is(event: str) -> Column:
    return F.col("event_name") == event


def _events(av: DataFrame, *names: str) -> DataFrame:
    return av.filter(F.col("event_name").isin(*names))


def daily_metrics(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return av.groupBy(event_day(av).alias("day"), "event_name", "model").agg(*usage_measures(user_col))


def user_activity(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        av.filter(F.col(user_col).isNotNull())
        .groupBy(user_col)
        .agg(
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
            F.count("*").alias("total_requests"),
            F.count_distinct("session_id").alias("total_sessions"),
            F.avg("duration_ms").alias("average_request_duration_ms"),
            F.sum("total_tokens").alias("total_tokens_used"),
        )
    )


def token_usage(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        av.filter(F.col("total_tokens").isNotNull())
        .groupBy(event_day(av).alias("day"), user_col, "model")
        .agg(
            F.sum("input_tokens").alias("total_input_tokens"),
            F.sum("output_tokens").alias("total_output_tokens"),
            F.sum("cached_tokens").alias("total_cached_tokens"),
            F.sum("total_tokens").alias("grand_total_tokens"),
        )
    )


def error_analysis(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        av.filter(F.col("error_code").isNotNull())
        .groupBy(event_day(av).alias("day"), "cli_version", "model", "error_code", "error_message")
        .agg(
            F.count("*").alias("error_count"),
            F.count_distinct(user_col).alias("distinct_users_affected"),
        )
    )


def malformed_json_responses(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        _events(av, config.MALFORMED_JSON)
        .groupBy(event_day(av).alias("day"), "model", user_col)
        .agg(F.count("*").alias("malformed_json_count"))
    )


def feature_adoption(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        _events(av, config.SLASH_COMMAND, config.AGENT_START, config.EXTENSION_INSTALL)
        .groupBy(event_day(av).alias("day"), user_col, "cli_version")
        .agg(
            F.count_if(_is(config.SLASH_COMMAND)).alias("slash_command_usage_count"),
            F.count_if(_is(config.AGENT_START)).alias("agent_mode_usage_count"),
            F.count_if(_is(config.EXTENSION_INSTALL)).alias("extension_install_count"),
        )
    )


def conversations(av: DataFrame) -> DataFrame:
    """Finished conversations with their approval mode and turn count."""
    finished = with_payload_keys(
        _events(av, config.CONVERSATION_FINISHED), {"approval_mode": "approvalMode", "turn_count": "turnCount"}
    )
    return finished.withColumn("turn_count", as_bigint(F.col("turn_count")))


def conversation_analysis(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        conversations(av)
        .groupBy(event_day(av).alias("day"), user_col, "cli_version", "approval_mode")
        .agg(
            F.count("*").alias("conversation_count"),
            F.avg("turn_count").alias("avg_turn_count"),
            F.min("turn_count").alias("min_turn_count"),
            F.max("turn_count").alias("max_turn_count"),
        )
    )


def tool_performance(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """Has no user column; takes the argument so that all views are called alike."""
    ok = F.count_if(F.col("error_code").isNull())
    return (
        av.filter(F.col("function_name").isNotNull())
        .groupBy(event_day(av).alias("day"), "model", "function_name")
        .agg(
            F.count("*").alias("total_calls"),
            ok.alias("successful_calls"),
            F.count("error_code").alias("failed_calls"),
            ratio(ok, F.count("*")).alias("success_rate"),
            F.avg("duration_ms").alias("average_execution_duration_ms"),
        )
    )


def resilience_events(av: DataFrame) -> DataFrame:
    """Fallbacks, retries and compressions: one 0/1 column per kind, token counts of compressions."""
    events = with_payload_keys(
        _events(
            av, config.FLASH_FALLBACK, config.CONTENT_RETRY, config.CONTENT_RETRY_FAILURE, config.CHAT_COMPRESSION
        ),
        {"tokens_before": "tokens_before", "tokens_after": "tokens_after"},
    )
    compressed = _is(config.CHAT_COMPRESSION)
    return events.select(
        event_day(av).alias("day"),
        "model",
        _is(config.FLASH_FALLBACK).cast("bigint").alias("flash_fallback"),
        _is(config.CONTENT_RETRY).cast("bigint").alias("content_retry"),
        _is(config.CONTENT_RETRY_FAILURE).cast("bigint").alias("content_retry_failure"),
        F.when(compressed, as_bigint(F.col("tokens_before"))).alias("before"),
        F.when(compressed, as_bigint(F.col("tokens_after"))).alias("after"),
    )


def cli_resilience(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        resilience_events(av)
        .groupBy("day", "model")
        .agg(
            F.sum("flash_fallback").alias("flash_fallback_count"),
            F.sum("content_retry").alias("content_retry_count"),
            F.sum("content_retry_failure").alias("content_retry_failure_count"),
            F.avg("before").alias("avg_tokens_before_compression"),
            F.avg("after").alias("avg_tokens_after_compression"),
            ratio(F.sum(F.col("before") - F.col("after")), F.sum("before")).alias("avg_compression_ratio"),
        )
    )


def routing_decisions(av: DataFrame) -> DataFrame:
    """Routing events with their source, model, failure flag and latency."""
    keys = {k: k for k in ("decision_source", "decision_model", "failed", "routing_latency_ms")}
    return with_payload_keys(_events(av, config.MODEL_ROUTING), keys).withColumns({
        "failed": as_boolean(F.col("failed")),
        "routing_latency_ms": as_bigint(F.col("routing_latency_ms")),
    })


def model_routing_analysis(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        routing_decisions(av)
        .groupBy(event_day(av).alias("day"), "decision_source", "decision_model")
        .agg(
            F.count("*").alias("decision_count"),
            F.count_if("failed").alias("failure_count"),
            ratio(F.count_if("failed"), F.count("*")).alias("failure_rate"),
            F.avg("routing_latency_ms").alias("avg_routing_latency_ms"),
        )
    )


def quota_minutes(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """API requests, errors and tokens per user, model and minute."""
    return (
        _events(av, config.API_RESPONSE, config.API_ERROR)
        .filter(F.col(user_col).isNotNull())
        .groupBy(
            event_day(av).alias("day"),
            F.date_trunc("hour", "timestamp").alias("hour"),
            F.date_trunc("minute", "timestamp").alias("minute"),
            user_col,
            "model",
        )
        .agg(
            F.count_if(_is(config.API_RESPONSE)).alias("requests_per_minute"),
            F.count_if(F.col("status_code") == 429).alias("error_429_count_per_minute"),
            F.count_if(F.col("status_code") >= 400).alias("total_errors_per_minute"),
            F.sum("input_tokens").alias("input_tokens_per_minute"),
            F.sum("output_tokens").alias("output_tokens_per_minute"),
            F.sum("total_tokens").alias("total_tokens_per_minute"),
        )
    )


def quota_tracking(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """Minute counts with the hour and day totals of the same user and model beside them.

    The windows run over minutes, not events, so a window partition holds at most the 1440
    minutes of a day however busy the user is. Both window keys share one exchange.
    """
    per_day = Window.partitionBy("day", user_col, "model")
    per_hour = Window.partitionBy("day", "hour", user_col, "model")
    return quota_minutes(av, user_col).withColumns({
        "error_429_count_per_hour": F.sum("error_429_count_per_minute").over(per_hour),
        "error_429_count_per_day": F.sum("error_429_count_per_minute").over(per_day),
        "requests_per_day": F.sum("requests_per_minute").over(per_day),
    })


CONFIG_KEYS = {
    "sandbox_enabled": "sandbox_enabled",
    "log_prompts_enabled": "log_user_prompts_enabled",
    "output_format": "output_format",
    "extensions": "extensions",
    "extension_count": "extension_count",
}


def user_configuration(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """Latest configuration of each user; ``insertId`` decides between equal times.

    The row-number filter turns into a limit per group before the shuffle, so a user with very
    many configuration events sends few of them. The payload is parsed for the kept rows only.
    """
    newest = Window.partitionBy(user_col).orderBy(F.col("timestamp").desc(), F.col("insertId").desc())
    latest = (
        _events(av, config.CONFIG)
        .select(user_col, "cli_version", "timestamp", "insertId", "jsonPayload_json")
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
    )
    return with_payload_keys(latest, CONFIG_KEYS).select(
        user_col,
        "cli_version",
        "sandbox_enabled",
        "log_prompts_enabled",
        "output_format",
        "extensions",
        as_bigint(F.col("extension_count")).alias("extension_count"),
        F.col("timestamp").alias("last_config_timestamp"),
    )
