"""Panels named in the dashboard guide without a query; the definitions are this package's own.

Distinct users are always counted from the base view, never summed over groups, and rates are
ratios of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.functions.measures import ratio, with_total
from tallybeam.functions.timex import AsOf, day_before, event_day
from tallybeam.operators import views
from tallybeam.plans.dashboards import last_days, top


def _since(av: DataFrame, as_of: AsOf, days: int) -> DataFrame:
    return av.filter(event_day(av) >= F.lit(day_before(as_of, days)))


def requests_on_day(av: DataFrame, as_of: AsOf) -> DataFrame:
    today = av.filter(event_day(av) == F.lit(day_before(as_of)))
    return today.agg(F.count("*").alias("requests"))


def users_by_model(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return _since(av, as_of, 30).groupBy("model").agg(F.count_distinct(user_col).alias("distinct_users"))


def token_trend(av: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        _since(av, as_of, 30)
        .groupBy(event_day(av).alias("day"))
        .agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    )


def top_token_users(av: DataFrame, user_col: str = USER_EMAIL, limit: int = 10) -> DataFrame:
    return top(views.user_activity(av, user_col).select(user_col, "total_tokens_used"), limit, "total_tokens_used", user_col)


def session_histogram(av: DataFrame, user_col: str = USER_EMAIL, width: int = 5) -> DataFrame:
    """Users by number of sessions, in buckets of ``width`` starting at their lower bound."""
    bucket = (F.floor(F.col("total_sessions") / width) * width).cast("bigint")
    return views.user_activity(av, user_col).groupBy(bucket.alias("sessions_from")).agg(F.count("*").alias("users"))


def token_share(av: DataFrame, as_of: AsOf) -> DataFrame:
    tokens = _since(av, as_of, 30).groupBy("model").agg(F.sum("total_tokens").alias("tokens"))
    return with_total(tokens, "tokens").select(
        "model", "tokens", ratio(F.col("tokens"), F.col("overall")).alias("share")
    )


def token_budget(av: DataFrame, as_of: AsOf, daily_budget: int) -> DataFrame:
    daily = _since(av, as_of, 30).groupBy(event_day(av).alias("day")).agg(F.sum("total_tokens").alias("tokens"))
    return daily.select(
        "day",
        "tokens",
        ratio(F.col("tokens"), F.lit(daily_budget)).alias("budget_used"),
        (F.col("tokens") > daily_budget).alias("over_budget"),
    )


def cached_rate(av: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        _since(av, as_of, 30)
        .groupBy(event_day(av).alias("day"))
        .agg(ratio(F.sum("cached_tokens"), F.sum("input_tokens")).alias("cached_rate"))
    )


def error_heatmap(av: DataFrame, as_of: AsOf) -> DataFrame:
    """Long form (day, version, count): no column per version."""
    return (
        _since(av, as_of, 14)
        .filter(F.col("error_code").isNotNull())
        .groupBy(event_day(av).alias("day"), "cli_version")
        .agg(F.count("*").alias("errors"))
    )


def top10_errors(av: DataFrame, as_of: AsOf, limit: int = 10) -> DataFrame:
    counts = (
        _since(av, as_of, 14)
        .filter(F.col("error_code").isNotNull())
        .groupBy("error_code", "error_message")
        .agg(F.count("*").alias("occurrences"))
    )
    return top(counts, limit, "occurrences", "error_code", "error_message")


def error_rate_trend(av: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        _since(av, as_of, 14)
        .groupBy(event_day(av).alias("day"))
        .agg(ratio(F.count("error_code"), F.count("*")).alias("error_rate"))
    )


def malformed_totals(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Per model and, in the row flagged ``is_total``, over all models."""
    events = _since(av, as_of, 7).filter(F.col("event_name") == config.MALFORMED_JSON)
    measures = (F.count("*").alias("malformed"), F.count_distinct(user_col).alias("users_affected"))
    return events.rollup("model").agg(*measures, (F.grouping("model") == 1).alias("is_total"))


def slash_growth(av: DataFrame, as_of: AsOf) -> DataFrame:
    """Slash commands per day against the previous calendar day (zero when it has none)."""
    daily = (
        _since(av, as_of, 31)
        .filter(F.col("event_name") == config.SLASH_COMMAND)
        .groupBy(event_day(av).alias("day"))
        .agg(F.count("*").alias("commands"))
    )
    previous = daily.select(F.date_add("day", 1).alias("day"), F.col("commands").alias("previous"))
    return daily.join(previous, "day", "left").select(
        "day",
        "commands",
        F.coalesce("previous", F.lit(0)).cast("bigint").alias("previous"),
        (ratio(F.col("commands"), F.col("previous")) - 1).alias("growth"),
    )


def agent_adoption(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    agent_user = F.when(F.col("event_name") == config.AGENT_START, F.col(user_col))
    counted = _since(av, as_of, 30).agg(
        F.count_distinct(agent_user).alias("agent_users"), F.count_distinct(user_col).alias("active_users")
    )
    return counted.withColumn("adoption_rate", ratio(F.col("agent_users"), F.col("active_users")))


def feature_share(av: DataFrame, as_of: AsOf) -> DataFrame:
    counts = (
        _since(av, as_of, 30)
        .filter(F.col("event_name").isin(config.SLASH_COMMAND, config.AGENT_START, config.EXTENSION_INSTALL))
        .groupBy("event_name")
        .agg(F.count("*").alias("uses"))
    )
    return with_total(counts, "uses").select(
        "event_name", "uses", ratio(F.col("uses"), F.col("overall")).alias("share")
    )


def turn_histogram(av: DataFrame, width: int = 3) -> DataFrame:
    bucket = (F.floor(F.col("turn_count") / width) * width).cast("bigint")
    return views.conversations(av).groupBy(bucket.alias("turns_from")).agg(F.count("*").alias("conversations"))


def conversations_by_mode(av: DataFrame) -> DataFrame:
    return (
        views.conversations(av)
        .groupBy("approval_mode")
        .agg(F.count("*").alias("conversations"), F.avg("turn_count").alias("mean_turns"))
    )


def conversation_volume(av: DataFrame) -> DataFrame:
    finished = av.filter(F.col("event_name") == config.CONVERSATION_FINISHED)
    return finished.groupBy(event_day(av).alias("day")).agg(F.count("*").alias("conversations"))


def _tool_calls(av: DataFrame) -> DataFrame:
    return av.filter(F.col("function_name").isNotNull())


def tool_success(av: DataFrame, as_of: AsOf) -> DataFrame:
    ok = F.count_if(F.col("error_code").isNull())
    return _tool_calls(_since(av, as_of, 7)).agg(
        F.count("*").alias("calls"), ratio(ok, F.count("*")).alias("success_rate")
    )


def top_tools(av: DataFrame, as_of: AsOf, limit: int = 10) -> DataFrame:
    counts = _tool_calls(_since(av, as_of, 7)).groupBy("function_name").agg(F.count("*").alias("calls"))
    return top(counts, limit, "calls", "function_name")


def tool_failure_trend(av: DataFrame, as_of: AsOf) -> DataFrame:
    return (
        _tool_calls(_since(av, as_of, 30))
        .groupBy(event_day(av).alias("day"))
        .agg(ratio(F.count("error_code"), F.count("*")).alias("failure_rate"))
    )


def resilience_totals(av: DataFrame, as_of: AsOf) -> DataFrame:
    """Per day and, in the row flagged ``is_total``, over the period."""
    daily = last_days(views.resilience_events(av), as_of, 14)
    retries, failed = F.sum("content_retry"), F.sum("content_retry_failure")
    return daily.rollup("day").agg(
        (F.grouping("day") == 1).alias("is_total"),
        F.sum("flash_fallback").alias("fallbacks"),
        retries.alias("retries"),
        failed.alias("retry_failures"),
        ratio(retries - failed, retries).alias("retry_success_rate"),
        ratio(F.sum(F.col("before") - F.col("after")), F.sum("before")).alias("compression_ratio"),
    )


def routing_totals(av: DataFrame, as_of: AsOf) -> DataFrame:
    """Per decision source and, in the row flagged ``is_total``, over all of them."""
    decisions = views.routing_decisions(_since(av, as_of, 7))
    return decisions.rollup("decision_source").agg(
        (F.grouping("decision_source") == 1).alias("is_total"),
        F.count("*").alias("decisions"),
        ratio(F.count_if("failed"), F.count("*")).alias("failure_rate"),
        F.avg("routing_latency_ms").alias("mean_latency_ms"),
    )


def quota_headroom(
    av: DataFrame,
    as_of: AsOf,
    user_col: str = USER_EMAIL,
    rpm_limit: int = config.RPM_LIMIT,
    rpd_limit: int = config.RPD_LIMIT,
    near: float = 0.8,
) -> DataFrame:
    """Peak minute and day of each user and model against the limits."""
    by_day = (
        last_days(views.quota_minutes(av, user_col), as_of, 7)
        .groupBy("day", user_col, "model")
        .agg(F.max("requests_per_minute").alias("rpm"), F.sum("requests_per_minute").alias("rpd"))
    )
    peaks = by_day.groupBy(user_col, "model").agg(F.max("rpm").alias("peak_rpm"), F.max("rpd").alias("peak_rpd"))
    close = (F.col("peak_rpm") >= near * rpm_limit) | (F.col("peak_rpd") >= near * rpd_limit)
    return peaks.withColumn("near_limit", close)


def _config_share(av: DataFrame, user_col: str, column: str) -> DataFrame:
    counts = views.user_configuration(av, user_col).groupBy(column).agg(F.count("*").alias("users"))
    return with_total(counts, "users").select(
        column, "users", ratio(F.col("users"), F.col("overall")).alias("share")
    )


def sandbox_share(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return _config_share(av, user_col, "sandbox_enabled")


def prompt_logging_share(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return _config_share(av, user_col, "log_prompts_enabled")


def extensions_by_user(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return views.user_configuration(av, user_col).select(user_col, "extensions", "extension_count")


def rollup_totals(rollup: DataFrame, as_of: AsOf) -> DataFrame:
    """30-day totals by model and, in the row flagged ``is_total``, over all models."""
    return last_days(rollup, as_of, 30).rollup("model").agg(
        (F.grouping("model") == 1).alias("is_total"),
        F.sum("request_count").alias("requests"),
        F.sum("total_tokens").alias("tokens"),
        F.sum("error_count").alias("errors"),
    )


def alerts_24h(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    """Violations of the last day by kind; daily alerts count by their date."""
    recent = last_days(alerts, as_of, 1, "alert_date")
    return recent.groupBy("alert_type").agg(F.count("*").alias("violations"))


def top_violators(alerts: DataFrame, limit: int = 10) -> DataFrame:
    counts = alerts.groupBy("user_identifier").agg(
        F.count("*").alias("violations"), F.max("current_value").alias("worst_value")
    )
    return top(counts, limit, "violations", "user_identifier")


def week_over_week(weekly: DataFrame) -> DataFrame:
    """Change against the model's previous week present and share of the week's requests."""
    previous = F.lag("request_count").over(Window.partitionBy("model").orderBy("week_start_date"))
    in_week = F.sum("request_count").over(Window.partitionBy("week_start_date"))
    return weekly.select(
        "week_start_date",
        "model",
        "request_count",
        previous.alias("previous_requests"),
        (ratio(F.col("request_count"), previous) - 1).alias("change"),
        ratio(F.col("request_count"), in_week).alias("share"),
    )
