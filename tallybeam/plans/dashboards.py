"""Dashboard queries over the derived views.

``av`` is the base view. ``as_of`` stands for the present; a window of N days starts N days
before its date, with no upper bound. A top-k orders by every key after its measure, so equal
measures give the same rows every time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.functions.measures import ratio
from tallybeam.functions.timex import AsOf, day_before, event_day, moment_before, ts_lit
from tallybeam.operators import views


def last_days(frame: DataFrame, as_of: AsOf, days: int, column: str = "day") -> DataFrame:
    return frame.filter(F.col(column) >= F.lit(day_before(as_of, days)))


def newest_first(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.orderBy(*[F.col(c).desc_nulls_last() for c in columns])


def top(frame: DataFrame, limit: int, measure: str, *ties: str) -> DataFrame:
    return frame.orderBy(F.col(measure).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(limit)


def daily_metrics_30d(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    recent = last_days(views.daily_metrics(av, user_col), as_of, 30)
    columns = ("day", "model", "request_count", "distinct_users", "total_tokens", "error_count")
    return newest_first(recent.select(*columns), "day")


def top_users(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, limit: int = 20) -> DataFrame:
    """Busiest users with the whole 24-hour days between their first and last event."""
    activity = views.user_activity(av, user_col).select(
        user_col,
        "total_requests",
        "total_sessions",
        "total_tokens_used",
        F.timestamp_diff("DAY", F.col("first_seen"), F.col("last_seen")).alias("days_active"),
    )
    return top(activity, limit, "total_requests", user_col)


def tokens_by_day_model(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        last_days(views.token_usage(av, user_col), as_of, 7)
        .groupBy("day", "model")
        .agg(
            F.sum("total_input_tokens").alias("input_tokens"),
            F.sum("total_output_tokens").alias("output_tokens"),
            F.sum("total_cached_tokens").alias("cached_tokens"),
        )
        .orderBy("day")
    )


def top_errors(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, limit: int = 50) -> DataFrame:
    recent = last_days(views.error_analysis(av, user_col), as_of, 14)
    return top(recent, limit, "error_count", "day", "cli_version", "model", "error_code", "error_message")


def malformed_trend(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        last_days(views.malformed_json_responses(av, user_col), as_of, 7)
        .groupBy("day", "model")
        .agg(F.sum("malformed_json_count").alias("total_malformed"))
        .orderBy("day")
    )


def features_by_version(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    totals = (
        last_days(views.feature_adoption(av, user_col), as_of, 30)
        .groupBy("cli_version")
        .agg(
            F.sum("slash_command_usage_count").alias("slash_commands"),
            F.sum("agent_mode_usage_count").alias("agent_mode"),
            F.sum("extension_install_count").alias("extensions"),
        )
    )
    return newest_first(totals, "cli_version")


def conversations_30d(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    recent = last_days(views.conversation_analysis(av, user_col), as_of, 30)
    columns = ("day", "approval_mode", "conversation_count", "avg_turn_count", "min_turn_count", "max_turn_count")
    return newest_first(recent.select(*columns), "day")


def tool_rollup(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Tool totals; the two means are unweighted means of daily values, as published."""
    totals = (
        last_days(views.tool_performance(av, user_col), as_of, 7)
        .groupBy("function_name")
        .agg(
            F.sum("total_calls").alias("calls"),
            F.sum("successful_calls").alias("successes"),
            F.sum("failed_calls").alias("failures"),
            F.avg("success_rate").alias("success_rate"),
            F.avg("average_execution_duration_ms").alias("avg_duration_ms"),
        )
    )
    return newest_first(totals, "calls")


def retry_success(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    retries, failed = F.col("content_retry_count"), F.col("content_retry_failure_count")
    recent = last_days(views.cli_resilience(av, user_col), as_of, 14).select(
        "day",
        "model",
        "flash_fallback_count",
        "content_retry_count",
        "content_retry_failure_count",
        ratio(retries - failed, retries).alias("retry_success_rate"),
        "avg_compression_ratio",
    )
    return newest_first(recent, "day")


def routing(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    recent = last_days(views.model_routing_analysis(av, user_col), as_of, 7)
    return newest_first(recent.drop("day"), "decision_count")


def near_limit(
    av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, above: int = config.RPM_WARNING, limit: int = 100
) -> DataFrame:
    """Newest minutes of today that come near the per-minute limit."""
    rows = (
        views.quota_tracking(av, user_col)
        .filter((F.col("day") == F.lit(day_before(as_of))) & (F.col("requests_per_minute") > above))
        .select("minute", user_col, "model", "requests_per_minute", "requests_per_day", "total_tokens_per_minute")
    )
    return top(rows, limit, "minute", user_col, "model")


def latest_configs(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, limit: int = 100) -> DataFrame:
    rows = views.user_configuration(av, user_col).select(
        user_col,
        "cli_version",
        "sandbox_enabled",
        "log_prompts_enabled",
        "output_format",
        "extension_count",
        "last_config_timestamp",
    )
    return top(rows, limit, "last_config_timestamp", user_col)


def rollup_90d(rollup: DataFrame, as_of: AsOf) -> DataFrame:
    columns = ("day", "model", "request_count", "distinct_users", "total_tokens", "error_count")
    return newest_first(last_days(rollup, as_of, 90).select(*columns), "day")


def recent_alerts(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    columns = (
        "alert_date", "user_identifier", "model", "alert_type", "current_value", "quota_limit", "violation_time",
    )
    return newest_first(last_days(alerts, as_of, 7, "alert_date").select(*columns), "alert_date", "violation_time")


def weekly_error_rate(weekly: DataFrame, limit: int = 12) -> DataFrame:
    rows = weekly.select(
        "week_start_date",
        "model",
        "request_count",
        "distinct_users",
        "total_tokens",
        ratio(F.col("error_count"), F.col("request_count")).alias("error_rate"),
    )
    return top(rows, limit, "week_start_date", "model")


def request_volume(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return (
        last_days(views.daily_metrics(av, user_col), as_of, 30)
        .select(F.col("day").cast("timestamp").alias("time"), "model", F.col("request_count").alias("value"))
        .orderBy("time")
    )


def active_users(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Users ever seen and users seen in the last 30 days; the activity view has one row per user."""
    recent = F.col("last_seen") >= ts_lit(as_of, days=30)
    return views.user_activity(av, user_col).agg(
        F.count("*").alias("total_users"), F.count_if(recent).alias("active_30d")
    )


def error_rate(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    recent = last_days(views.daily_metrics(av, user_col), as_of, 7)
    return recent.agg((ratio(F.sum("error_count"), F.sum("request_count")) * 100).alias("value"))


def tokens_by_model(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    recent = last_days(views.token_usage(av, user_col), as_of, 7)
    return recent.groupBy("model").agg(F.sum("grand_total_tokens").alias("value"))


def token_trend_long(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Two rows per day, one per metric, from one aggregation."""
    daily = (
        last_days(views.token_usage(av, user_col), as_of, 30)
        .groupBy(F.col("day").cast("timestamp").alias("time"))
        .agg(
            F.sum("total_input_tokens").alias("Input Tokens"),
            F.sum("total_output_tokens").alias("Output Tokens"),
        )
    )
    return daily.unpivot("time", ["Input Tokens", "Output Tokens"], "metric", "value").orderBy("time")


def top_errors_sum(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, limit: int = 20) -> DataFrame:
    """Users are summed over groups, as published, so one user may count more than once."""
    totals = (
        last_days(views.error_analysis(av, user_col), as_of, 7)
        .groupBy("error_code", "error_message")
        .agg(
            F.sum("error_count").alias("occurrences"),
            F.sum("distinct_users_affected").alias("users_affected"),
        )
    )
    return top(totals, limit, "occurrences", "error_code", "error_message")


def tool_success_pct(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, limit: int = 15) -> DataFrame:
    totals = (
        last_days(views.tool_performance(av, user_col), as_of, 7)
        .groupBy("function_name")
        .agg(
            F.sum("total_calls").alias("calls"),
            (F.avg("success_rate") * 100).alias("success_rate_pct"),
            F.avg("average_execution_duration_ms").alias("avg_duration_ms"),
        )
    )
    return top(totals, limit, "calls", "function_name")


def rpm_last_hour(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    since = moment_before(as_of, hours=1)
    return (
        views.quota_minutes(av, user_col)
        .filter((F.col("day") >= F.lit(since.date())) & (F.col("minute") >= ts_lit(since)))
        .select(F.col("minute").alias("time"), user_col, F.col("requests_per_minute").alias("value"))
        .orderBy("time")
    )


def _rate_limits_by(av: DataFrame, user_col: str, *keys: str) -> DataFrame:
    """Totals from the per-minute counts; the hour and day columns repeat and must not be summed."""
    return (
        views.quota_minutes(av, user_col)
        .groupBy(*keys)
        .agg(
            F.sum("error_429_count_per_minute").alias("total_429_errors"),
            F.sum("requests_per_minute").alias("total_requests"),
        )
    )


def rate_limits_by_day(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return newest_first(last_days(_rate_limits_by(av, user_col, "day"), as_of, 7), "day")


def rate_limited_days(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL, days: int = 0) -> DataFrame:
    """Days, from ``days`` ago on, with any rate-limit error."""
    totals = last_days(_rate_limits_by(av, user_col, "day"), as_of, days)
    return totals.filter(F.col("total_429_errors") > 0).select("day", F.col("total_429_errors").alias("total_429s"))


def rate_limit_scorecards(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Rate-limit errors of one day: total, share of API calls in percent, users affected."""
    errors, requests = F.sum("error_429_count_per_minute"), F.sum("requests_per_minute")
    hit = F.when(F.col("error_429_count_per_minute") > 0, F.col(user_col))
    return (
        views.quota_minutes(av, user_col)
        .filter(F.col("day") == F.lit(day_before(as_of)))
        .agg(
            errors.alias("total_429_errors"),
            (ratio(errors, errors + requests) * 100).alias("error_rate_pct"),
            F.count_distinct(hit).alias("affected_users"),
        )
    )


def rate_limits_by_hour(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    return last_days(_rate_limits_by(av, user_col, "day", "hour"), as_of, 7).drop("day").orderBy("hour")


def rate_limits_by_user_model(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    minutes = last_days(views.quota_minutes(av, user_col), as_of, 7)
    totals = minutes.groupBy(user_col, "model").agg(F.sum("error_429_count_per_minute").alias("total_429_errors"))
    return newest_first(totals.filter(F.col("total_429_errors") > 0), "total_429_errors")


def rpm_alert_rule(
    av: DataFrame,
    as_of: AsOf,
    user_col: str = USER_EMAIL,
    above: int = config.RPM_WARNING,
    critical: int = config.RPM_LIMIT,
    hold_minutes: int = 5,
) -> DataFrame:
    """Users whose last value is critical and has been for ``hold_minutes`` minutes in a row.

    Values are today's minutes above ``above``; a user's value in a minute is the largest over
    models. Critical minutes without a gap form an island: minute minus row number is constant.
    """
    minute_values = (
        views.quota_minutes(av, user_col)
        .filter((F.col("day") == F.lit(day_before(as_of))) & (F.col("requests_per_minute") > above))
        .groupBy("day", user_col, "minute")
        .agg(F.max("requests_per_minute").alias("value"))
    )
    per_user = Window.partitionBy("day", user_col)
    minute_number = (F.unix_timestamp("minute") / 60).cast("bigint")
    # Bounded windows: a user has at most 1440 minutes in a day.
    critical_rows = (
        minute_values.withColumn("last_minute", F.max("minute").over(per_user))
        .filter(F.col("value") > critical)
        .withColumn("island", minute_number - F.row_number().over(per_user.orderBy("minute")))
    )
    return (
        critical_rows.groupBy("day", user_col, "last_minute", "island")
        .agg(
            F.max("minute").alias("until"),
            F.max_by("value", "minute").alias("last_value"),
            F.count("*").alias("minutes_held"),
        )
        .filter((F.col("until") == F.col("last_minute")) & (F.col("minutes_held") >= hold_minutes))
        .select(user_col, "last_minute", "last_value", "minutes_held")
    )


def _level(value: Column, warning: float, critical: float | None) -> Column:
    if critical is None:
        return F.when(value > warning, "warning")
    return F.when(value > critical, "critical").when(value > warning, "warning")


def threshold_alerts(
    av: DataFrame,
    as_of: AsOf,
    user_col: str = USER_EMAIL,
    days: int = 0,
    rpm: tuple[int, int] = (config.RPM_WARNING, config.RPM_LIMIT),
    rpd: tuple[int, int] = (config.RPD_WARNING, config.RPD_LIMIT),
    error_rate_limit: float = config.ERROR_RATE_LIMIT,
    malformed_limit: int = config.MALFORMED_PER_DAY_LIMIT,
) -> DataFrame:
    """All published thresholds, from ``days`` ago on, as one list of warnings and criticals.

    Per-minute rows keep the day's highest minute of a user and model.
    """
    quota = (
        last_days(views.quota_minutes(av, user_col), as_of, days)
        .groupBy("day", user_col, "model")
        .agg(F.max("requests_per_minute").alias("rpm"), F.sum("requests_per_minute").alias("rpd"))
    )
    day = event_day(av).alias("day")
    totals = (
        av.filter(event_day(av) >= F.lit(day_before(as_of, days)))
        .groupBy(day)
        .agg(
            ratio(F.count("error_code"), F.count("*")).alias("error_rate"),
            F.count_if(F.col("event_name") == config.MALFORMED_JSON).alias("malformed"),
        )
    )

    def rows(frame: DataFrame, kind: str, value: str, warning: float, critical: float | None) -> DataFrame:
        has_user = user_col in frame.columns
        nothing = F.lit(None).cast("string")
        return frame.select(
            "day",
            (F.col(user_col) if has_user else nothing).alias("user_identifier"),
            (F.col("model") if has_user else nothing).alias("model"),
            F.lit(kind).alias("rule"),
            F.col(value).cast("double").alias("value"),
            _level(F.col(value), warning, critical).alias("level"),
        ).filter(F.col("level").isNotNull())

    return (
        rows(quota, "rpm", "rpm", *rpm)
        .unionByName(rows(quota, "rpd", "rpd", *rpd))
        .unionByName(rows(totals, "error_rate", "error_rate", error_rate_limit, None))
        .unionByName(rows(totals, "malformed_json", "malformed", malformed_limit, None))
    )
