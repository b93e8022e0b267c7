"""Scheduled tables: daily and weekly rollups and quota alerts, safe to run again."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.functions.measures import usage_measures
from tallybeam.functions.timex import AsOf, day_before, event_day, moment_before, ts_lit, week_start, week_start_of
from tallybeam.operators.views import quota_tracking
from tallybeam.sources import folders


def daily_rollup(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Usage by model of the day before ``as_of``."""
    yesterday = F.lit(day_before(as_of, 1))
    return daily_rollup_history(av.filter(event_day(av) == yesterday), user_col)


def daily_rollup_history(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """The rollup of every day present: what daily runs add up to."""
    return av.groupBy(event_day(av).alias("day"), "model").agg(*usage_measures(user_col))


def weekly_rollup(av: DataFrame, as_of: AsOf, user_col: str = USER_EMAIL) -> DataFrame:
    """Usage by model of the Sunday-started week before that of ``as_of``."""
    first = week_start_of(day_before(as_of, 7))
    day = event_day(av)
    week = av.filter((day >= F.lit(first)) & (day < F.lit(first + timedelta(days=7))))
    return weekly_rollup_history(week, user_col)


def weekly_rollup_history(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return av.groupBy(week_start(event_day(av)).alias("week_start_date"), "model").agg(*usage_measures(user_col))


def quota_alerts(
    av: DataFrame,
    as_of: AsOf,
    user_col: str = USER_EMAIL,
    rpm_limit: int = config.RPM_LIMIT,
    rpd_limit: int = config.RPD_LIMIT,
    lookback_minutes: int = config.ALERT_LOOKBACK_MINUTES,
) -> DataFrame:
    """Minutes over the per-minute limit in the lookback, and users over yesterday's daily limit."""
    tracking = quota_tracking(av, user_col)
    alert_day = F.lit(day_before(as_of))
    lookback = moment_before(as_of, minutes=lookback_minutes)

    def alert(rows: DataFrame, kind: str, value: str, limit: int, when) -> DataFrame:
        return rows.select(
            alert_day.alias("alert_date"),
            F.col(user_col).alias("user_identifier"),
            "model",
            F.lit(kind).alias("alert_type"),
            F.col(value).alias("current_value"),
            F.lit(limit).cast("bigint").alias("quota_limit"),
            when.alias("violation_time"),
        )

    per_minute = tracking.filter(
        (F.col("day") >= F.lit(lookback.date()))
        & (F.col("minute") >= ts_lit(lookback))
        & (F.col("requests_per_minute") > rpm_limit)
    )
    last = Window.partitionBy("day", user_col, "model").orderBy(F.col("minute").desc())
    per_day = (
        tracking.filter((F.col("day") == F.lit(day_before(as_of, 1))) & (F.col("requests_per_day") > rpd_limit))
        .withColumn("_rank", F.row_number().over(last))
        .filter(F.col("_rank") == 1)
    )
    return alert(per_minute, "RPM_EXCEEDED", "requests_per_minute", rpm_limit, F.col("minute")).unionByName(
        alert(per_day, "RPD_EXCEEDED", "requests_per_day", rpd_limit, F.lit(None).cast("timestamp"))
    )


def _replace(rows: DataFrame, path: str, stale: str, *partitions: str, cluster: tuple[str, ...] = ()) -> None:
    """Remove the folders that match ``stale``, which earlier runs of the same job own, and store ``rows``.

    A run without rows so leaves none either, which an overwrite by partition would not.
    """
    spark = rows.sparkSession
    folders.remove(spark, folders.matching(spark, f"{path}/{stale}"))
    folders.make(spark, path)
    written = rows.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *cluster)
    written.write.mode("append").partitionBy(*partitions).parquet(path)


def run_daily_rollup(av: DataFrame, path: str, as_of: AsOf, user_col: str = USER_EMAIL) -> None:
    """The day before ``as_of``, in place of what is stored for that day; other days stay."""
    day = day_before(as_of, 1).isoformat()
    _replace(daily_rollup(av, as_of, user_col), path, f"day={day}", "day", cluster=("model",))


def run_weekly_rollup(av: DataFrame, path: str, as_of: AsOf, user_col: str = USER_EMAIL) -> None:
    first = week_start_of(day_before(as_of, 7)).isoformat()
    rows = weekly_rollup(av, as_of, user_col)
    _replace(rows, path, f"week_start_date={first}", "week_start_date", cluster=("model",))


def run_quota_alerts(av: DataFrame, path: str, as_of: AsOf, run: str, user_col: str = USER_EMAIL, **limits) -> None:
    """Alerts run many times a day: each run owns its folders, on whatever date they are."""
    rows = quota_alerts(av, as_of, user_col, **limits).withColumn("run", F.lit(run))
    stale = f"alert_date=*/run={folders.checked(run)}"
    _replace(rows, path, stale, "alert_date", "run", cluster=("user_identifier", "alert_type"))


_USAGE = (
    "model string, request_count bigint, distinct_users bigint, total_input_tokens bigint, total_output_tokens bigint, "
    "total_tokens bigint, average_duration_ms double, error_count bigint"
)


def read_daily_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; like the two below it may have no rows yet."""
    return spark.read.schema(f"{_USAGE}, day date").parquet(path)


def read_weekly_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_USAGE}, week_start_date date").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    columns = (
        "user_identifier string, model string, alert_type string, current_value bigint, quota_limit bigint, "
        "violation_time timestamp, alert_date date, run string"
    )
    return spark.read.schema(columns).parquet(path)
