"""Minute counts for quota alerts, kept by the batches that bring the events.

Each ingest batch stores the counts of its own rows (``plans.refresh``); reading adds them up. There is no state and no
limit on lateness: an event of last week adds to last week's minute. A repeated batch replaces its counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.operators import views

MEASURES = ("requests_per_minute", "error_429_count_per_minute", "total_errors_per_minute")


def minute_counts(av: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    """Requests, rate-limit errors and errors per user, model and minute of event time."""
    return views.quota_minutes(av, user_col).select("day", "minute", user_col, "model", *MEASURES)


def read_partials(spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The counts of each batch."""
    counts = ", ".join(f"{m} bigint" for m in MEASURES)
    columns = f"minute timestamp, {user_col} string, model string, {counts}, day date, batch string"
    return spark.read.schema(columns).parquet(path)


def read_quota_minutes(spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """Counts of every minute over all batches."""
    sums = [F.sum(m).alias(m) for m in MEASURES]
    return read_partials(spark, path, user_col).groupBy("day", "minute", user_col, "model").agg(*sums)


def rpm_alerts(minutes: DataFrame, limit: int = config.RPM_LIMIT) -> DataFrame:
    return minutes.filter(F.col("requests_per_minute") > limit)
