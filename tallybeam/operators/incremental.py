"""Incremental refresh of views by mergeable partial aggregates.

A refresh writes the partial aggregates of its own rows under (day, batch); it never reads what
is stored, so its cost follows the new rows, and repeating a batch replaces all of its own
partials, also where it has none any more. Reading merges the partials of each group. An average is stored as sum and count.

Distinct users and sessions are no sums. Views that count them keep partials by user, or by user and session, so that the
merged rows of a group are its distinct members. Partials by day, event, model and user serve the daily view and both
rollups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.config import USER_EMAIL, USER_PSEUDONYM
from tallybeam.functions.measures import ratio
from tallybeam.functions.timex import event_day, week_start
from tallybeam.operators import views
from tallybeam.sources import tables


@dataclass(frozen=True)
class Rollup:
    """How to aggregate new rows, merge stored partials and present the merged groups."""

    partial: Callable[[DataFrame, str], DataFrame]
    keys: tuple[str, ...]
    merge: dict[str, Callable[[str], Column]]
    present: Callable[[DataFrame], DataFrame] = lambda merged: merged

    def group_columns(self, user_col: str) -> list[str]:
        return [user_col if key == "user" else key for key in self.keys]


def _conversation_partial(av: DataFrame, user_col: str) -> DataFrame:
    return (
        views.conversations(av)
        .groupBy(event_day(av).alias("day"), user_col, "cli_version", "approval_mode")
        .agg(
            F.count("*").alias("conversation_count"),
            F.sum("turn_count").alias("turn_sum"),
            F.count("turn_count").alias("turn_n"),
            F.min("turn_count").alias("min_turn_count"),
            F.max("turn_count").alias("max_turn_count"),
        )
    )


def _conversation_view(merged: DataFrame) -> DataFrame:
    average = ratio(F.col("turn_sum"), F.col("turn_n")).alias("avg_turn_count")
    plain = [c for c in merged.columns if c not in ("turn_sum", "turn_n")]
    return merged.select(*plain, average)


# Stored sum, and what it is the sum of.
_SUMS = {
    "total_input_tokens": "input_tokens", "total_output_tokens": "output_tokens", "total_tokens": "total_tokens",
    "duration_sum": "duration_ms",
}
_COUNTS = {"duration_n": "duration_ms", "error_count": "error_code"}


def _usage_partial(av: DataFrame, user_col: str) -> DataFrame:
    return av.groupBy(event_day(av).alias("day"), "event_name", "model", user_col).agg(
        F.count("*").alias("request_count"),
        *[F.sum(of).alias(name) for name, of in _SUMS.items()],
        *[F.count(of).alias(name) for name, of in _COUNTS.items()],
    )


def _usage_of(merged: DataFrame, *keys: str | Column) -> DataFrame:
    """Usage measures of coarser groups, each with its distinct users."""
    (user,) = {USER_EMAIL, USER_PSEUDONYM} & set(merged.columns)
    return merged.groupBy(*keys).agg(
        F.sum("request_count").alias("request_count"),
        F.count_distinct(user).alias("distinct_users"),
        *[F.sum(name).alias(name) for name in list(_SUMS)[:3]],
        ratio(F.sum("duration_sum"), F.sum("duration_n")).alias("average_duration_ms"),
        F.sum("error_count").alias("error_count"),
    )


def _activity_partial(av: DataFrame, user_col: str) -> DataFrame:
    return av.groupBy(event_day(av).alias("day"), user_col, "session_id").agg(
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.count("*").alias("total_requests"),
        F.sum("duration_ms").alias("duration_sum"),
        F.count("duration_ms").alias("duration_n"),
        F.sum("total_tokens").alias("total_tokens_used"),
    )


def _activity_view(merged: DataFrame) -> DataFrame:
    (user,) = {USER_EMAIL, USER_PSEUDONYM} & set(merged.columns)
    return (
        merged.filter(F.col(user).isNotNull())
        .groupBy(user)
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.sum("total_requests").alias("total_requests"),
            F.count("session_id").alias("total_sessions"),
            ratio(F.sum("duration_sum"), F.sum("duration_n")).alias("average_request_duration_ms"),
            F.sum("total_tokens_used").alias("total_tokens_used"),
        )
    )


ROLLUPS = {
    "daily_metrics": Rollup(
        _usage_partial,
        ("day", "event_name", "model", "user"),
        {c: F.sum for c in ("request_count", *_SUMS, *_COUNTS)},
        lambda merged: _usage_of(merged, "day", "event_name", "model"),
    ),
    "user_activity": Rollup(
        _activity_partial,
        ("user", "session_id"),
        {
            "first_seen": F.min, "last_seen": F.max, "total_requests": F.sum, "duration_sum": F.sum,
            "duration_n": F.sum, "total_tokens_used": F.sum,
        },
        _activity_view,
    ),
    "token_usage": Rollup(
        views.token_usage,
        ("day", "user", "model"),
        {c: F.sum for c in (
            "total_input_tokens", "total_output_tokens", "total_cached_tokens", "grand_total_tokens",
        )},
    ),
    "malformed_json_responses": Rollup(
        views.malformed_json_responses, ("day", "model", "user"), {"malformed_json_count": F.sum}
    ),
    "feature_adoption": Rollup(
        views.feature_adoption,
        ("day", "user", "cli_version"),
        {c: F.sum for c in (
            "slash_command_usage_count", "agent_mode_usage_count", "extension_install_count",
        )},
    ),
    "conversation_analysis": Rollup(
        _conversation_partial,
        ("day", "user", "cli_version", "approval_mode"),
        {
            "conversation_count": F.sum, "turn_sum": F.sum, "turn_n": F.sum,
            "min_turn_count": F.min, "max_turn_count": F.max,
        },
        _conversation_view,
    ),
}


def partial(name: str, new_rows: DataFrame, user_col: str = USER_EMAIL) -> DataFrame:
    return ROLLUPS[name].partial(new_rows, user_col)


def refresh(name: str, new_rows: DataFrame, path: str, batch: str, user_col: str = USER_EMAIL) -> None:
    """Store the partial aggregates of ``new_rows`` (base-view rows of one ingest batch) as all that the batch has."""
    tables.write_batch(partial(name, new_rows, user_col), path, batch)


def read_partials(name: str, spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The stored partial aggregates with their day and batch."""
    empty = partial(name, tables.read_empty_base(spark, user_col), user_col).drop("day")
    return spark.read.schema(empty.schema.add("day", "date").add("batch", "string")).parquet(path)


def read(name: str, spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The view, merged from its partials."""
    return ROLLUPS[name].present(merged(name, spark, path, user_col))


def merged(name: str, spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The partials of all batches, one row for each group."""
    rollup = ROLLUPS[name]
    return read_partials(name, spark, path, user_col).groupBy(*rollup.group_columns(user_col)).agg(
        *[how(column).alias(column) for column, how in rollup.merge.items()]
    )


def read_daily_rollup(spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The rollup of every day, from the partials of the daily view at ``path``."""
    return _usage_of(merged("daily_metrics", spark, path, user_col), "day", "model")


def read_weekly_rollup(spark: SparkSession, path: str, user_col: str = USER_EMAIL) -> DataFrame:
    """The rollup of every week, from the same partials: a user who comes on several days counts once."""
    return _usage_of(merged("daily_metrics", spark, path, user_col), week_start(F.col("day")).alias("week_start_date"), "model")


def rebuild(name: str, base: DataFrame, path: str, user_col: str = USER_EMAIL) -> None:
    """Compute the whole view again."""
    rows = partial(name, base, user_col).withColumn("batch", F.lit(tables.COMPACTED))
    (
        rows.hint("rebalance", "day")
        .sortWithinPartitions("day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("day", "batch")
        .parquet(path)
    )
