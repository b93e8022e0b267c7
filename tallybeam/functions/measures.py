"""Aggregate and ratio helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def with_total(df: DataFrame, column: str, name: str = "overall") -> DataFrame:
    """Add the sum of ``column`` over the whole frame as a scalar subquery.

    Unlike a window without partition keys this sends no rows to a single task.
    """
    total = df.agg(F.sum(column)).scalar()
    return df.withColumn(name, total)


def usage_measures(user_col: str) -> list[Column]:
    """The seven measures shared by the daily view and both rollups."""
    return [
        F.count("*").alias("request_count"),
        F.count_distinct(F.col(user_col)).alias("distinct_users"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_output_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("duration_ms").alias("average_duration_ms"),
        F.count("error_code").alias("error_count"),
    ]
