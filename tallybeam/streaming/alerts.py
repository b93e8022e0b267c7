"""Minute alerts raised by the batches that bring the events.

A batch looks at the minutes it has rows of, adds up what all batches counted in them (``streaming.quota``) and compares that
with what was reported. A minute that goes over the limit is raised once; one whose count changed since, because events came
late, is corrected. An event may be as late as it likes: what is remembered is stored, by the day of the minute, and read
for the days at hand only.

    minute_alerts/day=<event day>/batch=<id>/   minute, user, model, requests_per_minute, kind

A batch owns its reports. When it is repeated, they are made again against those of the others, also on days that were
compacted since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.config import USER_EMAIL
from tallybeam.sources import folders, tables
from tallybeam.streaming import quota

RAISED, CORRECTED = "raised", "corrected"
KEY = ("day", "minute", USER_EMAIL, "model")
REPORTS = f"minute timestamp, {USER_EMAIL} string, model string, requests_per_minute bigint, kind string, day date, batch string"


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Everything that was raised or corrected."""
    return spark.read.schema(REPORTS).parquet(tables.alerts_path(root))


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Minutes over the limit with the count reported last; counts only grow while batches come in."""
    return read_reports(spark, root).groupBy(*KEY).agg(F.max("requests_per_minute").alias("requests_per_minute"))


def _same(left: DataFrame, right: DataFrame) -> Column:
    same = F.lit(True)
    for name in KEY:
        same = same & left[name].eqNullSafe(right[f"of_{name}"])
    return same


def _renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({name: f"of_{name}" for name in KEY})


def report(spark: SparkSession, root: str, batch: str, limit: int = config.RPM_LIMIT) -> None:
    """Raise and correct what a batch brought over the limit, in place of what it reported before."""
    path = tables.minutes_path(root)
    merged = (F.col("batch") == tables.COMPACTED) & tables.of_days(tables.merged_days(spark, root, batch))
    own = quota.read_partials(spark, path).filter((F.col("batch") == batch) | merged)
    days = tables.of_days(tables.stored_days(own))
    touched = _renamed(own.filter("requests_per_minute > 0").select(*KEY).distinct())
    totals = quota.read_quota_minutes(spark, path).filter(days).filter(F.col("requests_per_minute") > limit)
    over = totals.join(touched, _same(totals, touched), "left_semi").select(*KEY, "requests_per_minute")
    if folders.exists(spark, tables.alerts_path(root)):
        others = read_reports(spark, root).filter(days & (F.col("batch") != batch))
        known = _renamed(others.groupBy(*KEY).agg(F.max("requests_per_minute").alias("reported")))
        over = over.join(known, _same(over, known), "left")
    else:
        over = over.withColumn("reported", F.lit(None).cast("long"))
    found = over.filter(F.col("reported").isNull() | (F.col("reported") < F.col("requests_per_minute")))
    kind = F.when(F.col("reported").isNull(), RAISED).otherwise(CORRECTED)
    tables.write_batch(found.select(*KEY, "requests_per_minute", kind.alias("kind")), tables.alerts_path(root), batch, "minute")


def held(spark: SparkSession, root: str, minutes: int) -> DataFrame:
    """Alerts of users and models that were over the limit for ``minutes`` minutes in a row, by the last of these."""
    alerts = read_alerts(spark, root)
    number = F.unix_timestamp("minute") / 60
    order = Window.partitionBy(USER_EMAIL, "model").orderBy("minute")
    first = F.lag("minute", minutes - 1).over(order) if minutes > 1 else F.col("minute")
    apart = number - F.unix_timestamp(first) / 60
    return alerts.withColumn("_apart", apart).filter(F.col("_apart") == minutes - 1).drop("_apart")
