"""Privacy requests: lookup, access, erasure, export, and anonymous statistics."""

from __future__ import annotations

import functools
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.config import USER_EMAIL, USER_PSEUDONYM
from tallybeam.functions.identity import pseudonym
from tallybeam.functions.measures import ratio
from tallybeam.functions.timex import AsOf, day_before, event_day, ts_lit
from tallybeam.operators import base_view, checks, incremental, rollups, views
from tallybeam.sources import commits, folders, index, tables
from tallybeam.sources.index import email_of
from tallybeam.streaming import alerts, quota


def lookup(pseudonymous_av: DataFrame, email: str) -> DataFrame:
    """Activity of one user in pseudonym mode, found by hashing the email."""
    activity = views.user_activity(pseudonymous_av, USER_PSEUDONYM)
    return activity.filter(F.col(USER_PSEUDONYM) == pseudonym(F.lit(email)))


def reverse_lookup(rows: DataFrame, pseudonyms: DataFrame) -> DataFrame:
    """Emails behind pseudonyms (one column ``user_pseudonym``), from the restricted base table or the raw table."""
    payload = F.col("jsonPayload_json")
    email = F.col(USER_EMAIL) if USER_EMAIL in rows.columns else email_of(payload).alias(USER_EMAIL)
    emails = rows.select(email).filter(F.col(USER_EMAIL).isNotNull())
    known = emails.distinct().withColumn(USER_PSEUDONYM, pseudonym(F.col(USER_EMAIL)))
    return known.join(pseudonyms, USER_PSEUDONYM, "left_semi").select(USER_EMAIL, USER_PSEUDONYM)


def _of_user(raw: DataFrame, email: str) -> Column:
    """True for rows of the user; the text search spares other rows the JSON parse, but for those with escapes."""
    payload = F.col("jsonPayload_json")
    likely = payload.contains(email) | payload.contains("\\")
    return F.coalesce(likely & (email_of(payload) == email), F.lit(False))


def on_user_days(raw: DataFrame, base: DataFrame | None, email: str) -> DataFrame:
    """Raw rows of the days on which the base table has the user, and of batches that it doesn't have yet.

    Without a base table, all rows. Days and names of batches reach the driver, bounded by the retention.
    """
    if base is None:
        return raw
    days = tables.of_days(tables.stored_days(base.filter(F.col(USER_EMAIL) == email)))
    stored = base.select(F.col("day").alias("base_day"), F.col("batch").alias("base_batch")).distinct()
    same = F.col("day").eqNullSafe(F.col("base_day")) & (F.col("batch") == F.col("base_batch"))
    behind = raw.select("day", "batch").distinct().join(stored, same, "left_anti")
    return raw.filter(days | of_folders([(r.day, r.batch) for r in behind.collect()]))


def of_folders(found: list[tuple[date | None, str]]) -> Column:
    """Rows of some days' batches, as a filter on the partition columns."""
    kept = F.lit(False)
    for batch in sorted({b for _, b in found}):
        kept = kept | ((F.col("batch") == batch) & tables.of_days([d for d, b in found if b == batch]))
    return kept


def stored_rows(spark: SparkSession, root: str, email: str) -> DataFrame:
    """Raw rows of the days that hold the user, by the user index; reads no payload of other days.

    The index belongs to the raw table's own commits, so this is complete however far the base table lags. Folders from
    before there was an index are read as a whole.
    """
    commits.finish(spark, root)
    old = [name.partition("/batch=") for name in index.not_indexed(spark, root, tables.raw_path(root))]
    found = [(None if day == folders.EMPTY_DAY else date.fromisoformat(day), batch) for day, _, batch in old]
    return tables.read_raw(spark, root).filter(tables.of_days(index.user_days(spark, root, email)) | of_folders(found))


def stored_access(spark: SparkSession, root: str, email: str) -> DataFrame:
    """Every stored raw row of one user, newest first."""
    return access(stored_rows(spark, root, email), email)


def stored_export(spark: SparkSession, root: str, email: str, path: str) -> None:
    export(stored_rows(spark, root, email), email, path)


def access(raw: DataFrame, email: str, base: DataFrame | None = None) -> DataFrame:
    """Every raw row of one user, newest first."""
    rows = on_user_days(raw, base, email).filter(_of_user(raw, email))
    return rows.orderBy(F.col("timestamp").desc(), F.col("insertId").desc())


def export(raw: DataFrame, email: str, path: str, base: DataFrame | None = None) -> None:
    """The user's raw rows as JSON files."""
    on_user_days(raw, base, email).filter(_of_user(raw, email)).write.mode("overwrite").json(path)


def erasure_preview(raw: DataFrame, email: str) -> DataFrame:
    return raw.filter(_of_user(raw, email)).agg(
        F.count("*").alias("records_to_delete"),
        F.min("timestamp").alias("oldest_record"),
        F.max("timestamp").alias("newest_record"),
    )


def without_user(raw: DataFrame, email: str) -> DataFrame:
    return raw.filter(~_of_user(raw, email))


@dataclass
class Erasure:
    days: list[date | None] = field(default_factory=list)
    dead_letter_days: list[date | None] = field(default_factory=list)
    alert_dates: list[date | None] = field(default_factory=list)


AT_ONCE = 5


def json_text_of(value: str) -> str:
    """A pattern for ``value`` as a whole JSON string, in whatever way its characters are escaped.

    The closing quote may be missing where the text was cut off.
    """

    def one(character: str) -> str:
        units = character.encode("utf-16-be")
        escaped = "".join(rf"\\u(?i:{units[k : k + 2].hex()})" for k in range(0, len(units), 2))
        plain = re.escape(character) if character not in '"\\/' else rf"\\?{re.escape(character)}"
        return f"(?:{plain}|{escaped})"

    return '"' + "".join(map(one, value)) + '(?:"|$)'


def user_days(spark: SparkSession, root: str, email: str) -> list[date | None]:
    """Days that hold raw rows of the user."""
    rows = stored_rows(spark, root, email)
    return tables.stored_days(rows.filter(_of_user(rows, email)))


def erase(spark: SparkSession, root: str, email: str, alerts_path: str | None = None) -> Erasure:
    """Delete one user from raw rows, base table, stored views, minute counts, general-access copy, user index, dead letters and
    alerts.

    Tables that don't exist are passed over. A dead letter cannot be parsed, so it goes when its text holds the email as a
    JSON string. Rewrites that were cut off are finished first, so an erasure that failed is simply run again.
    """
    commits.finish(spark, root)
    users = f"{root}/{index.USERS}"
    logs = [tables.raw_path(root), tables.base_path(root), tables.general_path(root), tables.dead_letter_path(root)]
    logs += [tables.minutes_path(root), tables.alerts_path(root), tables.lag_path(root), users]
    views_of = {name: tables.incremental_path(root, name) for name in incremental.ROLLUPS}
    for path in [*logs, *views_of.values(), *([alerts_path] if alerts_path else [])]:
        folders.finish(spark, path)
    result = Erasure()
    other = ~F.coalesce(F.col(USER_EMAIL) == email, F.lit(False))
    if folders.exists(spark, tables.raw_path(root)):
        days = result.days = user_days(spark, root, email)

        def without(table: DataFrame, path: str) -> None:
            tables.rewrite_days(spark, table, days, path, lambda rows: rows.filter(other))

        def base_and_lags() -> None:
            # The base table is written from what stays of the raw rows, which also brings it up to date.
            kept = stored_of(without_user(tables.read_raw(spark, root), email))
            tables.rewrite_days(spark, kept, days, tables.base_path(root), lambda rows: rows)
            if folders.exists(spark, tables.lag_path(root)):
                lags = checks.lag_partial(tables.read_base(spark, tables.base_path(root)), "batch")
                tables.rewrite_days(spark, lags, days, tables.lag_path(root), lambda rows: rows, exchanged=True)

        def general() -> None:
            kept = without_user(tables.read_raw(spark, root), email)
            copy = base_view.stored_columns(base_view.analytics_view(kept, **base_view.GENERAL_ACCESS))
            tables.rewrite_days(spark, copy, days, tables.general_path(root), lambda rows: rows)

        def view(name: str) -> None:
            without(incremental.read_partials(name, spark, views_of[name]), views_of[name])

        minutes, reports = tables.minutes_path(root), tables.alerts_path(root)
        rewrites = {
            tables.base_path(root): base_and_lags,
            tables.general_path(root): general,
            **{path: functools.partial(view, name) for name, path in views_of.items()},
            minutes: lambda: without(quota.read_partials(spark, minutes), minutes),
            reports: lambda: without(alerts.read_reports(spark, root), reports),
        }
        # Most of these tables are small; one after the other, each would leave most of a cluster idle.
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for written in [pool.submit(one) for path, one in rewrites.items() if folders.exists(spark, path)]:
                written.result()
        # Raw rows last: they tell the days when an erasure that failed is run again.
        raw = tables.read_stored(spark, root)
        tables.rewrite_days(spark, raw, days, tables.raw_path(root), lambda rows: without_user(rows, email))
        if folders.exists(spark, users):
            of_user = F.coalesce(F.col("user_pseudonym") == pseudonym(F.lit(email)), F.lit(False))
            listed, indexed = index.user_days(spark, root, email), index.read_users(spark, root)
            tables.rewrite_days(spark, indexed, listed, users, lambda rows: rows.filter(~of_user))
    if folders.exists(spark, tables.dead_letter_path(root)):
        dead = tables.read_dead_letters(spark, root)
        hit = F.coalesce(F.col("value").rlike(json_text_of(email)), F.lit(False))
        result.dead_letter_days = tables.stored_days(dead.filter(hit))
        path = tables.dead_letter_path(root)
        tables.rewrite_days(spark, dead, result.dead_letter_days, path, lambda rows: rows.filter(~hit))
    if alerts_path and folders.exists(spark, alerts_path):
        scheduled = rollups.read_alerts(spark, alerts_path)
        hit = F.coalesce(F.col("user_identifier") == email, F.lit(False))
        dates = [r[0] for r in scheduled.filter(hit).select("alert_date").distinct().collect()]
        if dates:
            kept = scheduled.filter(F.col("alert_date").isin(dates) & ~hit)
            tables.rewrite(spark, kept, dates, alerts_path, ("alert_date", "run"))
        result.alert_dates = sorted(dates)
    return result


def stored_of(raw: DataFrame) -> DataFrame:
    return base_view.stored_columns(base_view.analytics_view(raw))


def active_pseudonyms(pseudonymous_av: DataFrame, as_of: AsOf) -> DataFrame:
    """The activity view has one row per pseudonym, so rows are users."""
    activity = views.user_activity(pseudonymous_av, USER_PSEUDONYM)
    return activity.filter(F.col("last_seen") >= ts_lit(as_of, days=30)).agg(F.count("*").alias("active_users"))


def top_token_users(pseudonymous_av: DataFrame, as_of: AsOf, days: int = 30, limit: int = 10) -> DataFrame:
    """Largest token users with their active days and mean tokens per active day."""
    usage = views.token_usage(pseudonymous_av, USER_PSEUDONYM)
    return (
        usage.filter(F.col("day") >= F.lit(day_before(as_of, days)))
        .groupBy(USER_PSEUDONYM)
        .agg(
            F.sum("grand_total_tokens").alias("total_tokens"),
            F.count_distinct("day").alias("days_active"),
        )
        .withColumn("avg_daily_tokens", F.round(ratio(F.col("total_tokens"), F.col("days_active")), 2))
        .orderBy(F.col("total_tokens").desc_nulls_last(), USER_PSEUDONYM)
        .limit(limit)
    )


def usage_by_day(pseudonymous_av: DataFrame, email: str) -> DataFrame:
    """Token usage of one user by day and model, found by the hash of the email."""
    usage = views.token_usage(pseudonymous_av, USER_PSEUDONYM)
    return usage.filter(F.col(USER_PSEUDONYM) == pseudonym(F.lit(email))).orderBy(F.col("day").desc(), "model")


def anomalies(
    av: DataFrame, as_of: AsOf, user_col: str = USER_PSEUDONYM, days: int = 14, sigma: float = 3.0
) -> DataFrame:
    """Days on which a user's tokens exceed their mean by ``sigma`` sample standard deviations."""
    daily = (
        views.token_usage(av, user_col)
        .filter(F.col("day") >= F.lit(day_before(as_of, days)))
        .groupBy(user_col, "day")
        .agg(F.sum("grand_total_tokens").alias("tokens_used"))
    )
    usual = daily.groupBy(user_col).agg(
        F.avg("tokens_used").alias("avg_tokens"), F.stddev_samp("tokens_used").alias("stddev_tokens")
    )
    z_score = ratio(F.col("tokens_used") - F.col("avg_tokens"), F.col("stddev_tokens"))
    return (
        daily.join(usual, user_col)
        .filter(F.col("tokens_used") > F.col("avg_tokens") + sigma * F.col("stddev_tokens"))
        .select(user_col, "day", "tokens_used", "avg_tokens", F.round(z_score, 2).alias("z_score"))
        .orderBy(F.col("z_score").desc())
    )


def k_anonymous_stats(av: DataFrame, user_col: str = USER_PSEUDONYM, k: int = 5) -> DataFrame:
    """Daily statistics for publication: groups with fewer than ``k`` users are left out."""
    return (
        av.groupBy(event_day(av).alias("day"), "model", "cli_version")
        .agg(
            F.count_distinct(user_col).alias("user_count"),
            F.count("*").alias("total_requests"),
            F.sum("total_tokens").alias("total_tokens"),
            F.avg("duration_ms").alias("avg_duration_ms"),
            F.count("error_code").alias("error_count"),
        )
        .filter(F.col("user_count") >= k)
    )


def write_tiers(raw: DataFrame, analytics_path: str) -> None:
    """The general-access copy: pseudonyms, hashed installations and no payload text.

    The raw table stays under its own root with its own access rules. ``plans.refresh.keep_general_copy`` keeps such a copy
    beside the log, which follows it.
    """
    tables.write_base(raw, analytics_path, **base_view.GENERAL_ACCESS)
