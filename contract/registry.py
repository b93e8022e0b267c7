"""Every query of the package as (spark, sf_dir) -> DataFrame, over the whole test tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract import adapter
from tallybeam import config
from tallybeam.config import USER_EMAIL, USER_PSEUDONYM
from tallybeam.functions.jsonx import json_scalar
from tallybeam.operators import base_view, checks, error_summary, incremental, ingest, privacy, rollups, views
from tallybeam.plans import build, dashboards, panels, refresh
from tallybeam.sources import tables
from tallybeam.streaming import alerts as stream_alerts
from tallybeam.streaming import ingest as stream_ingest
from tallybeam.streaming import quota

AS_OF = "2024-01-31 00:00:00"
TODAY = "2024-01-30 23:00:00"
DAY_BEFORE = "2024-01-30 00:00:00"
# The test data is sparse, so limits that would be 120 and 2000 are small here.
LIMITS = {"rpm_limit": 0, "rpd_limit": 2}
ALERTS = {**LIMITS, "lookback_minutes": 1440}
EMAIL = "user7@example.com"

Query = Callable[[SparkSession, str], DataFrame]


def present(df: DataFrame) -> DataFrame:
    """Shape a result for comparison: UTC wall-clock times and doubles rounded to 6 places."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _query(function: Query) -> Query:
    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config.prepare_session(spark)
        return present(function(spark, sf_dir))

    return run


def over_base(function: Callable[..., DataFrame], *args, pseudonymize: bool = False, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        av = adapter.base(spark, sf_dir)
        return function(base_view.with_pseudonyms(av) if pseudonymize else av, *args, **kwargs)

    return run


def over_raw(function: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: function(adapter.raw(spark, sf_dir), *args, **kwargs)


def _raw_shape(rows: DataFrame) -> DataFrame:
    """Raw columns with the payload cut down to one value; its text has no SQL counterpart."""
    event = json_scalar(F.col("jsonPayload_json"), "$['event.name']")
    return rows.withColumn("payload_event", event).select(
        *[c for c in ingest.RAW_COLUMNS if c != "jsonPayload_json"], "payload_event"
    )


def ingest_raw_logs(spark, sf_dir):
    return _raw_shape(ingest.raw_rows(adapter.messages(spark, sf_dir), adapter.PROJECT))


def _ids(classified: DataFrame, *outcomes: str) -> DataFrame:
    kept = ingest.with_outcome(classified, *outcomes)
    return kept.groupBy(F.col("envelope.insertId").alias("insert_id")).agg(F.count("*").alias("messages"))


def route_filter(spark, sf_dir):
    classified = ingest.classify(adapter.messages(spark, sf_dir), adapter.PROJECT)
    return _ids(classified, ingest.ROUTED, ingest.DIAGNOSTIC)


def exclude_diagnostic(spark, sf_dir):
    return _ids(ingest.classify(adapter.messages(spark, sf_dir), adapter.PROJECT), ingest.ROUTED)


def dead_letter(spark, sf_dir):
    """Rejected messages by reason; every 41st event comes once more as a bare JSON string."""
    messages = adapter.messages(spark, sf_dir)
    scalars = adapter.flat_events(spark, sf_dir).filter("event_id % 41 = 0").select(F.to_json(F.array("insert_id")).alias("value"))
    bare = scalars.select(F.expr("substring(value, 2, length(value) - 2)").alias("value"))
    rejected = ingest.dead_letters(messages.unionByName(bare))
    return rejected.groupBy("reason").agg(F.count("*").alias("messages"))


def dedup_insert_id(spark, sf_dir):
    routed = ingest.to_raw(ingest.classify(adapter.messages(spark, sf_dir), adapter.PROJECT))
    kept = ingest.deduplicate(ingest.with_outcome(routed, ingest.ROUTED))
    return kept.select("insertId", "receiveTimestamp")


def raw_partition_counts(raw):
    return raw.groupBy("day").agg(F.count("*").alias("row_count"))


def raw_schema_doc(raw):
    return tables.schema_doc(raw).select("position", "column_name", "data_type", "description", "filled_rows")


def retention_keep(raw):
    return raw_partition_counts(tables.retained(raw, AS_OF, 14))


def analytics_view(raw, **options):
    view = base_view.stored_columns(base_view.analytics_view(raw, **options))
    return view.drop("jsonPayload_json", *base_view.PARTITIONS)


def parsed_json_fields(raw):
    def text(column: str, path: str):
        return F.try_variant_get(column, path, "string")

    return base_view.analytics_view(raw).select(
        "insertId",
        text("resource", "$.labels.project_id").alias("project_id"),
        text("labels", "$.cli_version").alias("cli_version"),
        text("operation", "$.id").alias("operation_id"),
        text("httpRequest", "$.requestMethod").alias("request_method"),
        text("payload", "$['event.name']").alias("event_name"),
    )


def json_scalars(raw):
    payload = F.col("jsonPayload_json")
    paths = {
        "function_args": "$.function_args",
        "error": "$.error",
        "finish_reason": "$['gen_ai.response.finish_reasons']",
        "approval_mode": "$.approvalMode",
        "extensions": "$.extensions",
    }
    return raw.select("insertId", *[json_scalar(payload, path).alias(name) for name, path in paths.items()])


def error_429_sample(av, user_col=USER_EMAIL):
    return error_summary.error_429_sample(av, user_col).drop("insertId")


def stored_daily_rollup(spark, sf_dir):
    """Two runs for the same day leave one set of rows."""
    path = tables.work_dir(spark, "daily-rollup")
    av = adapter.base(spark, sf_dir)
    for _ in range(2):
        rollups.run_daily_rollup(av, path, AS_OF)
    return rollups.read_daily_rollup(spark, path)


def rollup_rerun_emptied(spark, sf_dir):
    """A day whose rows are gone when its run is repeated leaves nothing; the other day stays."""
    path = tables.work_dir(spark, "daily-rollup")
    av = adapter.base(spark, sf_dir)
    for as_of in (AS_OF, DAY_BEFORE):
        rollups.run_daily_rollup(av, path, as_of)
    rollups.run_daily_rollup(av.filter("day < '2024-01-30'"), path, AS_OF)
    return rollups.read_daily_rollup(spark, path)


def alerts_rerun_emptied(spark, sf_dir):
    """The same for two alert runs of one day."""
    path = tables.work_dir(spark, "alerts")
    av = adapter.base(spark, sf_dir)
    for run in ("first", "second"):
        rollups.run_quota_alerts(av, path, AS_OF, run, **ALERTS)
    rollups.run_quota_alerts(av.filter(F.lit(False)), path, AS_OF, "first", **ALERTS)
    return rollups.read_alerts(spark, path)


def incremental_rerun_emptied(spark, sf_dir):
    """A batch that is repeated without rows leaves none."""
    path = tables.work_dir(spark, "usage")
    av = adapter.base(spark, sf_dir)
    early = F.hour("timestamp") < 12
    for batch, rows in (("0", early), ("1", ~early), ("1", F.lit(False))):
        incremental.refresh("token_usage", av.filter(rows), path, f"batch-{batch}")
    return incremental.read("token_usage", spark, path)


def build_tables_history(spark, sf_dir):
    """Building for two moments keeps the rows of both."""
    root = tables.work_dir(spark, "built")
    for as_of in (DAY_BEFORE, AS_OF):
        build.build_all(spark, adapter.base(spark, sf_dir), as_of, table_root=root)
    return rollups.read_daily_rollup(spark, f"{root}/daily_rollup_table")


def batched_store(spark, sf_dir, known: bool) -> str:
    """Root of a log that came in three batches, some messages in all of them, carried on to base and stored views."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        share = F.xxhash64("value")
        for k in range(3):
            batch = f"batch-{k}"
            rows = messages.filter((F.pmod(share, F.lit(3)) == k) | (F.pmod(share, F.lit(31)) == 0))
            stored = tables.known_rows(spark, root, batch) if known else None
            tables.ingest_batch(rows, root, adapter.PROJECT, batch, AS_OF, stored)
            refresh.refresh_batch(spark, root, batch)

    return adapter.prepared(spark, sf_dir, f"batched-{known}", fill)


def chained_refresh(spark, sf_dir):
    """A stored view kept by its batches, redelivered messages left out."""
    root = batched_store(spark, sf_dir, known=True)
    return incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))


def repaired_store(spark, sf_dir) -> str:
    """A log whose batches hold copies of each other, after all its days were compacted."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        share = F.xxhash64("value")
        for k in range(3):
            rows = messages.filter((F.pmod(share, F.lit(3)) == k) | (F.pmod(share, F.lit(31)) == 0))
            tables.ingest_batch(rows, root, adapter.PROJECT, f"batch-{k}", AS_OF)
            refresh.refresh_batch(spark, root, f"batch-{k}")
        days = tables.stored_days(tables.read_raw(spark, root))
        tables.repair_days(spark, root, days)
        refresh.refresh_days(spark, root, days)

    return adapter.prepared(spark, sf_dir, "repaired", fill)


def compacted_day_counts(spark, sf_dir):
    raw = tables.read_raw(spark, repaired_store(spark, sf_dir))
    return raw.groupBy("day", "batch").agg(F.count("*").alias("row_count"))


def base_after_repair(spark, sf_dir):
    return views.daily_metrics(tables.read_base(spark, tables.base_path(repaired_store(spark, sf_dir))))


def batch_after_compaction(spark, sf_dir):
    """Rows by table after a batch, whose days were compacted, was ingested and carried on once more."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        share = F.xxhash64("value")
        rows = [messages.filter((F.pmod(share, F.lit(3)) == k) | (F.pmod(share, F.lit(31)) == 0)) for k in range(3)]
        for k in (0, 1, 2):
            tables.ingest_batch(rows[k], root, adapter.PROJECT, f"batch-{k}", AS_OF)
            refresh.refresh_batch(spark, root, f"batch-{k}")
        days = tables.stored_days(tables.read_raw(spark, root))
        tables.repair_days(spark, root, days)
        refresh.refresh_days(spark, root, days)
        tables.ingest_batch(rows[1], root, adapter.PROJECT, "batch-1", AS_OF)
        refresh.refresh_batch(spark, root, "batch-1")

    root = adapter.prepared(spark, sf_dir, "again", fill)
    counts = {
        "raw": (tables.read_raw(spark, root), F.count("*")),
        "base": (tables.read_base(spark, tables.base_path(root)), F.count("*")),
        "requests": (incremental.read("daily_metrics", spark, tables.incremental_path(root, "daily_metrics")), F.sum("request_count")),
        "minutes": (quota.read_quota_minutes(spark, tables.minutes_path(root)), F.sum("requests_per_minute")),
    }
    found = [
        rows.groupBy(F.lit(name).alias("table_name"), "day").agg(total.alias("row_count")) for name, (rows, total) in counts.items()
    ]
    return functools.reduce(DataFrame.unionByName, found)


def ingest_only_new(spark, sf_dir):
    """Three batches with redeliveries among them, found by the id index."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        share = F.xxhash64("value")
        for k in range(3):
            rows = messages.filter((F.pmod(share, F.lit(3)) == k) | (F.pmod(share, F.lit(31)) == 0))
            tables.ingest_batch(rows, root, adapter.PROJECT, f"batch-{k}", AS_OF, only_new=True)

    return _raw_shape(tables.read_raw(spark, adapter.prepared(spark, sf_dir, "only-new", fill)))


def lagging_store(spark, sf_dir) -> str:
    """A log in two batches of which the base table has the first."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        for k in range(2):
            rows = messages.filter(F.pmod(F.xxhash64(F.get_json_object("value", "$.insertId")), F.lit(2)) == k)
            tables.ingest_batch(rows, root, adapter.PROJECT, f"batch-{k}", AS_OF)
        refresh.refresh_batch(spark, root, "batch-0")

    return adapter.prepared(spark, sf_dir, "lagging", fill)


def privacy_access_behind(spark, sf_dir):
    return _raw_shape(privacy.stored_access(spark, lagging_store(spark, sf_dir), EMAIL))


def privacy_export_behind(spark, sf_dir):
    path = tables.work_dir(spark, "export")
    privacy.stored_export(spark, lagging_store(spark, sf_dir), EMAIL, path)
    return spark.read.schema("insertId string, severity string").json(path)


def tier_after_erasure(spark, sf_dir):
    """Rows by user of the general-access copy that came along with two batches, a repair and an erasure."""

    def fill(root: str) -> None:
        messages = adapter.messages(spark, sf_dir)
        half = F.pmod(F.xxhash64("value"), F.lit(2))
        for k in range(2):
            tables.ingest_batch(messages.filter(half == k), root, adapter.PROJECT, f"batch-{k}", AS_OF)
            refresh.refresh_batch(spark, root, f"batch-{k}")
            if not k:
                refresh.keep_general_copy(spark, root)
        days = tables.stored_days(tables.read_raw(spark, root))
        tables.repair_days(spark, root, days)
        refresh.refresh_days(spark, root, days)
        privacy.erase(spark, root, EMAIL)

    copy = spark.read.parquet(tables.general_path(adapter.prepared(spark, sf_dir, "tiers", fill)))
    return copy.groupBy(USER_PSEUDONYM).agg(F.count("*").alias("row_count"))


def usage_partials(spark, sf_dir) -> str:
    """Partials of the daily view, in two batches of which one came twice."""

    def fill(path: str) -> None:
        av = adapter.base(spark, sf_dir)
        early = F.hour("timestamp") < 12
        for batch, rows in (("0", early), ("1", ~early), ("1", ~early)):
            incremental.refresh("daily_metrics", av.filter(rows), path, f"batch-{batch}")

    return adapter.prepared(spark, sf_dir, "usage-partials", fill)


def daily_rollup_incremental(spark, sf_dir):
    return incremental.read_daily_rollup(spark, usage_partials(spark, sf_dir))


def weekly_rollup_incremental(spark, sf_dir):
    return incremental.read_weekly_rollup(spark, usage_partials(spark, sf_dir))


def ingest_lag_sketched(spark, sf_dir):
    """Lag by day from the sketches of three batches, and whether the percentile's rank among all rows is near enough."""
    root = batched_store(spark, sf_dir, known=True)
    found = checks.read_ingest_lag(spark, tables.lag_path(root))
    raw = tables.read_raw(spark, root)
    lag = (F.unix_micros("receiveTimestamp") - F.unix_micros("timestamp")) / 1e6
    rows = raw.select(F.col("day").alias("of_day"), lag.alias("lag")).join(found, F.col("of_day") == F.col("day"))
    ranks = rows.groupBy("day", "mean_lag_s", "max_lag_s").agg(
        F.avg((F.col("lag") < F.col("p95_lag_s")).cast("double")).alias("below"),
        F.avg((F.col("lag") <= F.col("p95_lag_s")).cast("double")).alias("up_to"),
    )
    return ranks.select("day", "mean_lag_s", "max_lag_s", ((F.col("below") <= 0.97) & (F.col("up_to") >= 0.93)).alias("p95_near"))


def privacy_erasure_stored(spark, sf_dir):
    """What an erasure leaves: rows of the user, and of others, in each stored table."""

    def fill(root: str) -> None:
        tables.ingest_batch(adapter.messages(spark, sf_dir), root, adapter.PROJECT, "batch-0", AS_OF)
        refresh.refresh_batch(spark, root, "batch-0")
        base = tables.read_base(spark, tables.base_path(root))
        rollups.run_quota_alerts(base, f"{root}/alerts", AS_OF, "run", **ALERTS)
        privacy.erase(spark, root, EMAIL, f"{root}/alerts")

    root = adapter.prepared(spark, sf_dir, "erased", fill)
    user = {
        "raw": (tables.read_raw(spark, root), privacy.email_of(F.col("jsonPayload_json"))),
        "base": (tables.read_base(spark, tables.base_path(root)), F.col(USER_EMAIL)),
        "minutes": (quota.read_partials(spark, tables.minutes_path(root)), F.col(USER_EMAIL)),
        "alerts": (rollups.read_alerts(spark, f"{root}/alerts"), F.col("user_identifier")),
    }
    for name in incremental.ROLLUPS:
        user[name] = incremental.read_partials(name, spark, tables.incremental_path(root, name)), F.col(USER_EMAIL)
    counts = [
        rows.agg(
            F.lit(name).alias("table_name"), F.count_if(email == EMAIL).alias("of_user"),
            F.count_if(~email.eqNullSafe(F.lit(EMAIL))).alias("of_others"),
        )
        for name, (rows, email) in user.items()
    ]
    return functools.reduce(DataFrame.unionByName, counts)


def retention_raw(spark, sf_dir):
    """Rows by day after retention removed the old partitions of a stored log."""

    def fill(root: str) -> None:
        tables.ingest_batch(adapter.messages(spark, sf_dir), root, adapter.PROJECT, "batch-0", AS_OF)
        tables.expire(spark, tables.raw_path(root), AS_OF, 14)

    return raw_partition_counts(tables.read_raw(spark, adapter.prepared(spark, sf_dir, "expired", fill)))


def retention_daily(spark, sf_dir):
    path = tables.work_dir(spark, "daily-rollup")
    for as_of in ("2024-01-10", "2024-01-24", AS_OF):
        rollups.run_daily_rollup(adapter.base(spark, sf_dir), path, as_of)
    tables.expire(spark, path, AS_OF, 8)
    return rollups.read_daily_rollup(spark, path)


def retention_weekly(spark, sf_dir):
    path = tables.work_dir(spark, "weekly-rollup")
    for as_of in ("2024-01-17", "2024-01-24", AS_OF):
        rollups.run_weekly_rollup(adapter.base(spark, sf_dir), path, as_of)
    tables.expire(spark, path, AS_OF, 17, "week_start_date")
    return rollups.read_weekly_rollup(spark, path)


def retention_alerts(spark, sf_dir):
    path = tables.work_dir(spark, "alerts")
    for run, as_of in (("old", "2024-01-10"), ("new", AS_OF)):
        rollups.run_quota_alerts(adapter.base(spark, sf_dir), path, as_of, run, **ALERTS)
    tables.expire(spark, path, AS_OF, 10, "alert_date")
    return rollups.read_alerts(spark, path)


def incremental_view(name: str) -> Query:
    def run(spark, sf_dir):
        """Two refreshes, one of them repeated, then a merged read."""
        path = tables.work_dir(spark, name)
        av = adapter.base(spark, sf_dir)
        early = F.hour("timestamp") < 12
        incremental.refresh(name, av.filter(early), path, "batch-0")
        for _ in range(2):
            incremental.refresh(name, av.filter(~early), path, "batch-1")
        return incremental.read(name, spark, path)

    return run


def _rollup(av):
    return rollups.daily_rollup_history(av)


def _weekly(av):
    return rollups.weekly_rollup_history(av)


def _alerts(av):
    return rollups.quota_alerts(av, AS_OF, **ALERTS)


def build_report(spark, sf_dir):
    root = tables.work_dir(spark, "built")
    report = build.build_all(spark, adapter.base(spark, sf_dir), AS_OF, table_root=root)
    return report.join(build.catalog_check(spark), ["name", "kind"])


def catalog_check(spark, sf_dir):
    build.build_all(spark, adapter.base(spark, sf_dir), AS_OF, table_root=tables.work_dir(spark, "built"))
    return build.catalog_check(spark)


def privacy_reverse_lookup(av):
    wanted = av.sparkSession.createDataFrame([(EMAIL,)], "email string").select(
        privacy.pseudonym(F.col("email")).alias(USER_PSEUDONYM)
    )
    return privacy.reverse_lookup(av, wanted)


def privacy_export(spark, sf_dir):
    path = tables.work_dir(spark, "export")
    privacy.export(adapter.raw(spark, sf_dir), EMAIL, path, adapter.base(spark, sf_dir))
    return spark.read.schema("insertId string, severity string").json(path)


def redacted_view(raw):
    view = base_view.analytics_view(raw, pseudonymize=True, hash_installation=True, redact_payload=True)
    return view.select("insertId", USER_PSEUDONYM, "installation_id_hash", "event_name", *base_view.BLOBS)


def reconciliation(spark, sf_dir):
    return checks.reconciliation(adapter.messages(spark, sf_dir), adapter.raw(spark, sf_dir), adapter.PROJECT)


def event_number() -> Column:
    """The event that a stored row came from, by its id."""
    return F.regexp_extract("insertId", r"(\d+)$", 1).cast("bigint")


def with_faults(raw: DataFrame) -> DataFrame:
    """Raw rows with what the checks look for: cut-off labels, lost times and log names, inference events, and the payload
    keys and blobs that ordinary events leave out."""
    number = event_number()
    inference = F.replace("jsonPayload_json", F.lit('"event.name":"gemini_cli.'), F.lit('"event.name":"gen_ai.client.inference.'))
    keys = ("event.domain", "event.timestamp", "model_name", "auth_type", "prompt_id", "gen_ai.request.model")
    more = ",".join(f'"{key}":"x"' for key in keys)
    filled = F.concat(F.lit(f"{{{more},"), F.substring("jsonPayload_json", F.lit(2), F.length("jsonPayload_json")))
    return raw.withColumns({
        "labels_json": F.when(number % 17 == 0, F.substring("labels_json", 1, 5)).otherwise(F.col("labels_json")),
        "timestamp": F.when(number % 19 != 0, F.col("timestamp")),
        "logName": F.when(number % 23 != 0, F.col("logName")),
        "httpRequest_json": F.when(number % 29 == 0, F.lit('{"requestMethod":"GET"}')),
        "spanId": F.when(number % 29 == 0, F.lit("span")),
        "jsonPayload_json": F.when(number % 31 == 0, inference).when(number % 3 == 0, filled).otherwise(F.col("jsonPayload_json")),
    })


def faulty(function: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: function(with_faults(adapter.raw(spark, sf_dir)))


def batch_reconciliation(spark, sf_dir):
    """Three batches with redeliveries across them, balanced from the ledger before and after their days are compacted."""

    def fill(root: str) -> None:
        for k, rows in enumerate(adapter.deliveries(spark, sf_dir, 3)):
            tables.ingest_batch(rows, root, adapter.PROJECT, f"batch-{k}", AS_OF, only_new=True)

    def balanced(root: str, compacted: bool) -> DataFrame:
        found = checks.batch_reconciliation(
            tables.read_fates(spark, root), tables.read_stored(spark, root), tables.read_dead_letters(spark, root)
        )
        counts = ("messages", "dead_letters", "other_logs", "diagnostics", "routed", "loaded", "stored")
        return found.agg(
            F.count("*").alias("batches"),
            *[F.sum(name).alias(name) for name in counts],
            F.sum(F.col("duplicates") + F.col("redelivered")).alias("repeats"),
            F.every("balanced").alias("balanced"),
            F.lit(compacted).alias("compacted"),
        )

    def compacted(root: str) -> None:
        fill(root)
        balanced(root, compacted=False).write.parquet(f"{root}/before")
        tables.repair_days(spark, root, tables.stored_days(tables.read_raw(spark, root)))

    root = adapter.prepared(spark, sf_dir, "fates", compacted)
    after = balanced(root, compacted=True)
    return spark.read.schema(after.schema).parquet(f"{root}/before").unionByName(after)


def missing_ids(spark, sf_dir):
    """Ids that a table lost."""
    raw = adapter.raw(spark, sf_dir).filter(event_number() % 37 != 0)
    return checks.missing_ids(adapter.messages(spark, sf_dir), raw, adapter.PROJECT)


def audit_errors(spark, sf_dir):
    return checks.audit_errors(adapter.audit_messages(spark, sf_dir), "2024-01-15 00:00:00")


def dead_letter_rate(spark, sf_dir):
    dead = tables.read_dead_letters(spark, adapter.store(spark, sf_dir))
    return checks.dead_letter_rate(adapter.raw(spark, sf_dir), dead)


def stream_root(spark, sf_dir):
    def run(root: str) -> None:
        from tallybeam.sources.envelopes import stream_envelopes

        # Several micro-batches, so that most minutes get events from more than one.
        stream = stream_envelopes(spark, adapter.messages_path(spark, sf_dir), max_files_per_trigger=3)
        query = stream_ingest.start_ingest(stream, root, f"{root}/checkpoint", adapter.PROJECT, every=None, alert_limit=0)
        query.awaitTermination()

    return adapter.prepared(spark, sf_dir, "stream", run)


def stream_exactly_once(spark, sf_dir):
    """What a stream stores that is cut off once at each step of its commits and started again every time."""

    def run(root: str) -> None:
        from tallybeam.sources import commits
        from tallybeam.sources.envelopes import stream_envelopes

        seen: set[tuple[str, int]] = set()
        calls: dict[str, int] = {}

        def cut(step: str) -> None:
            calls[step] = calls.get(step, 0) + 1
            place = step, min(calls[step], 2)
            if place not in seen:
                seen.add(place)
                raise InterruptedError(f"cut off at {step}")

        untouched, commits.reached = commits.reached, cut
        try:
            for _ in range(20):
                calls.clear()
                stream = stream_envelopes(spark, adapter.messages_path(spark, sf_dir), max_files_per_trigger=5)
                try:
                    stream_ingest.start_ingest(stream, root, f"{root}/checkpoint", adapter.PROJECT, every=None).awaitTermination()
                    break
                except StreamingQueryException as failure:
                    if "cut off at" not in str(failure):
                        raise
        finally:
            commits.reached = untouched

    root = adapter.prepared(spark, sf_dir, "cut-off", run)
    return _raw_shape(tables.read_raw(spark, root))


def streamed_rows(spark, sf_dir):
    return _raw_shape(tables.read_raw(spark, stream_root(spark, sf_dir)))


def late_data_days(spark, sf_dir):
    """Rows per event day, and how many of them were received on a later day."""
    raw = tables.read_raw(spark, stream_root(spark, sf_dir))
    return raw.groupBy("day").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.to_date("receiveTimestamp") > F.col("day")).alias("received_later"),
    )


def stream_quota_alerts(spark, sf_dir):
    """Minutes over the limit as the micro-batches reported them, and how often each was raised."""
    root = stream_root(spark, sf_dir)
    reports = stream_alerts.read_reports(spark, root)
    raised = reports.groupBy(*stream_alerts.KEY).agg(F.count_if(F.col("kind") == stream_alerts.RAISED).alias("times_raised"))
    found = stream_alerts.read_alerts(spark, root)
    names = {name: f"of_{name}" for name in stream_alerts.KEY}
    same = functools.reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(of)) for name, of in names.items()])
    return found.join(raised.withColumnsRenamed(names), same).select(*found.columns, "times_raised")


def stream_quota_minute(spark, sf_dir):
    """Counts that the micro-batches stored, added up."""
    return quota.read_quota_minutes(spark, tables.minutes_path(stream_root(spark, sf_dir)))


# Views that take a user column are registered in both user modes.
USER_VIEWS = {
    "daily_metrics": views.daily_metrics,
    "user_activity": views.user_activity,
    "token_usage": views.token_usage,
    "error_analysis": views.error_analysis,
    "malformed_json_responses": views.malformed_json_responses,
    "feature_adoption": views.feature_adoption,
    "conversation_analysis": views.conversation_analysis,
    "quota_tracking": views.quota_tracking,
    "user_configuration": views.user_configuration,
    "error_429_sample": error_429_sample,
    "error_429_prompt": error_summary.error_429_prompt,
    "error_429_summary": error_summary.error_429_summary,
    "quota_alerts": functools.partial(rollups.quota_alerts, as_of=AS_OF, **ALERTS),
    "weekly_rollup": functools.partial(rollups.weekly_rollup, as_of=AS_OF),
    "daily_rollup": functools.partial(rollups.daily_rollup, as_of=AS_OF),
}

DASHBOARDS = {
    "q_daily_metrics_30d": dashboards.daily_metrics_30d,
    "q_top_users": dashboards.top_users,
    "q_tokens_by_day_model": dashboards.tokens_by_day_model,
    "q_top_errors": dashboards.top_errors,
    "q_malformed_trend": dashboards.malformed_trend,
    "q_features_by_version": dashboards.features_by_version,
    "q_conversations": dashboards.conversations_30d,
    "q_tool_rollup": dashboards.tool_rollup,
    "q_retry_success": dashboards.retry_success,
    "q_routing": dashboards.routing,
    "q_latest_configs": dashboards.latest_configs,
    "q_request_volume": dashboards.request_volume,
    "q_active_users": dashboards.active_users,
    "q_error_rate": dashboards.error_rate,
    "q_tokens_by_model": dashboards.tokens_by_model,
    "q_token_trend_long": dashboards.token_trend_long,
    "q_top_errors_sum": dashboards.top_errors_sum,
    "q_tool_success_pct": dashboards.tool_success_pct,
    "q_429_by_day": dashboards.rate_limits_by_day,
    "q_429_by_hour": dashboards.rate_limits_by_hour,
    "q_429_by_user_model": dashboards.rate_limits_by_user_model,
}


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "ingest_raw_logs": ingest_raw_logs,
        "route_filter": route_filter,
        "exclude_diagnostic": exclude_diagnostic,
        "dead_letter": dead_letter,
        "dedup_insert_id": dedup_insert_id,
        "raw_partition_counts": over_raw(raw_partition_counts),
        "raw_schema_doc": over_raw(raw_schema_doc),
        "retention_keep": over_raw(retention_keep),
        "analytics_view": over_raw(analytics_view),
        "analytics_view_pseudonym": over_raw(analytics_view, pseudonymize=True),
        "parsed_json_fields": over_raw(parsed_json_fields),
        "json_scalar": over_raw(json_scalars),
        "recent_api_responses": over_base(base_view.recent_events, config.API_RESPONSE, AS_OF),
        "resource_last_day": over_raw(base_view.recent_resources, AS_OF),
        "tool_performance": over_base(views.tool_performance),
        "cli_resilience": over_base(views.cli_resilience),
        "model_routing_analysis": over_base(views.model_routing_analysis),
        "stored_daily_rollup": stored_daily_rollup,
        "rollup_rerun_emptied": rollup_rerun_emptied,
        "alerts_rerun_emptied": alerts_rerun_emptied,
        "incremental_rerun_emptied": incremental_rerun_emptied,
        "build_tables_history": build_tables_history,
        "chained_refresh": chained_refresh,
        "compacted_day_counts": compacted_day_counts,
        "base_after_repair": base_after_repair,
        "batch_after_compaction": batch_after_compaction,
        "ingest_only_new": ingest_only_new,
        "privacy_access_behind": privacy_access_behind,
        "privacy_export_behind": privacy_export_behind,
        "tier_after_erasure": tier_after_erasure,
        "daily_rollup_incremental": daily_rollup_incremental,
        "weekly_rollup_incremental": weekly_rollup_incremental,
        "privacy_erasure_stored": privacy_erasure_stored,
        "retention_raw": retention_raw,
        "retention_daily": retention_daily,
        "retention_weekly": retention_weekly,
        "retention_alerts": retention_alerts,
        "build_report": build_report,
        "q_near_limit": over_base(dashboards.near_limit, TODAY, above=0),
        "q_rollup_90d": lambda s, d: dashboards.rollup_90d(_rollup(adapter.base(s, d)), AS_OF),
        "q_recent_alerts": lambda s, d: dashboards.recent_alerts(_alerts(adapter.base(s, d)), AS_OF),
        "q_weekly_error_rate": lambda s, d: dashboards.weekly_error_rate(_weekly(adapter.base(s, d))),
        "q_rpm_last_hour": over_base(dashboards.rpm_last_hour, TODAY),
        "q_429_days": over_base(dashboards.rate_limited_days, AS_OF, days=30),
        "q_429_scorecards": over_base(dashboards.rate_limit_scorecards, TODAY),
        "q_rpm_alert_rule": over_base(dashboards.rpm_alert_rule, TODAY, above=0, critical=0, hold_minutes=1),
        "q_threshold_alerts": over_base(
            dashboards.threshold_alerts, AS_OF, days=30, rpm=(0, 1), rpd=(2, 4), malformed_limit=10
        ),
        "p_requests_today": over_base(panels.requests_on_day, TODAY),
        "p_users_by_model": over_base(panels.users_by_model, AS_OF),
        "p_token_trend": over_base(panels.token_trend, AS_OF),
        "p_top_token_users": over_base(panels.top_token_users),
        "p_session_hist": over_base(panels.session_histogram),
        "p_token_share": over_base(panels.token_share, AS_OF),
        "p_token_budget": over_base(panels.token_budget, AS_OF, daily_budget=60000),
        "p_cached_rate": over_base(panels.cached_rate, AS_OF),
        "p_error_heatmap": over_base(panels.error_heatmap, AS_OF),
        "p_top10_errors": over_base(panels.top10_errors, AS_OF),
        "p_error_rate_trend": over_base(panels.error_rate_trend, AS_OF),
        "p_malformed_totals": over_base(panels.malformed_totals, AS_OF),
        "p_slash_growth": over_base(panels.slash_growth, AS_OF),
        "p_agent_adoption": over_base(panels.agent_adoption, AS_OF),
        "p_feature_share": over_base(panels.feature_share, AS_OF),
        "p_turn_hist": over_base(panels.turn_histogram),
        "p_conv_by_mode": over_base(panels.conversations_by_mode),
        "p_conv_volume": over_base(panels.conversation_volume),
        "p_tool_success": over_base(panels.tool_success, AS_OF),
        "p_top_tools": over_base(panels.top_tools, AS_OF),
        "p_tool_failure_trend": over_base(panels.tool_failure_trend, AS_OF),
        "p_resilience_totals": over_base(panels.resilience_totals, AS_OF),
        "p_routing_totals": over_base(panels.routing_totals, AS_OF),
        "p_quota_headroom": over_base(panels.quota_headroom, AS_OF, rpm_limit=2, rpd_limit=5),
        "p_sandbox_share": over_base(panels.sandbox_share),
        "p_prompt_logging_share": over_base(panels.prompt_logging_share),
        "p_extensions_by_user": over_base(panels.extensions_by_user),
        "p_rollup_totals": lambda s, d: panels.rollup_totals(_rollup(adapter.base(s, d)), AS_OF),
        "p_alerts_24h": lambda s, d: panels.alerts_24h(_alerts(adapter.base(s, d)), AS_OF),
        "p_top_violators": lambda s, d: panels.top_violators(_alerts(adapter.base(s, d))),
        "p_week_over_week": lambda s, d: panels.week_over_week(_weekly(adapter.base(s, d))),
        "privacy_lookup": over_base(privacy.lookup, EMAIL, pseudonymize=True),
        "privacy_usage_by_day": over_base(privacy.usage_by_day, EMAIL, pseudonymize=True),
        "privacy_reverse_lookup": over_base(privacy_reverse_lookup),
        "privacy_access": lambda s, d: _raw_shape(privacy.access(adapter.raw(s, d), EMAIL, adapter.base(s, d))),
        "privacy_erasure_preview": over_raw(privacy.erasure_preview, EMAIL),
        "privacy_erasure_after": over_raw(lambda raw: raw_partition_counts(privacy.without_user(raw, EMAIL))),
        "privacy_export": privacy_export,
        "privacy_active_users": over_base(privacy.active_pseudonyms, AS_OF, pseudonymize=True),
        "privacy_top_tokens": over_base(privacy.top_token_users, AS_OF, pseudonymize=True),
        "anomaly_zscore": over_base(privacy.anomalies, AS_OF, pseudonymize=True, days=30, sigma=2.0),
        "k_anonymous_stats": over_base(privacy.k_anonymous_stats, pseudonymize=True),
        "redacted_view": over_raw(redacted_view),
        "m_freshness": over_raw(checks.freshness, "2024-01-30 12:00:00"),
        "m_timestamp_match": over_raw(checks.timestamp_match, "2024-01-15 12:00:00", minutes=30),
        "m_json_validity": faulty(checks.json_validity),
        "m_extraction_coverage": faulty(lambda raw: checks.extraction_coverage(base_view.analytics_view(raw))),
        "m_reconciliation": reconciliation,
        "m_batch_reconciliation": batch_reconciliation,
        "m_missing_ids": missing_ids,
        "m_structure": faulty(checks.structure),
        "m_latest_log": over_raw(checks.latest_log, "2024-01-30 23:59:00", minutes=1440),
        "m_inference_flags": faulty(checks.inference_flags),
        "m_audit_errors": audit_errors,
        "m_ingest_lag": over_raw(checks.ingest_lag, limit_seconds=60),
        "m_ingest_lag_sketched": ingest_lag_sketched,
        "m_dead_letter_rate": dead_letter_rate,
        "m_catalog_check": catalog_check,
        "stream_ingest": streamed_rows,
        "stream_exactly_once": stream_exactly_once,
        "stream_quota_minute": stream_quota_minute,
        "stream_quota_alerts": stream_quota_alerts,
        "late_data_days": late_data_days,
    }
    for name, function in USER_VIEWS.items():
        found[name] = over_base(function)
        found[f"{name}_pseudonym"] = over_base(function, user_col=USER_PSEUDONYM, pseudonymize=True)
    for name, function in DASHBOARDS.items():
        found[name] = over_base(function, AS_OF)
    for name in incremental.ROLLUPS:
        found[f"{name}_incremental"] = incremental_view(name)
    return {name: _query(function) for name, function in found.items()}
