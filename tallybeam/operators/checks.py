"""Data-flow checks over whole tables: freshness, validity, coverage, reconciliation, lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.functions.jsonx import STRICT_OPTIONS, text_struct
from tallybeam.functions.measures import ratio
from tallybeam.functions.timex import AsOf, event_day, moment_before, time_range, ts_lit
from tallybeam.operators import ingest
from tallybeam.operators.base_view import BLOBS, PAYLOAD_COLUMNS


def freshness(raw: DataFrame, as_of: AsOf) -> DataFrame:
    """Rows newer than 15 and than 10 minutes."""
    return time_range(raw, moment_before(as_of, minutes=15)).agg(
        F.count("*").alias("rows_15_min"),
        F.count_if(F.col("timestamp") >= ts_lit(as_of, minutes=10)).alias("rows_10_min"),
    )


def timestamp_match(raw: DataFrame, moment: AsOf, minutes: int = 2) -> DataFrame:
    """Rows within some minutes of a known log time."""
    rows = time_range(raw, moment_before(moment, minutes=minutes), moment_before(moment, minutes=-minutes))
    return rows.agg(F.count("*").alias("matched_rows"))


def json_validity(raw: DataFrame) -> DataFrame:
    """Per blob column: rows with text, rows whose text parses, rows whose text does not."""
    counts = raw.agg(
        *[F.count(blob).alias(blob) for blob in BLOBS],
        *[F.count(F.try_parse_json(blob)).alias(f"{blob}_ok") for blob in BLOBS],
    )
    per_column = F.array(*[
        F.struct(
            F.lit(blob).alias("column_name"),
            F.col(blob).alias("present"),
            F.col(f"{blob}_ok").alias("valid"),
            (F.col(blob) - F.col(f"{blob}_ok")).alias("invalid"),
        )
        for blob in BLOBS
    ])
    return counts.select(F.inline(per_column))


def extraction_coverage(av: DataFrame, user_col: str = config.USER_EMAIL) -> DataFrame:
    """Share of rows in which each extracted column is filled."""
    extracted = [name for name, _, _ in PAYLOAD_COLUMNS] + ["resource_project_id", user_col, "cli_version"]
    counts = av.agg(F.count("*").alias("_rows"), *[F.count(name).alias(name) for name in extracted])
    per_column = F.array(*[
        F.struct(F.lit(name).alias("column_name"), F.col(name).alias("filled"), F.col("_rows").alias("total_rows"))
        for name in extracted
    ])
    return counts.select(F.inline(per_column)).withColumn("share", ratio(F.col("filled"), F.col("total_rows")))


def reconciliation(messages: DataFrame, raw: DataFrame, project: str) -> DataFrame:
    """Messages by fate against the rows loaded; ``balanced`` says that the sums agree.

    One pass over the messages: partial counts are kept per outcome and id, then added up. Rows
    without an id are never duplicates.
    """
    classified = ingest.classify(messages, project)
    insert_id = F.when(F.col("outcome") == ingest.ROUTED, F.col("envelope.insertId"))
    fates = (
        classified.select("outcome", insert_id.alias("insert_id"))
        .groupBy("outcome", "insert_id")
        .agg(F.count("*").alias("n"))
        .agg(
            F.sum("n").alias("messages"),
            *[_fate(outcome).alias(name) for outcome, name in (
                (ingest.DEAD_LETTER, "dead_letters"),
                (ingest.OTHER_LOG, "other_logs"),
                (ingest.DIAGNOSTIC, "diagnostics"),
                (ingest.ROUTED, "routed"),
            )],
            F.coalesce(F.sum(F.when(F.col("insert_id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        )
    )
    loaded = raw.agg(F.count("*")).scalar()
    dropped = F.col("dead_letters") + F.col("other_logs") + F.col("diagnostics")
    return fates.withColumn("loaded", loaded).withColumn(
        "balanced",
        (F.col("messages") == dropped + F.col("routed")) & (F.col("routed") == F.col("duplicates") + F.col("loaded")),
    )


def _fate(outcome: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("n"))), F.lit(0))


def batch_reconciliation(fates: DataFrame, stored: DataFrame, dead: DataFrame) -> DataFrame:
    """Per batch: its fates as counted at ingest against what the table holds of it now. No message is read again.

    ``fates``, ``stored`` and ``dead`` come from ``tables.read_fates``, ``read_stored`` and ``read_dead_letters``. A row of a
    compacted day counts for every batch that brought it. Erasure and retention take rows, so their batches don't balance.
    """
    brought = F.explode(F.coalesce("_origins", F.array("batch"))).alias("batch")
    rows = stored.select(brought).groupBy("batch").agg(F.count("*").alias("stored"))
    rejected = dead.groupBy("batch").agg(F.count("*").alias("stored_dead_letters"))
    joined = fates.join(rows, "batch", "left").join(rejected, "batch", "left").fillna(0, ["stored", "stored_dead_letters"])
    dropped = F.col("dead_letters") + F.col("other_logs") + F.col("diagnostics")
    return joined.withColumn(
        "balanced",
        (F.col("messages") == dropped + F.col("routed"))
        & (F.col("routed") == F.col("duplicates") + F.col("redelivered") + F.col("loaded"))
        & (F.col("stored") == F.col("loaded"))
        & (F.col("stored_dead_letters") == F.col("dead_letters")),
    )


def missing_ids(messages: DataFrame, raw: DataFrame, project: str) -> DataFrame:
    """Ids that were routed but are not in the table, looked for on the days of the messages.

    First and last day are taken beforehand, so that the partitions of other days are not read.
    """
    routed = ingest.with_outcome(ingest.classify(messages, project), ingest.ROUTED)
    moment = F.to_date(F.col("envelope.timestamp").try_cast("timestamp"))
    ids = routed.select(moment.alias("day"), F.col("envelope.insertId").alias("insertId")).filter("insertId is not null")
    first, last = ids.agg(F.min("day"), F.max("day")).first()
    day = event_day(raw)
    stored = raw.filter(day.between(F.lit(first), F.lit(last)) | day.isNull()).select(day.alias("day"), "insertId")
    same = ids["day"].eqNullSafe(stored["day"]) & (ids["insertId"] == stored["insertId"])
    return ids.join(stored, same, "left_anti").select("insertId").distinct()


def structure(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("timestamp").isNotNull() & F.col("logName").isNotNull()).alias("well_formed"),
        F.count_if(F.col("timestamp").isNull()).alias("without_timestamp"),
        F.count_if(F.col("logName").isNull()).alias("without_log_name"),
    )


def latest_log(raw: DataFrame, as_of: AsOf, minutes: int = 10) -> DataFrame:
    """Newest log time and number of rows in the lookback."""
    rows = time_range(raw, moment_before(as_of, minutes=minutes))
    return rows.agg(F.max("timestamp").alias("latest_timestamp"), F.count("*").alias("log_count"))


def newest_logs(raw: DataFrame, as_of: AsOf, minutes: int = 10, limit: int = 100) -> DataFrame:
    """The newest rows of the lookback; the list is defined on ``limit`` rows."""
    rows = time_range(raw, moment_before(as_of, minutes=minutes)).select("timestamp", "severity", "insertId")
    return rows.orderBy(F.col("timestamp").desc(), F.col("insertId").desc()).limit(limit)


def inference_flags(raw: DataFrame) -> DataFrame:
    """Rows that report model inference and rows whose output holds a tool call.

    Output messages may be text or nested JSON; both are searched as text.
    """
    keys = text_struct(["event.name", "gen_ai.output.messages"])
    rows = raw.select(F.from_json("jsonPayload_json", keys, STRICT_OPTIONS).alias("payload"))
    event, output = F.col("payload").getField("event.name"), F.col("payload").getField("gen_ai.output.messages")
    return rows.agg(
        F.count("*").alias("log_count"),
        F.count_if(event.contains(config.INFERENCE_MARKER)).alias("inference_logs"),
        F.count_if(F.lower(output).contains(config.TOOL_CALL_MARKER)).alias("tool_call_logs"),
    )


AUDIT_ENTRY = (
    "timestamp string, logName string, "
    "protoPayload struct<serviceName: string, methodName: string, status: struct<code: bigint>>"
)


def audit_errors(messages: DataFrame, since: AsOf) -> DataFrame:
    """Failed sink changes in audit-log messages, counted by method."""
    entry = F.from_json("value", AUDIT_ENTRY, STRICT_OPTIONS)
    method = F.col("entry.protoPayload.methodName")
    return (
        messages.select(entry.alias("entry"))
        .filter(
            F.col("entry.logName").contains(config.AUDIT_LOG)
            & (F.col("entry.protoPayload.serviceName") == config.AUDIT_SERVICE)
            & (method.contains(config.AUDIT_METHODS[0]) | method.contains(config.AUDIT_METHODS[1]))
            & (F.col("entry.timestamp").try_cast("timestamp") >= ts_lit(since))
            & (F.coalesce("entry.protoPayload.status.code", F.lit(0)) != 0)
        )
        .groupBy(method.alias("method_name"))
        .agg(F.count("*").alias("error_count"))
    )


def _lag_seconds() -> Column:
    return (F.unix_micros("receiveTimestamp") - F.unix_micros("timestamp")) / 1e6


def lag_partial(rows: DataFrame, *keys: str, limit_seconds: int = config.LAG_LIMIT_SECONDS) -> DataFrame:
    """Mergeable lag figures by day and ``keys``: number, sum, maximum, rows over the limit and a quantile sketch.

    A sketch with ``LAG_SKETCH_SIZE`` items tells a rank within 0.7 % of the rows, however many partials are merged.
    """
    lags = rows.select(event_day(rows).alias("day"), *keys, _lag_seconds().alias("lag")).filter("lag is not null")
    return lags.groupBy("day", *keys).agg(
        F.count("lag").alias("lag_n"),
        F.sum("lag").alias("lag_sum"),
        F.max("lag").alias("lag_max"),
        F.count_if(F.col("lag") > limit_seconds).alias("over_limit"),
        F.kll_sketch_agg_double("lag", LAG_SKETCH_SIZE).alias("lags"),
    )


LAG_SKETCH_SIZE = 400
LAG_PARTIALS = "lag_n bigint, lag_sum double, lag_max double, over_limit bigint, lags binary, day date, batch string"


def read_ingest_lag(spark: SparkSession, path: str) -> DataFrame:
    """The lag of every day, merged from the stored partials of all batches; days without any lag have no row."""
    partials = spark.read.schema(LAG_PARTIALS).parquet(path)
    sketch = F.kll_merge_agg_double("lags", LAG_SKETCH_SIZE)
    return partials.groupBy("day").agg(
        ratio(F.sum("lag_sum"), F.sum("lag_n")).alias("mean_lag_s"),
        F.kll_sketch_get_quantile_double(sketch, F.lit(0.95)).alias("p95_lag_s"),
        F.max("lag_max").alias("max_lag_s"),
        F.sum("over_limit").alias("rows_over_limit"),
    )


def ingest_lag(raw: DataFrame, limit_seconds: int = config.LAG_LIMIT_SECONDS) -> DataFrame:
    """Seconds from event to receipt per day: mean, 95th percentile, maximum, rows over the limit."""
    return (
        raw.select(event_day(raw).alias("day"), _lag_seconds().alias("lag"))
        .groupBy("day")
        .agg(
            F.avg("lag").alias("mean_lag_s"),
            F.percentile_approx("lag", 0.95).alias("p95_lag_s"),
            F.max("lag").alias("max_lag_s"),
            F.count_if(F.col("lag") > limit_seconds).alias("rows_over_limit"),
        )
    )


def dead_letter_rate(raw: DataFrame, dead: DataFrame, limit: float = config.DEAD_LETTER_RATE_LIMIT) -> DataFrame:
    loaded = raw.agg(F.count("*")).scalar()
    rejected = dead.agg(F.count("*").alias("dead_letters")).withColumn("loaded", loaded)
    rate = ratio(F.col("dead_letters"), F.col("dead_letters") + F.col("loaded"))
    return rejected.withColumn("rate", rate).withColumn("over_limit", F.coalesce(rate > limit, F.lit(False)))

