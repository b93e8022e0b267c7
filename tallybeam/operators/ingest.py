"""Log envelopes to raw rows: strict parse, routing, dead letters, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybeam import config
from tallybeam.functions.jsonx import json_quote, strict_object, text_struct, variant_kind

PLAIN_FIELDS = ("timestamp", "receiveTimestamp", "logName", "insertId", "severity", "trace", "spanId")
BLOB_FIELDS = ("resource", "labels", "operation", "httpRequest", "jsonPayload")

# Column order of the raw table is part of the format.
RAW_COLUMNS = (
    "timestamp", "receiveTimestamp", "logName", "insertId", "severity",
    "resource_json", "labels_json", "operation_json", "httpRequest_json", "jsonPayload_json",
    "trace", "spanId",
)

ROUTED, OTHER_LOG, DIAGNOSTIC, DEAD_LETTER = "routed", "other_log", "diagnostic", "dead_letter"

_FIELDS = text_struct(PLAIN_FIELDS + BLOB_FIELDS)
_KINDS = T.StructType([T.StructField(b, text_struct(["_"])) for b in BLOB_FIELDS])


def parse_messages(messages: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Parse every message once; ``envelope`` is NULL for a message that is not one JSON object.

    ``row_id`` identifies a message without an ``insertId``. Being non-deterministic and part of
    the parsing step, it also keeps Spark from pushing later filters below the parse, which would
    parse every message twice.
    """
    row_id = F.monotonically_increasing_id().cast("string") if row_id is None else row_id
    items, probe = strict_object(F.col("value"), _FIELDS, _KINDS)
    strict = (F.size("_items") == 1) & F.col("_items")[0].isNotNull() & (F.col("_probe.z") == 1)
    scalar = (F.col("_probe.z") == 1) & ~F.ltrim("value").startswith("{")
    return (
        messages.withColumns({"_items": items, "_probe": probe, "row_id": row_id})
        .withColumn("envelope", F.when(strict, F.col("_items")[0]))
        .withColumn("kinds", F.col("_probe.m"))
        .withColumn(
            "reason",
            F.when(F.col("envelope").isNotNull(), F.lit(None).cast("string"))
            .when(scalar, "not_an_object")
            .otherwise("malformed_json"),
        )
        .drop("_items", "_probe")
    )


def is_routed(log_name: Column, project: str) -> Column:
    return F.coalesce(log_name == config.log_name(project), F.lit(False))


def has_diagnostic(payload_json: Column) -> Column:
    """Presence of the diagnostic key; the text search spares most rows the key listing."""
    listed = F.array_contains(F.json_object_keys(payload_json), config.DIAGNOSTIC_KEY)
    return F.coalesce(payload_json.contains(config.DIAGNOSTIC_KEY) & listed, F.lit(False))


def classify(messages: DataFrame, project: str, row_id: Column | None = None) -> DataFrame:
    """Add ``outcome``: routed, other_log, diagnostic or dead_letter."""
    envelope = F.col("envelope")
    return parse_messages(messages, row_id).withColumn(
        "outcome",
        F.when(envelope.isNull(), DEAD_LETTER)
        .when(~is_routed(envelope.logName, project), OTHER_LOG)
        .when(has_diagnostic(envelope.jsonPayload), DIAGNOSTIC)
        .otherwise(ROUTED),
    )


def with_outcome(classified: DataFrame, *outcomes: str) -> DataFrame:
    """Messages with one of the outcomes.

    Naming ``row_id``, which is never empty, keeps it in the parsing step and so this filter above
    the parse; without it Spark would evaluate the parse inside the filter as well.
    """
    return classified.filter((F.col("row_id") != "") & F.col("outcome").isin(*outcomes))


def _blob(name: str) -> Column:
    """JSON text of a nested field; NULL where the value is absent, null, false, zero or "".

    Almost every value is an object, which the shape parse has already established. Only other
    values need their JSON type, because text read from a string has lost its quotes.
    """
    text = F.col("envelope")[name]
    kind = variant_kind(F.col("value"), f"$.{name}")
    falsy = (text == "false") | (text.try_cast("double") == 0)
    return (
        F.when(F.col("kinds")[name].isNotNull(), text)
        .when(text.isNull() | (text == ""), F.lit(None).cast("string"))
        .when(kind == "STRING", json_quote(text))
        .when(~F.coalesce(falsy, F.lit(False)), text)
    )


def to_raw(classified: DataFrame) -> DataFrame:
    """The twelve raw columns of the parsed messages, plus the columns that steer them."""
    plain = {name: F.col("envelope")[name] for name in PLAIN_FIELDS}
    plain["timestamp"] = plain["timestamp"].try_cast("timestamp")
    plain["receiveTimestamp"] = plain["receiveTimestamp"].try_cast("timestamp")
    blobs = {f"{name}_json": _blob(name) for name in BLOB_FIELDS}
    columns = plain | blobs
    return classified.select(
        "outcome", "reason",
        # The text of a message is needed for dead letters only; others would carry it through every exchange.
        F.when(F.col("outcome") == DEAD_LETTER, F.col("value")).alias("value"),
        F.xxhash64("value").alias("tie"),
        "row_id", *[columns[name].alias(name) for name in RAW_COLUMNS],
    )


def dedup_key() -> Column:
    """A key per message: rows without an ``insertId`` never match each other."""
    return F.coalesce(F.concat(F.lit("id:"), "insertId"), F.concat(F.lit("row:"), "row_id"))


# What messages are grouped by. The hash goes first, because rows are sorted by their group: keys begin alike and would be
# compared as whole strings, while hashes differ in the first eight bytes, which Spark compares without looking at the row.
GROUP = ("_hash", "_key")


def with_group(rows: DataFrame, key: Column) -> DataFrame:
    return rows.withColumn("_key", key).withColumn("_hash", F.xxhash64("_key"))


def first_copies(rows: DataFrame) -> DataFrame:
    """As :func:`deduplicate`, still with the columns of ``GROUP``, by which the rows are partitioned and sorted."""
    w = Window.partitionBy(*GROUP).orderBy(F.col("receiveTimestamp").asc_nulls_last(), "tie")
    ranked = with_group(rows, dedup_key()).withColumn("_rank", F.row_number().over(w))
    return ranked.filter(F.col("_rank") == 1).drop("tie", "_rank", "row_id")


def deduplicate(rows: DataFrame) -> DataFrame:
    """Keep the earliest-received copy of each ``insertId``; rows without an id all stay.

    The row-number filter becomes a per-partition limit ahead of the shuffle, so an id that is
    redelivered millions of times sends one row per map task. Rows without an id get a key each
    and spread evenly. Ties are broken by ``tie``, a hash of the message.
    """
    return first_copies(rows).drop(*GROUP)


def deduplicate_counted(rows: DataFrame) -> DataFrame:
    """As :func:`deduplicate`, for the messages of every outcome, with ``copies``: how many messages a row stands for.

    Messages that are not stored become one row for each task and outcome, without their text. The counts are part of the
    rows, not metrics of a run, so tasks that are repeated after a loss count nothing twice. Partial aggregates run before
    the exchange, so a hot id sends one row per map task.
    """
    stored = F.col("outcome").isin(ROUTED, DEAD_LETTER)
    kept = [c for c in rows.columns if c not in ("outcome", "tie", "row_id")]
    received = F.col("receiveTimestamp")
    row = F.struct(received.isNull().alias("last"), received.alias("received"), "tie", F.struct(*kept).alias("row"))
    uncounted = F.concat(F.lit("task:"), F.spark_partition_id().cast("string"))
    keyed = rows.select("outcome", F.when(stored, dedup_key()).otherwise(uncounted).alias("_key"), F.when(stored, row).alias("_row"))
    grouped = with_group(keyed, F.col("_key")).groupBy(*GROUP, "outcome")
    first = grouped.agg(F.min("_row").alias("_row"), F.count("*").alias("copies"))
    return first.select("outcome", "_row.row.*", "copies")


def raw_rows(messages: DataFrame, project: str) -> DataFrame:
    """Batch path from messages to de-duplicated raw rows."""
    routed = with_outcome(to_raw(classify(messages, project)), ROUTED)
    return deduplicate(routed).select(*RAW_COLUMNS)


def dead_letters(messages: DataFrame) -> DataFrame:
    """Messages that are not exactly one JSON object, with the reason."""
    rejected = (F.col("row_id") != "") & F.col("envelope").isNull()
    return parse_messages(messages).filter(rejected).select("value", "reason")


def only_new(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop rows whose message is already stored (a redelivery in a later batch).

    A redelivered message carries its event time, so day and id must be the same; pass ``existing``
    filtered to the days at hand. Rows without an id never match. Rows of :func:`first_copies` are joined by the columns they
    were grouped by, so that they are neither exchanged nor sorted once more; ids and days of ``existing`` are.
    """
    of_id = F.concat(F.lit("id:"), "insertId")
    ids = existing.select("day", "insertId").filter(F.col("insertId").isNotNull())
    known = with_group(ids, of_id).groupBy(*GROUP).agg(F.collect_set("day").alias("_days"))
    grouped = rows if set(GROUP) <= set(rows.columns) else with_group(rows, of_id)
    stored = F.coalesce(F.array_contains("_days", F.col("day")), F.lit(False))
    return grouped.join(known, list(GROUP), "left").filter(~stored).select(*[c for c in rows.columns if c not in GROUP])
