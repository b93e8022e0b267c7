"""Tables on shared storage: layout, writers, readers, retention, documentation.

Layout below one root::

    log/tier=raw/day=<event day>/batch=<id>/         raw rows
    log/tier=dead_letter/day=<arrival>/batch=<id>/   rejected messages
    ids/day=<event day>/batch=<id>/                  hashed message ids, see sources.index
    users/day=<event day>/batch=<id>/                pseudonyms that have rows, see sources.index
    merged/day=<event day>/                          names of the batches that the compacted day holds
    fates/batch=<id>/                                how many messages of the batch had which fate
    base/day=<event day>/batch=<id>/                 typed base view
    general/day=<event day>/batch=<id>/              the same for general access, where it is kept (plans.refresh)
    incremental/<view>/day=<event day>/batch=<id>/   mergeable aggregates, see operators.incremental
    quota_minutes/day=<event day>/batch=<id>/        minute counts, see streaming.quota
    minute_alerts/day=<event day>/batch=<id>/        minutes over the limit, see streaming.alerts
    ingest_lag/day=<event day>/batch=<id>/           lag figures with quantile sketches, see operators.checks

A batch owns its folders in all of them: running it again replaces them, on whatever days they are, so nothing of an
earlier run stays, also where the later run has no rows. Log, ids and users of a batch are written aside and put in
place by one commit (``sources.commits``), as are the tables that follow from them (``plans.refresh``).

``COMPACTED`` is the batch of a closed day, into which its batches are merged. Each of its rows knows the batches that
brought it (``ORIGINS``, in the files only), and ``merged`` lists them by day. A batch that is ingested again later takes
its rows out of the compacted days it is in and puts the new ones there.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybeam.config import RETENTION_DAYS, USER_EMAIL
from tallybeam.functions.timex import AsOf, day_before, ts_lit
from tallybeam.operators import ingest
from tallybeam.operators.base_view import analytics_view, parsed_json, stored_columns
from tallybeam.sources import commits, folders, index

COMPACTED = "compacted"
ORIGINS = "_origins"
COPIES = "_copies"
ROWS_PER_FILE = 500_000
BROADCAST_IDS = 2_000_000  # about 200 MB in memory

RAW_DOC = {
    "timestamp": "When the event happened, in UTC; the day partition follows it",
    "receiveTimestamp": "When the message arrived; the earliest copy of a message is kept",
    "logName": "Log that the message was routed from; files are sorted by it",
    "insertId": "Id that redelivered copies share; without it a row is never a copy",
    "severity": "Level as sent, not interpreted",
    "resource_json": "Where it ran, as JSON text; holds the project",
    "labels_json": "Client labels as JSON text; holds the version of the client",
    "operation_json": "Operation that the event belongs to, as JSON text",
    "httpRequest_json": "HTTP details as JSON text, for events that have them",
    "jsonPayload_json": "The event itself as JSON text, keys with dots kept flat; the base view types it",
    "trace": "Trace that the event belongs to, if any",
    "spanId": "Span within that trace, if any",
    "day": "Partition: date of timestamp, empty where that can't be read",
    "batch": "Partition: ingest batch that owns the row",
}

_RAW_TYPES = {"timestamp": T.TimestampType(), "receiveTimestamp": T.TimestampType(), "day": T.DateType()}

RAW_SCHEMA = T.StructType([
    T.StructField(name, _RAW_TYPES.get(name, T.StringType()), True, {"comment": doc})
    for name, doc in RAW_DOC.items()
])

DEAD_SCHEMA = T.StructType([
    T.StructField("value", T.StringType(), True, {"comment": "The message as received"}),
    T.StructField("reason", T.StringType(), True, {"comment": "Why it was rejected"}),
    T.StructField("ingest_ts", T.TimestampType(), True, {"comment": "When it was rejected"}),
    T.StructField("day", T.DateType(), True, {"comment": "Date of ingest_ts"}),
    T.StructField("batch", T.StringType(), True, {"comment": "Ingest batch"}),
])


# What the files hold: rows of a compacted day also have the batches that brought them.
STORED_SCHEMA = T.StructType([*RAW_SCHEMA.fields[:-2], T.StructField(ORIGINS, T.ArrayType(T.StringType())), *RAW_SCHEMA.fields[-2:]])
MERGED_SCHEMA = "batch string, day date"
FATES_SCHEMA = (
    "messages bigint, dead_letters bigint, other_logs bigint, diagnostics bigint, routed bigint, "
    "duplicates bigint, redelivered bigint, loaded bigint, batch string"
)

_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is used only where
    that is unset and Spark runs in one process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        shared = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tallybeam-"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


RAW, DEAD_LETTERS, MERGED, FATES = "log/tier=raw", "log/tier=dead_letter", "merged", "fates"


def raw_path(root: str) -> str:
    return f"{root}/{RAW}"


def dead_letter_path(root: str) -> str:
    return f"{root}/{DEAD_LETTERS}"


def merged_path(root: str) -> str:
    return f"{root}/{MERGED}"


def base_path(root: str) -> str:
    return f"{root}/base"


def general_path(root: str) -> str:
    return f"{root}/general"


def incremental_path(root: str, name: str) -> str:
    return f"{root}/incremental/{name}"


def minutes_path(root: str) -> str:
    return f"{root}/quota_minutes"


def alerts_path(root: str) -> str:
    return f"{root}/minute_alerts"


def lag_path(root: str) -> str:
    return f"{root}/ingest_lag"


def write_folders(rows: DataFrame, path: str, *cluster: str) -> None:
    """Store rows that have a ``day`` and a ``batch``, in files that follow their size."""
    folders.make(rows.sparkSession, path)
    spread = rows.hint("rebalance", "day").sortWithinPartitions("day", "batch", *cluster)
    spread.write.mode("append").partitionBy("day", "batch").parquet(path)


def write_batch(rows: DataFrame, path: str, batch: str, *cluster: str) -> None:
    """Store rows that have a ``day`` as the whole of one batch."""
    spark = rows.sparkSession
    aside = commits.begin(spark, path, batch)
    write_folders(rows.withColumn("batch", F.lit(batch)), aside, *cluster)
    commits.commit(spark, path, batch, commits.replacing(spark, path, aside, "", batch))


def spread_by_size(rows: DataFrame, keys: tuple[str, ...], salt: tuple[str, ...], rows_per_file: int) -> DataFrame:
    """Exchange into as many tasks and files per value of ``keys`` as the largest of them needs.

    For micro-batches, where Spark does not re-plan at run time and ignores the rebalance hint. Counts ``rows`` first, so
    they should be persisted.
    """
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    files = max(1, math.ceil(largest / rows_per_file))
    return rows.repartition(*keys, F.pmod(F.xxhash64(*salt), F.lit(files)))


def write_log(
    classified_rows: DataFrame,
    root: str,
    batch: str,
    arrived: Column,
    rows_per_file: int | None = None,
    only_new: bool = False,
    spark: SparkSession | None = None,
) -> None:
    """Store raw rows and dead letters of one batch, in a single pass over the messages, as one commit.

    ``classified_rows`` comes from ``ingest.to_raw`` (de-duplicated). Rebalancing by day lets
    Spark split a day that holds most rows into many tasks and merge small ones, which a plain
    repartition by day would not; micro-batches give ``rows_per_file`` instead. A batch that is
    repeated replaces its rows, also if it arrives on another day or if its days were compacted since. With ``only_new``
    messages that other batches stored are left out, found in the id index. Rows from ``ingest.deduplicate_counted`` also
    give the fates of the batch, in the same commit (``read_fates``). What follows from the stored rows runs in ``spark``, for
    rows of a stream, whose own session doesn't re-plan.
    """
    spark = spark or classified_rows.sparkSession
    aside = commits.begin(spark, root, batch)
    counted = "copies" in classified_rows.columns
    rejected, routed = F.col("outcome") == ingest.DEAD_LETTER, F.col("outcome") == ingest.ROUTED
    stored = classified_rows if counted else classified_rows.filter(rejected | routed)
    rows = stored.select(
        *ingest.RAW_COLUMNS,
        "value",
        F.when(rejected | routed, F.col("reason")).otherwise(F.col("outcome")).alias("reason"),
        F.when(rejected, arrived).alias("ingest_ts"),
        *([F.col("copies").alias(COPIES)] if counted else []),
        F.when(rejected, "dead_letter").when(routed, "raw").otherwise("not_stored").alias("tier"),
        F.to_date(F.when(rejected, arrived).otherwise(F.col("timestamp"))).alias("day"),
        F.lit(batch).alias("batch"),
    )
    if rows_per_file:
        spread = spread_by_size(rows, ("tier", "day"), ("insertId", "value", "jsonPayload_json"), rows_per_file)
    else:
        spread = rows.hint("rebalance", "tier", "day")
    (
        spread.sortWithinPartitions("tier", "day", "batch", "logName", "severity")
        .write.mode("append")
        .partitionBy("tier", "day", "batch")
        .parquet(f"{aside}/log")
    )
    merged = merged_days(spark, root, batch)
    names = [day_folder(day) for day in merged]
    with ThreadPoolExecutor(1) as beside:  # the count is a short job of its own, beside those of the indexes
        counting = beside.submit(_fates, spark, aside) if counted else None
        if only_new:
            if counting:
                counting.result()
            _drop_known(spark, root, aside, batch, skip=names)
        for path in (raw_path(aside), raw_path(root), dead_letter_path(root)):
            folders.make(spark, path)
        index.write(spark, read_raw(spark, aside), aside, skip=merged)
        fates = counting.result() if counting else None
    moves = [
        move
        for table in (RAW, index.IDS, index.USERS)
        for move in commits.replacing(spark, root, aside, table, batch, frozenset(names))
    ] + commits.replacing(spark, root, aside, DEAD_LETTERS, batch)
    ledger = f"{FATES}/batch={batch}"
    if fates:
        loaded = read_raw(spark, aside).count() if only_new else fates["loaded"]
        fates |= {"redelivered": fates["loaded"] - loaded, "loaded": loaded}
        folders.make(spark, f"{aside}/{ledger}")
        folders.write_text(spark, f"{aside}/{ledger}/counts.json", json.dumps(fates))
    moves.append((ledger if fates else None, ledger))
    if merged:
        # The rows of the batch leave the compacted days, and the new ones are merged into them.
        without = F.array_remove(ORIGINS, batch)
        others = read_stored(spark, root).filter(of_days(merged) & (F.col("batch") != batch))
        others = others.withColumn(ORIGINS, without).filter(F.col(ORIGINS).isNull() | (F.size(ORIGINS) > 0))
        again = others.unionByName(read_stored(spark, aside).filter(of_days(merged)))
        moves += _merge(spark, root, f"{aside}/again", again, merged, "again/")
    commits.commit(spark, root, batch, moves)


def _fates(spark: SparkSession, aside: str) -> dict[str, int]:
    """Messages of a staged batch by fate, from the copies that its rows stand for."""
    staged = spark.read.schema(f"reason string, {COPIES} bigint, tier string").parquet(f"{aside}/log")
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col(COPIES))), F.lit(0))
    raw = F.col("tier") == "raw"
    counts = staged.agg(
        total(F.lit(True)).alias("messages"),
        total(F.col("tier") == "dead_letter").alias("dead_letters"),
        total((F.col("tier") == "not_stored") & (F.col("reason") == ingest.OTHER_LOG)).alias("other_logs"),
        total((F.col("tier") == "not_stored") & (F.col("reason") == ingest.DIAGNOSTIC)).alias("diagnostics"),
        total(raw).alias("routed"),
        F.count_if(raw).alias("loaded"),
    )
    found = counts.withColumn("duplicates", F.col("routed") - F.col("loaded")).first()
    return found.asDict()


def _drop_known(spark: SparkSession, root: str, aside: str, batch: str, skip: list[str]) -> None:
    """Rewrite the staged rows if other batches stored messages that are among them."""
    path, before = raw_path(aside), f"{aside}/before"
    days = [v for v in folders.partition_values(spark, path, "day") if v not in skip]
    if not days:
        return
    folders.rename(spark, path, before)
    staged = spark.read.schema(RAW_SCHEMA).parquet(before)
    found = index.redelivered(spark, root, batch, staged, days)
    if found is None:
        folders.rename(spark, before, path)
        return
    known = f"{aside}/known"
    found.write.parquet(known)
    found = spark.read.schema("day date, insertId string").parquet(known)
    kept = _without_known(staged, found, few=found.count() <= BROADCAST_IDS)
    folders.make(spark, path)
    kept.write.mode("append").partitionBy("day", "batch").parquet(path)


def _without_known(staged: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """Staged rows whose day and id are not among those found, ready to be stored by day.

    Staged files are split by day already, so with ids that fit into every task rows stay in the task that reads them. More ids
    are joined by an exchange, which the rows need another one after.
    """
    found = found.select(F.col("day").alias("found_day"), F.col("insertId").alias("found_id"))
    same = F.col("day").eqNullSafe(F.col("found_day")) & (F.col("insertId") == F.col("found_id"))
    if few:
        kept = staged.join(F.broadcast(found), same, "left_anti")
    else:
        kept = staged.join(found, same, "left_anti").hint("rebalance", "day")
    return kept.sortWithinPartitions("day", "batch", "logName", "severity")


def ingest_batch(
    messages: DataFrame,
    root: str,
    project: str,
    batch: str = "batch-0",
    ingest_ts: AsOf | None = None,
    known: DataFrame | None = None,
    only_new: bool = False,
) -> None:
    """Messages to stored raw rows and dead letters, redelivered copies removed.

    Messages that other batches stored are redeliveries, too. ``only_new`` finds them in the id index and leaves them out;
    ``known`` does so for given raw rows (``known_rows``), whose ids are read, and leaves the batch without a count of fates.
    ``plans.refresh.refresh_batch`` carries the batch on to the base table and the stored views.
    """
    arrived = ts_lit(ingest_ts) if ingest_ts else F.current_timestamp()
    classified = ingest.to_raw(ingest.classify(messages, project))
    if known is None:
        kept = ingest.deduplicate_counted(classified)
    else:
        kept = ingest.first_copies(ingest.with_outcome(classified, ingest.ROUTED, ingest.DEAD_LETTER))
        kept = ingest.only_new(kept.withColumn("day", F.to_date("timestamp")), known).drop("day")
    write_log(kept, root, batch, arrived, only_new=only_new)


def known_rows(spark: SparkSession, root: str, batch: str, since: date | None = None) -> DataFrame | None:
    """Stored raw rows of other batches, from a day on; None when nothing is stored yet."""
    if not folders.exists(spark, raw_path(root)):
        return None
    others = read_raw(spark, root).filter(F.col("batch") != batch)
    return others.filter(F.col("day") >= F.lit(since)) if since else others


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(raw_path(root))


def read_stored(spark: SparkSession, root: str) -> DataFrame:
    """Raw rows with the batches that brought them, where they were merged."""
    return spark.read.schema(STORED_SCHEMA).parquet(raw_path(root))


def merged_days(spark: SparkSession, root: str, batch: str) -> list[date | None]:
    """Compacted days that hold, or held, rows of a batch."""
    if not folders.exists(spark, merged_path(root)):
        return []
    return stored_days(read_merged(spark, root).filter(F.col("batch") == batch))


def read_merged(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MERGED_SCHEMA).parquet(merged_path(root))


def read_fates(spark: SparkSession, root: str) -> DataFrame:
    """Messages of each batch by fate, as counted when it was ingested; streamed batches have no count."""
    return spark.read.schema(FATES_SCHEMA).json(f"{root}/{FATES}")


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DEAD_SCHEMA).parquet(dead_letter_path(root))


def _base_rows(raw: DataFrame, **view_options) -> DataFrame:
    # Needs no shuffle: raw files are already split by day. Sorting by event name lets Parquet
    # statistics skip row groups for the views that read a few events.
    return stored_columns(analytics_view(raw, **view_options)).sortWithinPartitions("day", "batch", "event_name")


def add_base(raw: DataFrame, path: str, **view_options) -> None:
    """Store the typed base view of some raw rows beside what is there."""
    folders.make(raw.sparkSession, path)
    _base_rows(raw, **view_options).write.mode("append").partitionBy("day", "batch").parquet(path)


def write_base(raw: DataFrame, path: str, **view_options) -> None:
    """Store the typed base view of the whole raw table, so that queries do not parse JSON again."""
    rows = _base_rows(raw, **view_options)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day", "batch").parquet(path)


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """The stored base view; the parsed JSON columns are computed only when selected."""
    return parsed_json(spark.read.schema(base_schema(spark)).parquet(path))


_BASE_SCHEMAS: dict[str, T.StructType] = {}


def read_empty_base(spark: SparkSession, user_col: str) -> DataFrame:
    """The stored base view without rows, for its schema. The view is analysed once; that takes longer than small jobs do."""
    if user_col not in _BASE_SCHEMAS:
        view = analytics_view(spark.createDataFrame([], RAW_SCHEMA), pseudonymize=user_col != USER_EMAIL)
        _BASE_SCHEMAS[user_col] = stored_columns(view).schema
    return spark.createDataFrame([], _BASE_SCHEMAS[user_col])


def base_schema(spark: SparkSession) -> T.StructType:
    """Columns of the stored base view with emails."""
    return read_empty_base(spark, USER_EMAIL).schema


def day_folder(day: date | None) -> str:
    return folders.EMPTY_DAY if day is None else day.isoformat()


def of_days(days: list[date | None]) -> Column:
    """Rows of some days, as a filter on the partition column."""
    within = F.coalesce(F.col("day").isin([d for d in days if d is not None]), F.lit(False))
    return within | F.col("day").isNull() if None in days else within


def rewrite(
    spark: SparkSession,
    rows: DataFrame,
    values: list[date | None],
    path: str,
    partitions: tuple[str, str] = ("day", "batch"),
    exchanged: bool = True,
) -> None:
    """Store ``rows`` as all that a table has for some values of its outer partition.

    Rows that come from stored files of the same days, one by one, are split by day already; with ``exchanged=False`` they stay
    in the task that read them. The result is staged beside the table under a fixed name, in one job, and then swapped in folder by folder; a swap
    that was cut off is finished by the next rewrite (``folders.finish``). Values that end without rows lose their folder.
    """
    staged = rewritten(rows, partitions, exchanged)
    staged.write.mode("overwrite").partitionBy(*partitions).parquet(f"{folders.staging_of(path)}/data")
    folders.swap(spark, path, partitions[0], [day_folder(v) for v in values])


def rewritten(rows: DataFrame, partitions: tuple[str, str], exchanged: bool) -> DataFrame:
    """Rows in the tasks that store them."""
    return (rows.hint("rebalance", partitions[0]) if exchanged else rows).sortWithinPartitions(*partitions)


def rewrite_days(
    spark: SparkSession,
    table: DataFrame,
    days: list[date | None],
    path: str,
    change: Callable[[DataFrame], DataFrame],
    exchanged: bool = False,
) -> None:
    """Apply ``change`` to the rows of some days and store the result in their place. Only these days are read."""
    folders.finish(spark, path)
    if days:
        rewrite(spark, change(table.filter(of_days(days))), days, path, exchanged=exchanged)


def repair_days(spark: SparkSession, root: str, days: list[date | None]) -> None:
    """Compact closed days: one batch for each, redelivered copies of different batches removed.

    Streaming de-duplication forgets an id after its horizon, and batches do not see each other;
    this is the repair for both. File counts follow the size (``rebalance``), not the batches that
    came in. ``plans.refresh.refresh_days`` carries the days on to the base table and stored views.
    """
    aside = commits.begin(spark, root, COMPACTED)
    folders.finish(spark, raw_path(root))
    if days:
        moves = _merge(spark, root, aside, read_stored(spark, root).filter(of_days(days)), days)
        commits.commit(spark, root, COMPACTED, moves)


def _compacted(rows: DataFrame) -> DataFrame:
    """Each message of some days once, as rows of one batch that know the batches that brought them.

    A row that came in several batches belongs to all of them. Only ids that did are collected by id.
    """
    brought = F.coalesce(F.col(ORIGINS), F.array("batch"))
    numbered = rows.withColumn(ORIGINS, brought).withColumn("row_id", F.monotonically_increasing_id().cast("string"))
    unique = ingest.first_copies(numbered.withColumn("tie", F.xxhash64(*ingest.RAW_COLUMNS)))
    pairs = rows.filter("insertId is not null").select("insertId", F.explode(brought).alias("origin"))
    several = pairs.groupBy("insertId").agg(F.collect_set("origin").alias("all")).filter(F.size("all") > 1)
    # Joined by the columns that rows were grouped by, so that they aren't exchanged and sorted once more.
    several = ingest.with_group(several.withColumn("row_id", F.lit("")), ingest.dedup_key()).select(*ingest.GROUP, "all")
    joined = unique.join(several, list(ingest.GROUP), "left")
    return joined.withColumns({ORIGINS: F.coalesce("all", ORIGINS), "batch": F.lit(COMPACTED)}).select(*STORED_SCHEMA.names)


def _merge(
    spark: SparkSession, root: str, aside: str, rows: DataFrame, days: list[date | None], prefix: str = ""
) -> commits.Moves:
    """Stage ``rows`` as all that some days have, each message once, and say what takes which place.

    ``prefix`` is what precedes the staged folders within the commit.
    """
    write_folders(_compacted(rows), raw_path(aside), "logName", "severity")
    index.write(spark, read_raw(spark, aside), aside)
    names = read_stored(spark, aside).select(F.explode(ORIGINS).alias("batch"), "day")
    if folders.exists(spark, merged_path(root)):
        # A batch stays listed when its last row has gone, so that what follows from the day is brought up to date with it.
        names = names.unionByName(read_merged(spark, root).filter(of_days(days)))
    names.distinct().repartition("day").write.partitionBy("day").parquet(merged_path(aside))
    values = [day_folder(day) for day in days]
    return [
        (staged and prefix + staged, place)
        for table in (RAW, index.IDS, index.USERS, MERGED)
        for staged, place in commits.whole_days(spark, aside, table, values)
    ]


def stored_days(frame: DataFrame) -> list[date | None]:
    """Days present in a table. One row per day reaches the driver, bounded by the retention."""
    return [row.day for row in frame.select("day").distinct().orderBy("day").collect()]


def expire(spark: SparkSession, path: str, as_of: AsOf, keep_days: int, column: str = "day") -> list[date]:
    """Remove the partitions of a table older than ``keep_days``; returns their dates."""
    cutoff = day_before(as_of, keep_days)
    dates = [date.fromisoformat(v) for v in folders.partition_values(spark, path, column) if v != folders.EMPTY_DAY]
    expired = [d for d in dates if d < cutoff]
    folders.remove(spark, [f"{path}/{column}={d.isoformat()}" for d in expired])
    return expired


def expire_all(spark: SparkSession, root: str, table_root: str, as_of: AsOf) -> dict[str, list[date]]:
    """Apply the documented retention to the log with all that is derived from it, and to the scheduled tables."""
    logs = [raw_path(root), dead_letter_path(root), base_path(root), minutes_path(root)]
    logs += [general_path(root), lag_path(root), alerts_path(root), merged_path(root), *index.paths(root)]
    logs += folders.matching(spark, f"{root}/incremental/*")
    removed = {path: expire(spark, path, as_of, RETENTION_DAYS["raw"]) for path in logs}
    for name, column in SCHEDULED.items():
        path = f"{table_root}/{name}_table"
        removed[path] = expire(spark, path, as_of, RETENTION_DAYS[name], column)
    return removed


# Outer partition column of each scheduled table.
SCHEDULED = {"daily_rollup": "day", "quota_alerts": "alert_date", "weekly_rollup": "week_start_date"}


def retained(frame: DataFrame, as_of: AsOf, keep_days: int) -> DataFrame:
    """Rows that retention keeps; rows without a day stay."""
    return frame.filter(F.col("day").isNull() | (F.col("day") >= F.lit(day_before(as_of, keep_days))))


def documented_columns(frame: DataFrame) -> Iterable[tuple[str, str, str]]:
    """Name, type and description; partition columns lose their metadata when read, so look them up."""
    for field in frame.schema.fields:
        yield field.name, field.dataType.simpleString(), RAW_DOC.get(field.name, "")


def schema_doc(raw: DataFrame) -> DataFrame:
    """Name, type, description and number of filled rows of every raw column."""
    columns = list(documented_columns(raw))
    counts = raw.agg(*[F.count(name).alias(name) for name, _, _ in columns])
    described = F.array(*[
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column_name"),
            F.lit(kind).alias("data_type"),
            F.lit(doc).alias("description"),
            F.col(name).alias("filled_rows"),
        )
        for position, (name, kind, doc) in enumerate(columns, 1)
    ])
    return counts.select(F.inline(described))


def register_documented(spark: SparkSession, root: str, table: str) -> None:
    """Register the raw files as a catalog table that carries the column comments."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    columns = ", ".join(f'`{n}` {k} COMMENT "{d}"' for n, k, d in documented_columns(spark.createDataFrame([], RAW_SCHEMA)))
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (day, batch) "
        f"COMMENT 'Raw log rows; nested fields are JSON text. Query the base view instead.' "
        f"LOCATION '{raw_path(root)}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {table}")
