"""Continuous ingest with Structured Streaming."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybeam.operators import ingest
from tallybeam.plans.refresh import refresh_batch
from tallybeam.sources import tables
from tallybeam.streaming import alerts

STATE_PARTITIONS = "spark.sql.shuffle.partitions"


def deduplicated_stream(messages: DataFrame, project: str, horizon: str = "1 day") -> DataFrame:
    """Routed rows and dead letters of a message stream, redelivered copies dropped.

    The de-duplication clock is arrival, not event time: a message may be as late as it likes and
    still lands in its own day, while the state forgets an id ``horizon`` after it arrived. Rows
    without an id get a random key, so none of them are dropped. The batch time is part of the
    checkpoint, which makes ``arrived`` the same when a batch is repeated.
    """
    classified = ingest.to_raw(ingest.classify(messages, project, row_id=F.expr("uuid()")))
    return (
        ingest.with_outcome(classified, ingest.ROUTED, ingest.DEAD_LETTER)
        .withColumn("dedup_key", ingest.dedup_key())
        .withColumn("arrived", F.current_timestamp())
        .withWatermark("arrived", horizon)
        .dropDuplicatesWithinWatermark(["dedup_key"])
        .drop("dedup_key", "row_id", "tie")
    )


def start_ingest(
    messages: DataFrame,
    root: str,
    checkpoint: str,
    project: str,
    every: str | None = "1 minute",
    horizon: str = "1 day",
    rows_per_file: int = tables.ROWS_PER_FILE,
    refresh: bool = True,
    only_new: bool = False,
    alert_limit: int | None = None,
) -> StreamingQuery:
    """Write a message stream to the log tables; ``every=None`` takes what is there and stops.

    Each micro-batch owns the partition ``batch=stream-<id>`` in the log and, with ``refresh``, in
    the base table and every stored view. A batch that is repeated, after a failure at any place,
    replaces all of them, so every row is stored and counted once. The tasks of a batch follow its
    size. Spark doesn't re-plan queries in the session of a stream, so what reads stored rows only runs in that of ``messages``;
    in the other each table would get a file for each day from each shuffle partition. The state has at most two
    partitions a core, since each is a database that is opened at every start. ``tables.repair_days`` compacts a day once it is complete. ``only_new`` also leaves out messages that other
    batches stored, however long ago, by the id index. With ``alert_limit`` each batch reports the minutes that it brought
    over this many requests (``streaming.alerts``).
    """

    spark = messages.sparkSession

    def store(rows: DataFrame, batch_id: int) -> None:
        batch = f"stream-{batch_id}"
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tables.write_log(kept, root, batch, F.col("arrived"), rows_per_file, only_new, spark)
        finally:
            kept.unpersist()
        if refresh:
            refresh_batch(spark, root, batch)
            if alert_limit is not None:
                alerts.report(spark, root, batch, alert_limit)

    writer = (
        deduplicated_stream(messages, project, horizon)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    triggered = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    # Read when the stream starts; a checkpoint keeps the number it began with.
    given = int(spark.conf.get(STATE_PARTITIONS))
    spark.conf.set(STATE_PARTITIONS, min(given, 2 * spark.sparkContext.defaultParallelism))
    try:
        return triggered.start()
    finally:
        spark.conf.set(STATE_PARTITIONS, given)
