"""Time the headline queries and print one JSON line.

BENCH_SF_DIR    input folder (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default 8)
BENCH_FACTOR    copies of the events, each with its own ids and users (default 1)
BENCH_HOT       share of all events that belong to one user and day (default 0)
BENCH_REPEATS   runs per query, of which the fastest counts (default 3)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import adapter, registry
from tallybeam.config import prepare_session
from tallybeam.operators import rollups, views
from tallybeam.plans import build, dashboards
from tallybeam.sources import tables
from tallybeam.sources.envelopes import read_envelopes

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FACTOR = int(os.environ.get("BENCH_FACTOR", "1"))
HOT = float(os.environ.get("BENCH_HOT", "0"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
AS_OF = registry.AS_OF


def log(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tallybeam-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", str(int(CPUS) * max(1, FACTOR // 10))))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


def scaled_events(spark: SparkSession) -> DataFrame:
    """The events FACTOR times over; a HOT share of them moved to one user and one day."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    if FACTOR > 1:
        step = events.agg(F.max("event_id")).first()[0] // 5040 * 5040 + 5040
        copy = F.explode(F.sequence(F.lit(0), F.lit(FACTOR - 1)))
        events = events.withColumn("copy", copy).withColumns({
            "event_id": F.col("event_id") + F.col("copy") * step,
            "user_id": F.col("user_id") + F.col("copy") * 1000,
        }).drop("copy")
    if HOT:
        hot = F.pmod(F.xxhash64("event_id"), F.lit(1000)) < HOT * 1000
        at_noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            secs=F.col("event_id") % 3600
        )
        events = events.withColumns(
            {"user_id": F.when(hot, 7).otherwise(F.col("user_id")), "ts": F.when(hot, at_noon).otherwise(F.col("ts"))}
        )
    return events


def write_messages(spark: SparkSession) -> str:
    path = tables.work_dir(spark, "bench-messages")
    adapter.envelopes(adapter.flatten(scaled_events(spark))).repartition(int(CPUS) * max(1, FACTOR // 4)).write.text(path)
    return path


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    started = time.time()
    path = write_messages(spark)
    messages = read_envelopes(spark, path)
    rows = messages.count()
    log(f"{rows} messages in {time.time() - started:.1f}s")
    seconds: dict[str, float] = {}

    def timed(name: str, run, repeats: int = REPEATS) -> None:
        taken = []
        for _ in range(repeats):
            begin = time.time()
            run()
            taken.append(time.time() - begin)
        seconds[name] = round(min(taken), 3)
        log(f"{name:28s} {' '.join(f'{t:.2f}' for t in taken)}")

    roots = [tables.work_dir(spark, "bench") for _ in range(REPEATS)]
    pending = iter(roots)
    timed("ingest", lambda: tables.ingest_batch(messages, next(pending), adapter.PROJECT, ingest_ts=AS_OF))
    root = roots[-1]
    pending = iter(tables.base_path(r) for r in roots)
    timed("base_table", lambda: tables.write_base(tables.read_raw(spark, root), next(pending)))
    av = tables.read_base(spark, tables.base_path(root))

    named = {
        "daily_metrics": lambda: views.daily_metrics(av),
        "user_activity": lambda: views.user_activity(av),
        "token_usage": lambda: views.token_usage(av),
        "error_analysis": lambda: views.error_analysis(av),
        "conversation_analysis": lambda: views.conversation_analysis(av),
        "tool_performance": lambda: views.tool_performance(av),
        "quota_tracking": lambda: views.quota_tracking(av),
        "user_configuration": lambda: views.user_configuration(av),
        "quota_alerts": lambda: rollups.quota_alerts(av, AS_OF, **registry.ALERTS),
        "daily_rollup": lambda: rollups.daily_rollup(av, AS_OF),
        "weekly_rollup": lambda: rollups.weekly_rollup(av, AS_OF),
        "q_top_users": lambda: dashboards.top_users(av, AS_OF),
        "q_threshold_alerts": lambda: dashboards.threshold_alerts(av, AS_OF, days=30),
    }
    for name, query in named.items():
        timed(name, lambda query=query: drain(query()))

    def build_everything() -> None:
        build.build_all(spark, av, AS_OF)
        drain(build.catalog_check(spark))

    timed("build_all", build_everything, 2)
    print(json.dumps({
        "metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").split("sf")[-1], "messages": rows,
        "ingest_rows_per_sec": round(rows / seconds["ingest"]), "cpus": int(CPUS), "factor": FACTOR, "hot": HOT,
    }))


if __name__ == "__main__":
    main()
