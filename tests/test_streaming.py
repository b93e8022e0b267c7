from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from tallybeam.operators import ingest, views
from tallybeam.sources import tables
from tallybeam.sources.envelopes import stream_envelopes
from tallybeam.streaming.ingest import start_ingest
from tallybeam.plans import refresh
from tallybeam.operators import incremental, privacy
from tallybeam.streaming.quota import read_quota_minutes, rpm_alerts
from tests.samples import envelope, event, messages


def add_file(spark, path, *values):
    messages(spark, *values).coalesce(1).write.mode("append").text(path)


def run(spark, source, root):
    stream = stream_envelopes(spark, source, max_files_per_trigger=1)
    start_ingest(stream, root, f"{root}/checkpoint", "demo", every=None).awaitTermination()
    return tables.read_raw(spark, root)


def response(insert_id, time, user="u@example.com"):
    return envelope(insert_id, time, payload=event("api_response", user, input_token_count=1))


def test_stream_equals_batch_over_several_runs(spark):
    source, root = tables.work_dir(spark, "source"), tables.work_dir(spark, "stream")
    first = [response("a", "2024-01-05T10:00:00Z"), envelope(...), envelope(...), '{"cut']
    second = [response("a", "2024-01-05T10:00:00Z"), response("b", "2024-01-05T10:00:30Z"), envelope(...)]
    # Far older than anything seen: it still goes to its own day.
    third = [response("late", "2023-11-01T00:00:00Z"), envelope("o", logName="projects/demo/logs/other")]
    add_file(spark, source, *first)
    assert run(spark, source, root).count() == 3
    add_file(spark, source, *second)
    add_file(spark, source, *third)
    raw = run(spark, source, root)
    expected = ingest.raw_rows(messages(spark, *first, *second, *third), "demo")
    columns = [F.col(c) for c in ingest.RAW_COLUMNS]
    assert sorted(map(str, raw.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))
    assert str(raw.filter("insertId = 'late'").first().day) == "2023-11-01"
    assert tables.read_dead_letters(spark, root).count() == 1
    # Running again with nothing new changes nothing.
    assert run(spark, source, root).count() == raw.count()


def test_repeated_micro_batch_is_stored_once(spark):
    root = tables.work_dir(spark, "repeat")
    rows = ingest.deduplicate(ingest.to_raw(ingest.classify(messages(spark, envelope("a"), envelope(...)), "demo")))
    for _ in range(2):
        tables.write_log(rows, root, "stream-7", F.lit("2024-01-05 00:00:00").cast("timestamp"))
    assert tables.read_raw(spark, root).count() == 2


def minutes(spark, root):
    return sorted(map(str, read_quota_minutes(spark, tables.minutes_path(root)).collect()))


def batch_minutes(spark, root):
    av = tables.read_base(spark, tables.base_path(root))
    columns = read_quota_minutes(spark, tables.minutes_path(root)).columns
    return sorted(map(str, views.quota_minutes(av).select(*columns).collect()))


BATCHES = (
    [response(f"a{i}", f"2024-01-05T10:00:{i:02d}Z") for i in range(5)],
    [response("b", "2024-01-05T18:01:00Z"),
     envelope("e", "2024-01-05T18:01:10Z", payload=event("api_error", "u@example.com", status_code=429))],
    # Hours late for its minute.
    [response("late", "2024-01-05T10:00:40Z"), response("o", "2024-01-05T10:00:41Z", "other@example.com")],
)


def test_streamed_minutes_equal_the_batch_view(spark):
    source, root = tables.work_dir(spark, "source"), tables.work_dir(spark, "stream")
    for batch in BATCHES:
        add_file(spark, source, *batch)
    run(spark, source, root)
    found = minutes(spark, root)
    assert found == batch_minutes(spark, root) and len(found) == 3
    alerts = rpm_alerts(read_quota_minutes(spark, tables.minutes_path(root)), limit=5).collect()
    assert [r.requests_per_minute for r in alerts] == [6]
    usage = incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))
    assert sorted(map(str, usage.collect())) == sorted(
        map(str, views.token_usage(tables.read_base(spark, tables.base_path(root))).select(*usage.columns).collect())
    )
    # Erasing one user leaves the counts of others as they are.
    privacy.erase(spark, root, "other@example.com")
    assert minutes(spark, root) == [m for m in found if "other" not in m] == batch_minutes(spark, root)
    # A batch that is carried on again replaces its counts.
    refresh.refresh_batch(spark, root, "stream-0")
    assert minutes(spark, root) == batch_minutes(spark, root)


def test_restart_between_the_store_and_the_checkpoint(spark, monkeypatch):
    """The batch is stored but not committed: the restarted stream runs it again, and nothing counts twice."""
    source, root = tables.work_dir(spark, "source"), tables.work_dir(spark, "stream")
    add_file(spark, source, *BATCHES[0])
    run(spark, source, root)
    add_file(spark, source, *BATCHES[1], '{"cut')
    import tallybeam.streaming.ingest as streaming

    def then_die(*args):
        refresh.refresh_batch(*args)
        raise RuntimeError("lost after the batch was stored")

    monkeypatch.setattr(streaming, "refresh_batch", then_die)
    try:
        run(spark, source, root)
    except Exception as failure:  # noqa: BLE001 - the stream reports it in its own type
        assert "lost after the batch was stored" in str(failure)
    assert tables.read_raw(spark, root).count() == 7
    monkeypatch.undo()
    add_file(spark, source, *BATCHES[2])
    assert run(spark, source, root).count() == 9
    assert tables.read_dead_letters(spark, root).count() == 1
    assert minutes(spark, root) == batch_minutes(spark, root)


def test_a_large_micro_batch_uses_many_tasks(spark):
    source, root = tables.work_dir(spark, "source"), tables.work_dir(spark, "stream")
    add_file(spark, source, *[response(f"r{i}", "2024-01-05T10:00:00Z") for i in range(400)])
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    stream = stream_envelopes(spark, source)
    start_ingest(stream, root, f"{root}/checkpoint", "demo", every=None, rows_per_file=20).awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    raw = tables.read_raw(spark, root)
    assert raw.count() == 400
    assert len(raw.inputFiles()) > 4


def test_tables_of_a_micro_batch_have_few_files(spark):
    """What a batch derives is written as in a batch run, not one file for each shuffle partition and day."""
    source, root = tables.work_dir(spark, "source"), tables.work_dir(spark, "stream")
    add_file(spark, source, *[response(f"f{i}", "2024-01-05T10:00:00Z", f"user{i}@example.com") for i in range(60)])
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = stream_envelopes(spark, source)
        start_ingest(stream, root, f"{root}/checkpoint", "demo", every=None, alert_limit=0).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    for path in (tables.incremental_path(root, "daily_metrics"), tables.minutes_path(root), tables.alerts_path(root)):
        stored = spark.read.parquet(path)
        assert stored.count() == 60 and len(stored.inputFiles()) == 1
    assert 1 <= len(list(Path(f"{root}/checkpoint/state/0").glob("[0-9]*"))) <= 2 * spark.sparkContext.defaultParallelism
