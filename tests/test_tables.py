from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallybeam.config import USER_EMAIL
from tallybeam.operators import incremental, ingest, privacy, rollups, views
from tallybeam.plans import build, refresh
from tallybeam.sources import folders, tables
from tallybeam.streaming import quota
from tests.samples import envelope, event, messages

ME, OTHER = "me@example.com", "other@example.com"


def ingested(spark, *values, batch="batch-0", root=None):
    root = root or tables.work_dir(spark, "test")
    tables.ingest_batch(messages(spark, *values), root, "demo", batch=batch, ingest_ts="2024-01-31 00:00:00")
    return root


def response(insert_id, time, user=ME, **payload):
    tokens = {"input_token_count": 2, "output_token_count": 1, "total_token_count": 3}
    return envelope(insert_id, time, payload=event("api_response", user, **(tokens | payload)))


@pytest.fixture(scope="module")
def two_users(spark):
    """One day shared by both users, one day of each alone, a row without a time, a dead letter each."""
    return [
        response("a", "2024-01-05T10:00:00Z"),
        response("b", "2024-01-05T10:00:30Z", OTHER),
        response("c", "2024-01-06T10:00:00Z"),
        response("d", "2024-01-07T10:00:00Z", OTHER),
        response("e", "nope"),
        response("f", "nope", OTHER),
        response("x", "2024-01-05T10:00:00Z")[:-3],
        response("y", "2024-01-05T10:00:00Z", OTHER)[:-3],
    ]


def days_and_ids(frame):
    return sorted((str(r.day), r.insertId) for r in frame.select("day", "insertId").collect())


def test_rows_without_a_time_are_stored(spark, two_users):
    root = ingested(spark, *two_users)
    raw = tables.read_raw(spark, root)
    assert ("None", "e") in days_and_ids(raw) and raw.count() == 6
    dead = tables.read_dead_letters(spark, root).collect()
    assert {d.reason for d in dead} == {"malformed_json"} and len(dead) == 2


def test_repeated_batch_replaces_itself_and_batches_add_up(spark, two_users):
    root = ingested(spark, *two_users)
    ingested(spark, *two_users, root=root)
    ingested(spark, response("z", "2024-01-05T11:00:00Z"), batch="batch-1", root=root)
    assert tables.read_raw(spark, root).count() == 7


def test_a_batch_that_is_repeated_on_another_day_replaces_itself(spark, two_users):
    root = ingested(spark, *two_users)
    tables.ingest_batch(messages(spark, two_users[0], two_users[6]), root, "demo", ingest_ts="2024-02-02 00:00:00")
    assert days_and_ids(tables.read_raw(spark, root)) == [("2024-01-05", "a")]
    assert [str(r.day) for r in tables.read_dead_letters(spark, root).collect()] == ["2024-02-02"]
    with pytest.raises(ValueError):
        ingested(spark, *two_users, batch="a/b", root=root)


def test_redelivery_in_a_later_batch(spark, two_users):
    root = ingested(spark, *two_users)
    later = messages(spark, *two_users[:4], response("new", "2024-01-05T12:00:00Z"))
    known = tables.known_rows(spark, root, "batch-1", since=date(2024, 1, 1))
    tables.ingest_batch(later, root, "demo", "batch-1", "2024-01-31 00:00:00", known)
    assert [r.insertId for r in tables.read_raw(spark, root).filter("batch = 'batch-1'").collect()] == ["new"]


def refreshed(spark, *values):
    root = ingested(spark, *values)
    refresh.refresh_batch(spark, root, "batch-0")
    return root


def test_erasure(spark, two_users):
    root, alerts = refreshed(spark, *two_users), tables.work_dir(spark, "alerts")
    base = tables.read_base(spark, tables.base_path(root))
    rollups.run_quota_alerts(base, alerts, "2024-01-06", "run", rpm_limit=0, lookback_minutes=1440)
    assert {r.user_identifier for r in rollups.read_alerts(spark, alerts).collect()} == {ME, OTHER}
    assert privacy.erasure_preview(tables.read_raw(spark, root), ME).first().records_to_delete == 3
    erased = privacy.erase(spark, root, ME, alerts)
    assert erased.days == [None, date(2024, 1, 5), date(2024, 1, 6)]
    raw = tables.read_raw(spark, root)
    assert privacy.erasure_preview(raw, ME).first().records_to_delete == 0
    kept = [("2024-01-05", "b"), ("2024-01-07", "d"), ("None", "f")]
    assert days_and_ids(raw) == kept
    assert days_and_ids(tables.read_base(spark, tables.base_path(root))) == kept
    dead = tables.read_dead_letters(spark, root).collect()
    assert len(dead) == 1 and OTHER in dead[0].value
    assert {r.user_identifier for r in rollups.read_alerts(spark, alerts).collect()} == {OTHER}
    for frame in (quota.read_partials(spark, tables.minutes_path(root)),
                  incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))):
        assert {r.user_email for r in frame.collect()} == {OTHER}
    assert folders.partition_values(spark, tables.raw_path(root), "day") == ["2024-01-05", "2024-01-07", folders.EMPTY_DAY]
    again = privacy.erase(spark, root, ME, alerts)
    assert again.days == [] and days_and_ids(tables.read_raw(spark, root)) == kept
    assert not folders.matching(spark, f"{root}/**/*__rewrite")


def test_erasure_matches_whole_addresses(spark):
    def cut(user):
        return response("x", "2024-01-05T10:00:00Z", user)[:-3]

    root = ingested(spark, response("a", "2024-01-05T10:00:00Z"))
    privacy.erase(spark, root, ME)  # no dead letters, no base table, no stored views
    assert tables.read_raw(spark, root).count() == 0
    root = ingested(spark, cut("ann@example.com"), cut("joann@example.com"), cut("jörg@example.com"))
    privacy.erase(spark, root, "ann@example.com")
    left = [r.value for r in tables.read_dead_letters(spark, root).collect()]
    assert len(left) == 2 and any("joann" in v for v in left)
    privacy.erase(spark, root, "jörg@example.com")
    assert ["joann" in r.value for r in tables.read_dead_letters(spark, root).collect()] == [True]


def test_erasure_of_rows_that_the_base_table_does_not_have_yet(spark, two_users):
    root = refreshed(spark, *two_users)
    ingested(spark, response("late", "2024-01-09T10:00:00Z"), batch="batch-1", root=root)
    assert privacy.erase(spark, root, ME).days[-1] == date(2024, 1, 9)
    assert privacy.erasure_preview(tables.read_raw(spark, root), ME).first().records_to_delete == 0


def test_a_swap_that_was_cut_off_is_finished(spark, two_users):
    """Cut off after staging, after the note and in the middle of the swap."""
    path = tables.raw_path(ingested(spark, *two_users))
    staging = folders.staging_of(path)
    before = days_and_ids(spark.read.schema(tables.RAW_SCHEMA).parquet(path))
    kept = spark.read.schema(tables.RAW_SCHEMA).parquet(path).filter("day = '2024-01-05' and insertId = 'b'")
    kept.write.partitionBy("day", "batch").parquet(f"{staging}/data")
    folders.finish(spark, path)
    assert days_and_ids(spark.read.schema(tables.RAW_SCHEMA).parquet(path)) == before
    kept.write.partitionBy("day", "batch").parquet(f"{staging}/data")
    note = [("filled", "day", "2024-01-05"), ("emptied", "day", "2024-01-06")]
    spark.createDataFrame(note, "a string, b string, c string").write.csv(f"{staging}/note")
    for _ in range(2):
        folders.finish(spark, path)
        found = days_and_ids(spark.read.schema(tables.RAW_SCHEMA).parquet(path))
        assert found == [("2024-01-05", "b"), ("2024-01-07", "d"), ("None", "e"), ("None", "f")]
    # The day is in place already, its staged folder gone.
    spark.createDataFrame(note, "a string, b string, c string").write.csv(f"{staging}/note")
    folders.finish(spark, path)
    assert days_and_ids(spark.read.schema(tables.RAW_SCHEMA).parquet(path)) == found


def test_repair_drops_copies_across_batches(spark):
    first, copy = response("a", "2024-01-05T10:00:00Z"), envelope(..., "2024-01-05T10:00:00Z")
    root = ingested(spark, first, copy)
    ingested(spark, first, copy, response("b", "2024-01-06T10:00:00Z"), batch="batch-1", root=root)
    assert tables.read_raw(spark, root).count() == 5
    tables.repair_days(spark, root, [date(2024, 1, 5)])
    assert days_and_ids(tables.read_raw(spark, root).fillna("none", ["insertId"])) == [
        ("2024-01-05", "a"), ("2024-01-05", "none"), ("2024-01-05", "none"), ("2024-01-06", "b"),
    ]


def test_repair_carried_on_counts_each_row_once(spark, two_users):
    root = refreshed(spark, *two_users)
    ingested(spark, *two_users, batch="batch-1", root=root)
    refresh.refresh_batch(spark, root, "batch-1")
    day = date(2024, 1, 5)
    assert tables.read_base(spark, tables.base_path(root)).filter(F.col("day") == day).count() == 4
    tables.repair_days(spark, root, [day])
    refresh.refresh_days(spark, root, [day])
    for frame in (tables.read_raw(spark, root), tables.read_base(spark, tables.base_path(root))):
        assert [r.batch for r in frame.filter(F.col("day") == day).collect()] == [tables.COMPACTED] * 2
    usage = incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))
    assert {r.grand_total_tokens for r in usage.filter(F.col("day") == day).collect()} == {3}


def test_compaction_of_many_batches(spark):
    rows = [response(f"r{k}", f"2024-01-05T10:{k % 60:02d}:00Z") for k in range(50)]
    root = tables.work_dir(spark, "many")
    raw = ingest.to_raw(ingest.classify(messages(spark, *rows).repartition(8), "demo"))
    numbered = ingest.deduplicate(raw).withColumn("day", F.to_date("timestamp"))
    stored = numbered.select(*ingest.RAW_COLUMNS, "day", F.concat(F.lit("stream-"), F.col("insertId")).alias("batch"))
    stored.repartition(4).write.partitionBy("day", "batch").parquet(tables.raw_path(root))
    day = f"{tables.raw_path(root)}/day=2024-01-05"
    assert len(folders.matching(spark, f"{day}/*/*.parquet")) == 50
    tables.repair_days(spark, root, [date(2024, 1, 5)])
    assert folders.partition_values(spark, day, "batch") == [tables.COMPACTED]
    assert len(folders.matching(spark, f"{day}/*/*.parquet")) == 1
    assert tables.read_raw(spark, root).count() == 50


def test_retention_removes_old_days(spark, two_users):
    root = ingested(spark, *two_users)
    removed = tables.expire(spark, tables.raw_path(root), "2024-01-31", 25)
    assert removed == [date(2024, 1, 5)]
    left = {day for day, _ in days_and_ids(tables.read_raw(spark, root))}
    assert left == {"2024-01-06", "2024-01-07", "None"}
    assert "2024-01-05" not in folders.partition_values(spark, tables.raw_path(root), "day")


def test_retention_of_everything(spark, two_users):
    root, built = refreshed(spark, *two_users), tables.work_dir(spark, "built")
    base = tables.read_base(spark, tables.base_path(root))
    rollups.run_daily_rollup(base, f"{built}/daily_rollup_table", "2024-01-06")
    rollups.run_weekly_rollup(base, f"{built}/weekly_rollup_table", "2024-01-08")
    rollups.run_quota_alerts(base, f"{built}/quota_alerts_table", "2024-01-06", "run", rpm_limit=0, lookback_minutes=1440)
    tables.expire_all(spark, root, built, "2024-02-20")
    assert rollups.read_alerts(spark, f"{built}/quota_alerts_table").count() == 0
    assert rollups.read_daily_rollup(spark, f"{built}/daily_rollup_table").count() == 1
    tables.expire_all(spark, root, built, "2024-04-20")
    assert rollups.read_daily_rollup(spark, f"{built}/daily_rollup_table").count() == 0
    assert rollups.read_weekly_rollup(spark, f"{built}/weekly_rollup_table").count() == 1
    assert {d for d, _ in days_and_ids(tables.read_base(spark, tables.base_path(root)))} == {"None"}
    tables.expire_all(spark, root, built, "2025-04-20")
    assert rollups.read_weekly_rollup(spark, f"{built}/weekly_rollup_table").count() == 0


def test_tiers(spark, two_users):
    root = ingested(spark, *two_users)
    path = tables.work_dir(spark, "tier")
    privacy.write_tiers(tables.read_raw(spark, root), path)
    rows = spark.read.parquet(path)
    assert "user_email" not in rows.columns and rows.count() == 6
    assert rows.filter(F.concat_ws(" ", *rows.columns).contains("@example.com")).count() == 0


def test_documented_table(spark, two_users):
    root = ingested(spark, *two_users)
    tables.register_documented(spark, root, "raw_logs_doc")
    described = {r.col_name: r.comment for r in spark.sql("DESCRIBE raw_logs_doc").collect()}
    assert described["insertId"] == tables.RAW_DOC["insertId"]
    assert spark.table("raw_logs_doc").count() == 6
    spark.sql("DROP TABLE raw_logs_doc")


def test_rollup_runs_are_repeatable_and_keep_other_days(spark, two_users):
    av = base_of(spark, two_users)
    path = tables.work_dir(spark, "rollup")
    for as_of in ("2024-01-06", "2024-01-07", "2024-01-06"):
        rollups.run_daily_rollup(av, path, as_of)
    rows = rollups.read_daily_rollup(spark, path).collect()
    assert sorted((str(r.day), r.request_count, r.distinct_users) for r in rows) == [
        ("2024-01-05", 2, 2), ("2024-01-06", 1, 1),
    ]


def base_of(spark, values):
    root = ingested(spark, *values)
    tables.write_base(tables.read_raw(spark, root), tables.base_path(root))
    return tables.read_base(spark, tables.base_path(root))


def test_weeks_start_on_sunday(spark, two_users):
    av = base_of(spark, two_users)
    weeks = {str(r.week_start_date): r.request_count for r in rollups.weekly_rollup_history(av).collect()}
    assert weeks == {"2023-12-31": 3, "2024-01-07": 1, "None": 2}
    previous = rollups.weekly_rollup(av, "2024-01-08").collect()
    assert [str(r.week_start_date) for r in previous] == ["2023-12-31"]


def test_quota_alerts_with_published_limits(spark):
    busy = [
        response(f"r{i}", f"2024-01-05T{10 + i // 3000:02d}:{i // 121 % 60:02d}:{i % 60:02d}Z") for i in range(2100)
    ]
    av = base_of(spark, busy)
    found = {
        (r.alert_type, r.current_value, str(r.violation_time))
        for r in rollups.quota_alerts(av, "2024-01-05 10:15:00").collect()
    }
    # Minutes 10:05 on are in the lookback; each full minute has 121 requests.
    assert found == {("RPM_EXCEEDED", 121, f"2024-01-05 10:{m:02d}:00") for m in range(5, 17)}
    daily = rollups.quota_alerts(av, "2024-01-06 00:00:00").collect()
    assert [(r.alert_type, r.current_value, r.violation_time) for r in daily] == [("RPD_EXCEEDED", 2100, None)]


def test_config_tie_is_decided_by_insert_id(spark):
    configs = [
        envelope(i, payload=event("config", sandbox_enabled=flag, extensions=["a"], extension_count=1))
        for i, flag in (("a", True), ("b", False))
    ]
    row = views.user_configuration(base_of(spark, configs)).collect()
    assert [(r.sandbox_enabled, r.extensions, r.extension_count) for r in row] == [("false", None, 1)]


def test_zero_denominators(spark):
    values = [envelope("a", payload=event("chat_compression", tokens_before=0, tokens_after=0))]
    row = views.cli_resilience(base_of(spark, values)).first()
    assert row.avg_compression_ratio is None and row.avg_tokens_before_compression == 0


def test_incremental_rebuild_after_erasure(spark, two_users):
    root = ingested(spark, *two_users)
    tables.write_base(tables.read_raw(spark, root), tables.base_path(root))
    path = tables.work_dir(spark, "usage")
    av = tables.read_base(spark, tables.base_path(root))
    incremental.refresh("token_usage", av, path, "batch-0")
    privacy.erase(spark, root, ME)
    av = tables.read_base(spark, tables.base_path(root))
    incremental.rebuild("token_usage", av, path)
    users = {r.user_email for r in incremental.read("token_usage", spark, path).collect()}
    assert users == {OTHER}


def test_one_failing_output_does_not_stop_the_rest(spark, two_users):
    def broken(av, as_of, user):
        raise ValueError("no such thing")

    outputs = (build.Output("broken", build.VIEW, broken), *build.OUTPUTS)
    root = tables.work_dir(spark, "built")
    report = build.build_all(spark, base_of(spark, two_users), "2024-01-06", outputs=outputs, table_root=root)
    status = {r.name: r.status for r in report.collect()}
    assert status.pop("broken") == "failed"
    assert set(status.values()) == {"created"} and len(status) == 16
    present = {r.name: (r.kind, r.present, r.row_count) for r in build.catalog_check(spark, outputs).collect()}
    assert present["broken"] == (None, False, None)
    assert present["daily_rollup_table"] == ("table", True, 1)
    assert present["daily_metrics"] == ("view", True, 4)
    # A later run adds to the tables.
    build.build_all(spark, base_of(spark, two_users), "2024-01-07", table_root=root)
    assert spark.table("daily_rollup_table").count() == 2
    for name in status:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_time_range_reaches_the_partition_filter(spark, two_users):
    from tallybeam.functions.timex import time_range

    plan = time_range(base_of(spark, two_users), "2024-01-06", "2024-01-07").select("event_name")
    text = plan._jdf.queryExecution().executedPlan().toString()
    filters = text[text.index("PartitionFilters") : text.index("PushedFilters")]
    assert "day" in filters and "2024-01-06" in filters
    assert "ReadSchema: struct<timestamp:timestamp,event_name:string>" in text


def test_narrow_exchange_of_ingest(spark):
    """Past the parse, the text of a message goes on for dead letters only."""
    raw = ingest.to_raw(ingest.classify(messages(spark, response("a", "2024-01-05T10:00:00Z"), "{cut"), "demo"))
    assert [r.value for r in raw.orderBy("outcome").collect()] == ["{cut", None]
    plan = ingest.deduplicate(raw)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2


def test_compaction_exchanges_rows_by_message_once(spark, two_users):
    """Joining the batches of an id needs neither an exchange nor a sort of its own."""
    root = ingested(spark, *two_users)
    ingested(spark, two_users[0], response("g", "2024-01-05T12:00:00Z"), batch="batch-1", root=root)
    joined = tables._compacted(tables.read_stored(spark, root))
    plan = joined._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [line for node in ("Exchange", "Sort") for line in re.findall(rf"\(\d+\) {node}\nInput [^\n]*", plan) if "jsonPayload_json" in line]
    assert len(moved) <= 3 and sum(" Exchange\n" in line for line in moved) == 1
    found = {r.insertId: sorted(r[tables.ORIGINS]) for r in joined.collect()}
    assert found["a"] == ["batch-0", "batch-1"] and found["b"] == ["batch-0"] and found["g"] == ["batch-1"] and len(found) == 7


def moved_whole(frame):
    """Exchanges of rows with their payload."""
    spark = frame.sparkSession
    plan = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [line for line in re.findall(r"\(\d+\) Exchange\nInput [^\n]*", plan) if "jsonPayload_json" in line]


def test_a_rewrite_of_stored_rows_needs_no_exchange_and_no_job_for_its_swap(spark, two_users):
    root = ingested(spark, *two_users)
    kept = tables.read_raw(spark, root).filter("insertId <> 'a'")
    assert not moved_whole(tables.rewritten(kept, ("day", "batch"), exchanged=False))
    path = tables.raw_path(root)
    kept.filter("day = '2024-01-05'").write.partitionBy("day", "batch").parquet(f"{folders.staging_of(path)}/data")
    spark.sparkContext.setJobGroup("swap", "folders only")
    folders.swap(spark, path, "day", ["2024-01-05", "2024-01-06", folders.EMPTY_DAY])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("swap")) == []
    spark.sparkContext.setJobGroup("after", "")
    assert days_and_ids(tables.read_raw(spark, root)) == [("2024-01-05", "b"), ("2024-01-07", "d")]


def test_the_schema_of_the_base_view_is_analysed_once(spark, monkeypatch):
    first = tables.read_empty_base(spark, USER_EMAIL).schema
    monkeypatch.setattr(tables, "analytics_view", None)
    assert tables.read_empty_base(spark, USER_EMAIL).schema == first


def test_messages_that_are_stored_are_dropped_without_an_exchange_of_rows(spark, two_users):
    root = ingested(spark, *two_users)
    fresh = ingest.first_copies(ingest.with_outcome(ingest.to_raw(ingest.classify(messages(spark, *two_users), "demo")), ingest.ROUTED))
    fresh = fresh.withColumn("day", F.to_date("timestamp"))
    kept = ingest.only_new(fresh, tables.read_raw(spark, root))
    assert len(moved_whole(kept)) == 1  # by message, for the first copies
    assert sorted(r.insertId for r in kept.collect()) == ["e", "f"]  # rows without a day are never copies


def test_redeliveries_leave_staged_rows_without_an_exchange(spark, two_users, monkeypatch):
    root = ingested(spark, *two_users)
    known = tables.read_raw(spark, root).filter("insertId in ('a', 'e')").select("day", "insertId")
    few, many = (tables._without_known(tables.read_raw(spark, root), known, few) for few in (True, False))
    assert not moved_whole(few) and days_and_ids(few) == days_and_ids(many)
    assert days_and_ids(few) == [("2024-01-05", "b"), ("2024-01-06", "c"), ("2024-01-07", "d"), ("None", "f")]
    again = [response("g", "2024-01-05T12:00:00Z"), *two_users]
    for limit in (0, 100):
        monkeypatch.setattr(tables, "BROADCAST_IDS", limit)
        tables.ingest_batch(messages(spark, *again), root, "demo", "batch-1", "2024-01-31 00:00:00", only_new=True)
        assert days_and_ids(tables.read_raw(spark, root).filter("batch = 'batch-1'")) == [("2024-01-05", "g")]
