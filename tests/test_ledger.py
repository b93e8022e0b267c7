"""Commits, batches that come again after compaction, the id and user indexes, partial aggregates with distinct counts."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallybeam.operators import checks, incremental, ingest, privacy, rollups, views
from tallybeam.plans import refresh
from tallybeam.sources import commits, folders, index, tables
from tallybeam.streaming import alerts, quota
from tests.samples import envelope, event, messages
from tests.test_tables import ME, OTHER, days_and_ids, ingested, response

DAYS = [date(2024, 1, 5), date(2024, 1, 6)]


def ids_by_day(frame):
    return sorted((str(r.day), str(r.insertId)) for r in frame.select("day", "insertId").collect())


def carried(spark, *values, batch, root=None):
    root = ingested(spark, *values, batch=batch, root=root)
    refresh.refresh_batch(spark, root, batch)
    return root


def state(spark, root):
    """What is stored, by table, without the batches that own it."""
    usage = incremental.read("daily_metrics", spark, tables.incremental_path(root, "daily_metrics"))
    frames = {
        "raw": tables.read_raw(spark, root).select(*ingest.RAW_COLUMNS, "day"),
        "base": tables.read_base(spark, tables.base_path(root)).select("insertId", "day", "user_email"),
        "minutes": quota.read_quota_minutes(spark, tables.minutes_path(root)),
        "usage": usage,
    }
    return {name: sorted(map(str, frame.collect())) for name, frame in frames.items()}


FIRST = [response("a", "2024-01-05T10:00:00Z"), response("b", "2024-01-06T10:00:00Z", OTHER), envelope(..., "2024-01-05T11:00:00Z")]
SECOND = [FIRST[0], response("c", "2024-01-05T10:00:10Z"), response("d", "2024-01-07T10:00:00Z"), envelope(..., "2024-01-05T11:00:00Z")]


@pytest.fixture
def compacted(spark):
    root = carried(spark, *FIRST, batch="b0")
    carried(spark, *SECOND, batch="b1", root=root)
    tables.repair_days(spark, root, DAYS)
    refresh.refresh_days(spark, root, DAYS)
    return root


def test_a_batch_that_comes_again_after_compaction(spark, compacted):
    before = state(spark, compacted)
    assert len(before["raw"]) == 6
    for batch, values in (("b0", FIRST), ("b1", SECOND), ("b1", SECOND)):
        carried(spark, *values, batch=batch, root=compacted)
        assert state(spark, compacted) == before
    assert {(str(r.day), r.batch) for r in tables.read_raw(spark, compacted).collect()} == {
        ("2024-01-05", "compacted"), ("2024-01-06", "compacted"), ("2024-01-07", "b1"),
    }


def test_a_compacted_batch_that_comes_again_with_other_rows(spark, compacted):
    """Rows that only it had go, also the last of a day; what another batch brought as well stays."""
    carried(spark, response("new", "2024-01-05T12:00:00Z"), batch="b0", root=compacted)
    found = days_and_ids(tables.read_raw(spark, compacted).fillna("none", ["insertId"]))
    assert found == [("2024-01-05", "a"), ("2024-01-05", "c"), ("2024-01-05", "new"), ("2024-01-05", "none"), ("2024-01-07", "d")]
    assert days_and_ids(tables.read_base(spark, tables.base_path(compacted)).fillna("none", ["insertId"])) == found
    carried(spark, batch="b1", root=compacted)
    assert days_and_ids(tables.read_raw(spark, compacted)) == [("2024-01-05", "new")]
    assert days_and_ids(tables.read_base(spark, tables.base_path(compacted))) == [("2024-01-05", "new")]
    minutes = quota.read_quota_minutes(spark, tables.minutes_path(compacted)).collect()
    assert [r.requests_per_minute for r in minutes] == [1]


def test_a_later_batch_of_a_compacted_day_counts_once(spark, compacted):
    """It is ingested after the repair and carried on after the day was refreshed again."""
    root = ingested(spark, response("late", "2024-01-05T10:00:20Z"), batch="b2", root=compacted)
    refresh.refresh_days(spark, root, DAYS)
    refresh.refresh_batch(spark, root, "b2")
    usage = incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))
    assert {r.grand_total_tokens for r in usage.filter("day = '2024-01-05'").collect()} == {9}
    carried(spark, batch="b2", root=root)
    usage = incremental.read("token_usage", spark, tables.incremental_path(root, "token_usage"))
    assert {r.grand_total_tokens for r in usage.filter("day = '2024-01-05'").collect()} == {6}


def test_erasure_keeps_who_brought_a_row(spark, compacted):
    privacy.erase(spark, compacted, OTHER)
    before = state(spark, compacted)
    assert len(before["raw"]) == 5
    carried(spark, *SECOND, batch="b1", root=compacted)
    assert state(spark, compacted) == before


class Cut(Exception):
    pass


def cut_at(monkeypatch, number):
    """Raise at the ``number``-th step of the commits to come."""
    left = [number]

    def reached(step):
        left[0] -= 1
        if not left[0]:
            raise Cut(step)

    monkeypatch.setattr(commits, "reached", reached)


def test_a_batch_cut_off_at_each_step(spark, monkeypatch):
    """Until the record is there, all of the old rows are; from then on, all of the new ones once anyone comes by."""
    root = ingested(spark, *FIRST, "{cut")
    old = ids_by_day(tables.read_raw(spark, root))
    number = 0
    while True:
        number += 1
        cut_at(monkeypatch, number)
        try:
            ingested(spark, *SECOND, "{cut", "{cut too", root=root)
            break
        except Cut as cut:
            step = str(cut)
        monkeypatch.setattr(commits, "reached", lambda step: None)
        if step == "staged":
            assert ids_by_day(tables.read_raw(spark, root)) == old
            assert tables.read_dead_letters(spark, root).count() == 1
            commits.finish(spark, root)
            assert ids_by_day(tables.read_raw(spark, root)) == old
        else:
            commits.finish(spark, root)
            new = [("2024-01-05", "None"), ("2024-01-05", "a"), ("2024-01-05", "c"), ("2024-01-07", "d")]
            assert ids_by_day(tables.read_raw(spark, root)) == new
            assert tables.read_dead_letters(spark, root).count() == 2
            assert index.read_ids(spark, root).count() == 3
        ingested(spark, *FIRST, "{cut", root=root)
        assert ids_by_day(tables.read_raw(spark, root)) == old
    assert number > 6
    assert not folders.matching(spark, f"{root}/_pending/*")


@pytest.mark.parametrize("number", [2, 5])
def test_a_refresh_and_a_repair_cut_off(spark, monkeypatch, number):
    root = carried(spark, *FIRST, batch="b0")
    carried(spark, *SECOND, batch="b1", root=root)

    def again(job):
        cut_at(monkeypatch, number)
        with pytest.raises(Cut):
            job()
        monkeypatch.setattr(commits, "reached", lambda step: None)
        job()

    again(lambda: refresh.refresh_batch(spark, root, "b1"))
    again(lambda: tables.repair_days(spark, root, DAYS))
    again(lambda: refresh.refresh_days(spark, root, DAYS))
    whole = state(spark, root)
    assert len(whole["raw"]) == len(whole["base"]) == 6
    assert sum(int(re.search(r"request_count=(\d+)", r)[1]) for r in whole["usage"]) == 6


def read_schemas(frame):
    return re.findall(r"ReadSchema: struct<([^>]*)>", frame._jdf.queryExecution().executedPlan().toString())


def test_new_messages_read_hashes_only(spark):
    """No stored id is read without a hit, and with one only the files that have it."""
    root = ingested(spark, *[response(f"r{k}", f"2024-01-{5 + k % 9:02d}T10:00:00Z") for k in range(90)])
    ingested(spark, response("other", "2024-01-05T10:00:00Z"), batch="b1", root=root)
    new = spark.createDataFrame([(date(2024, 1, 5), f"n{k}") for k in range(40)], "day date, insertId string")
    days = ["2024-01-05", "2024-01-06"]
    found = index.hits(spark, root, "b9", new, days)
    assert "id_hash:bigint" in read_schemas(found)
    assert not any("insertId" in s for s in read_schemas(found))
    assert index.redelivered(spark, root, "b9", new, days) is None
    again = new.unionByName(spark.createDataFrame([(date(2024, 1, 5), "r9"), (date(2024, 1, 6), "r9")], new.schema))
    known = index.redelivered(spark, root, "b9", again, days)
    assert [tuple(r) for r in known.collect()] == [(date(2024, 1, 5), "r9")]
    assert len(known.inputFiles()) < len(index.read_ids(spark, root).inputFiles())
    # A batch doesn't find itself.
    assert index.redelivered(spark, root, "batch-0", again, days) is None


def test_only_new_messages_are_stored(spark):
    root = ingested(spark, *FIRST)
    later = messages(spark, *SECOND, response("b", "2024-01-07T10:00:00Z"), response("nope", "no time"))
    for _ in range(2):  # also when repeated
        tables.ingest_batch(later, root, "demo", "b1", "2024-01-31 00:00:00", only_new=True)
        own = tables.read_raw(spark, root).filter("batch = 'b1'")
        assert sorted(str(r.insertId) for r in own.collect()) == ["None", "b", "c", "d", "nope"]
    tables.ingest_batch(later, root, "demo", "b2", "2024-01-31 00:00:00", only_new=True)
    assert [r.insertId for r in tables.read_raw(spark, root).filter("batch = 'b2'").collect()] == [None]


def test_access_when_the_base_table_lags(spark):
    root = carried(spark, *FIRST, batch="b0")
    ingested(spark, response("late", "2024-01-09T10:00:00Z"), response("x", "2024-01-10T10:00:00Z", OTHER), batch="b1", root=root)
    raw, base = tables.read_raw(spark, root), tables.read_base(spark, tables.base_path(root))
    assert [r.insertId for r in privacy.access(raw, ME, base).collect()] == ["late", "a"]
    assert [r.insertId for r in privacy.stored_access(spark, root, ME).collect()] == ["late", "a"]
    privacy.stored_export(spark, root, ME, path := tables.work_dir(spark, "export"))
    assert spark.read.json(path).count() == 2
    # Only the days that the index lists are read.
    files = {re.search(r"day=([^/]+)", f)[1] for f in _files_read(privacy.stored_rows(spark, root, ME))}
    assert files == {"2024-01-05", "2024-01-09"}
    assert privacy.user_days(spark, root, "nobody@example.com") == []


def _files_read(frame):
    return {r.file for r in frame.select(F.col("_metadata.file_path").alias("file")).distinct().collect()}


def test_access_to_rows_from_before_the_index(spark):
    root = ingested(spark, *FIRST)
    folders.remove(spark, index.paths(root))
    assert [r.insertId for r in privacy.stored_access(spark, root, ME).collect()] == ["a"]
    assert privacy.erase(spark, root, ME).days == [date(2024, 1, 5)]


def test_an_email_with_escaped_characters_is_found(spark):
    written = response("a", "2024-01-05T10:00:00Z", "jörg@example.com")
    assert "\\u00f6" in written
    root = ingested(spark, written)
    assert [r.insertId for r in privacy.stored_access(spark, root, "jörg@example.com").collect()] == ["a"]


def test_erasure_leaves_the_index_without_the_user(spark):
    root = carried(spark, *FIRST, batch="b0")
    refresh.keep_general_copy(spark, root)
    carried(spark, response("m", "2024-01-06T10:00:00Z"), batch="b1", root=root)
    privacy.erase(spark, root, ME)
    assert index.user_days(spark, root, ME) == []
    assert index.user_days(spark, root, OTHER) == [date(2024, 1, 6)]
    copy = spark.read.parquet(tables.general_path(root))
    assert sorted(str(r.insertId) for r in copy.collect()) == ["None", "b"]
    tables.expire_all(spark, root, tables.work_dir(spark, "built"), "2024-04-20")
    assert index.read_users(spark, root).count() == 0
    assert index.read_ids(spark, root).count() == 0


def test_general_copy_follows_batches_and_repairs(spark):
    root = carried(spark, *FIRST, batch="b0")
    refresh.keep_general_copy(spark, root)
    carried(spark, *SECOND, batch="b1", root=root)
    tables.repair_days(spark, root, DAYS)
    refresh.refresh_days(spark, root, DAYS)
    copy = spark.read.parquet(tables.general_path(root))
    assert "user_email" not in copy.columns
    assert copy.count() == 6
    assert {(str(r.day), r.batch) for r in copy.collect()} == {("2024-01-05", "compacted"), ("2024-01-06", "compacted"), ("2024-01-07", "b1")}


def test_lag_sketches_merge(spark):
    """Percentiles of many batches from their sketches, within the stated rank; a batch that comes again counts once."""
    root = None
    for k in range(3):
        rows = [envelope(f"{k}-{n}", "2024-01-05T10:00:00Z", received=f"2024-01-05T10:{n % 60:02d}:{k * 7:02d}Z") for n in range(60)]
        root = carried(spark, *rows, response(f"no{k}", "nope"), batch=f"b{k}", root=root)
    carried(spark, *rows, batch="b2", root=root)
    tables.repair_days(spark, root, DAYS[:1])
    refresh.refresh_days(spark, root, DAYS[:1])
    (found,) = checks.read_ingest_lag(spark, tables.lag_path(root)).collect()
    lags = sorted(60 * (n % 60) + 7 * k for k in range(3) for n in range(60))
    assert (str(found.day), found.max_lag_s, found.mean_lag_s) == ("2024-01-05", lags[-1], pytest.approx(sum(lags) / 180))
    assert 0.94 <= sum(v <= found.p95_lag_s for v in lags) / 180 <= 0.965
    assert found.rows_over_limit == sum(v > 300 for v in lags)
    privacy.erase(spark, root, ME)
    assert checks.read_ingest_lag(spark, tables.lag_path(root)).count() == 1


def reports(spark, root):
    return sorted((r.batch, r.kind, r.user_email, str(r.minute)[11:16], r.requests_per_minute) for r in alerts.read_reports(spark, root).collect())


def test_minutes_are_raised_once_and_corrected(spark):
    """A late event corrects, one in a minute that stays below does nothing, a repeated batch reports the same."""

    def at(name, *seconds, minute=0, user=ME):
        return [response(f"{name}{s}", f"2024-01-05T10:{minute:02d}:{s:02d}Z", user) for s in seconds]

    batches = [[*at("a", 1, 2), *at("b", 1, 2, 3, minute=1), *at("o", 5, user=OTHER)], at("c", 7, 8), [*at("d", 9), *at("e", 1, minute=2)]]
    root = None
    for k, values in enumerate(batches):
        root = carried(spark, *values, batch=f"b{k}", root=root)
        alerts.report(spark, root, f"b{k}", 2)
    expected = [("b0", "raised", ME, "10:01", 3), ("b1", "raised", ME, "10:00", 4), ("b2", "corrected", ME, "10:00", 5)]
    assert reports(spark, root) == expected
    assert sorted(r.requests_per_minute for r in alerts.read_alerts(spark, root).collect()) == [3, 5]
    assert [str(r.minute)[11:16] for r in alerts.held(spark, root, 2).collect()] == ["10:01"]
    assert alerts.held(spark, root, 3).count() == 0
    alerts.report(spark, root, "b2", 2)
    assert reports(spark, root) == expected
    tables.repair_days(spark, root, DAYS[:1])
    refresh.refresh_days(spark, root, DAYS[:1])
    carried(spark, *batches[1], batch="b1", root=root)
    alerts.report(spark, root, "b1", 2)
    assert {r[2:4] for r in reports(spark, root)} == {(ME, "10:01"), (ME, "10:00")}
    assert sorted(r.requests_per_minute for r in alerts.read_alerts(spark, root).collect()) == [3, 5]
    privacy.erase(spark, root, ME)
    assert reports(spark, root) == []


def test_distinct_users_and_sessions_add_up(spark):
    """One user in two batches, two sessions, events and days; a row without a user."""
    one = [response("a", "2024-01-05T10:00:00Z", **{"session.id": "s1", "duration_ms": 4}), response("b", "2024-01-06T10:00:00Z", **{"session.id": "s1"})]
    two = [
        response("c", "2024-01-05T12:00:00Z", **{"session.id": "s2", "duration_ms": 5}), response("d", "2024-01-05T10:00:00Z", OTHER),
        response("e", "2024-01-05T10:00:00Z", None), envelope("f", "2024-01-05T10:00:00Z", payload=event("tool_call", ME)),
    ]
    root = carried(spark, *one, batch="b0")
    carried(spark, *two, batch="b1", root=root)
    av = tables.read_base(spark, tables.base_path(root))
    path = tables.incremental_path(root, "daily_metrics")
    cases = {
        "metrics": (views.daily_metrics(av), incremental.read("daily_metrics", spark, path)),
        "activity": (views.user_activity(av), incremental.read("user_activity", spark, tables.incremental_path(root, "user_activity"))),
        "daily": (rollups.daily_rollup_history(av), incremental.read_daily_rollup(spark, path)),
        "weekly": (rollups.weekly_rollup_history(av), incremental.read_weekly_rollup(spark, path)),
    }
    for whole, merged in cases.values():
        assert sorted(merged.columns) == sorted(whole.columns)
        assert sorted(map(str, merged.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert cases["weekly"][1].first().distinct_users == 2


def fates(spark, root):
    found = checks.batch_reconciliation(
        tables.read_fates(spark, root), tables.read_stored(spark, root), tables.read_dead_letters(spark, root)
    )
    names = ("messages", "dead_letters", "other_logs", "diagnostics", "duplicates", "redelivered", "loaded", "balanced")
    return {r.batch: tuple(r[name] for name in names) for r in found.collect()}


def test_fates_of_a_batch_are_counted_with_it(spark):
    other = envelope("x", logName="projects/demo/logs/other")
    rows = [*FIRST, FIRST[0], envelope(..., "2024-01-05T11:00:00Z"), "{", "[1]", other, other, other]
    root = ingested(spark, *rows, batch="b0")
    assert fates(spark, root) == {"b0": (10, 2, 3, 0, 1, 0, 4, True)}
    tables.ingest_batch(messages(spark, *SECOND), root, "demo", "b1", only_new=True)
    assert fates(spark, root)["b1"] == (4, 0, 0, 0, 0, 1, 3, True)
    ingested(spark, *FIRST[:2], batch="b0", root=root)  # the same batch again, with less in it
    assert fates(spark, root) == {"b0": (2, 0, 0, 0, 0, 0, 2, True), "b1": (4, 0, 0, 0, 0, 1, 3, True)}
    tables.repair_days(spark, root, DAYS)
    assert all(found[-1] for found in fates(spark, root).values())
    privacy.erase(spark, root, "u@example.com", f"{root}/tables/quota_alerts_table")
    ingested(spark, batch="empty", root=root)
    found = fates(spark, root)
    assert found["empty"] == (0, 0, 0, 0, 0, 0, 0, True)


def test_lost_rows_do_not_balance(spark):
    root = ingested(spark, *FIRST, "{", batch="b0")
    folders.remove(spark, [f"{tables.raw_path(root)}/day=2024-01-06"])
    assert fates(spark, root)["b0"][-1] is False


def test_counted_rows_are_the_deduplicated_ones(spark):
    late = envelope("a", received="2024-01-05T12:00:00Z", severity="WARN")
    rows = [late, envelope("a", severity="ERROR"), envelope("a", received=..., severity="NONE"), envelope(...), envelope(...), "x"]
    classified = ingest.to_raw(ingest.classify(messages(spark, *rows), "demo"))
    counted = {(r.insertId, r.severity, r.value): r.copies for r in ingest.deduplicate_counted(classified).collect() if r.insertId}
    plain = ingest.deduplicate(ingest.with_outcome(classified, ingest.ROUTED, ingest.DEAD_LETTER)).collect()
    assert counted == {("a", "ERROR", None): 3}
    assert [(r.insertId, r.severity) for r in plain if r.insertId] == [("a", "ERROR")]
    assert ingest.deduplicate_counted(classified).count() == len(plain) == 4
