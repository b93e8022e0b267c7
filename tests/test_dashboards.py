from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tallybeam.operators import checks, ingest, views
from tallybeam.operators.base_view import analytics_view
from tallybeam.operators.error_summary import PROMPT, error_429_summary
from tallybeam.operators.privacy import anomalies, k_anonymous_stats
from tallybeam.plans import dashboards
from tests.samples import envelope, event, messages


def api_rows(spark, counts):
    """Base-view rows of API responses from {(user, model, minute): n} on one day."""
    rows = [(u, m, minute, n) for (u, m, minute), n in counts.items()]
    frame = spark.createDataFrame(rows, "user_email string, model string, minute int, n int")
    return frame.select(
        F.timestamp_add("MINUTE", F.col("minute"), F.lit("2024-01-05").cast("timestamp")).alias("timestamp"),
        F.lit("gemini_cli.api_response").alias("event_name"),
        "user_email",
        "model",
        *[F.lit(None).cast("bigint").alias(c) for c in ("status_code", "input_tokens", "output_tokens", "total_tokens")],
        F.explode(F.sequence(F.lit(1), "n")).alias("copy"),
    )


def held(series, above, critical, hold):
    """Brute force: value is critical at the last minute and in the hold-1 minutes before it."""
    series = {m: v for m, v in series.items() if v > above}
    if not series:
        return None
    last, run = max(series), 0
    while series.get(last - run, 0) > critical:
        run += 1
    return (series[last], run) if run >= hold else None


def test_rpm_rule_against_brute_force(spark):
    rng = random.Random(1)
    counts = {
        (f"u{u}", f"m{m}", minute): rng.choice([2, 3, 4, 5])
        for u in range(12)
        for m in range(2)
        for minute in range(100, 112)
        if rng.random() < 0.8
    }
    by_user = defaultdict(dict)
    for (user, _, minute), n in counts.items():
        by_user[user][minute] = max(n, by_user[user].get(minute, 0))
    expected = {u: held(s, 2, 3, 5) for u, s in by_user.items()}
    found = dashboards.rpm_alert_rule(
        api_rows(spark, counts), "2024-01-05 12:00:00", above=2, critical=3, hold_minutes=5
    )
    actual = {r.user_email: (r.last_value, r.minutes_held) for r in found.collect()}
    assert actual == {u: v for u, v in expected.items() if v} and 0 < len(actual) < 12


def test_thresholds_are_exclusive(spark):
    counts = {("a", "m", 0): 100, ("b", "m", 0): 101, ("c", "m", 0): 121}
    av = api_rows(spark, counts).withColumn("error_code", F.lit(None).cast("string"))
    levels = {
        (r.user_identifier, r.rule): r.level for r in dashboards.threshold_alerts(av, "2024-01-05").collect()
    }
    assert levels == {("b", "rpm"): "warning", ("c", "rpm"): "critical"}


def view(spark, *values):
    return analytics_view(ingest.raw_rows(messages(spark, *values), "demo"))


def test_error_summary(spark):
    rows = [
        envelope(f"e{i}", f"2024-01-05T10:00:{i:02d}Z",
                 payload=event("api_error", f"u{i % 2}@example.com", status_code=429, **{"error.message": "slow"}))
        for i in range(4)
    ]
    av = view(spark, *rows)
    row = error_429_summary(av).first()
    assert row.total_429_errors == 4
    assert row.error_summary == "Patterns: 4x slow. Models: m. Users affected: 2"
    limited = error_429_summary(av, limit=3).first()
    assert limited.total_429_errors == 3 and str(limited.oldest_error) == "2024-01-05 10:00:01"
    own = error_429_summary(av, summarizer=lambda prompt: F.length(prompt).cast("string")).first()
    assert int(own.error_summary) > len(PROMPT)
    assert error_429_summary(view(spark, envelope())).count() == 0


def test_inference_and_audit(spark):
    raw = ingest.raw_rows(
        messages(
            spark,
            envelope("a", payload={"event.name": "gen_ai.client.inference.operation.details"}),
            envelope("b", payload={"event.name": "x", "gen_ai.output.messages": [{"type": "TOOL_CALL"}]}),
            envelope("c", payload={"event.name": "x", "gen_ai.output.messages": "none"}),
        ),
        "demo",
    )
    assert tuple(checks.inference_flags(raw).first()) == (3, 1, 1)


def test_missing_ids_and_unbalanced_load(spark):
    sent = messages(spark, envelope("a"), envelope("b"), envelope("b"), '{"cut')
    loaded = ingest.raw_rows(messages(spark, envelope("a")), "demo")
    assert [r.insertId for r in checks.missing_ids(sent, loaded, "demo").collect()] == ["b"]
    assert checks.reconciliation(sent, loaded, "demo").first().balanced is False
    full = ingest.raw_rows(sent, "demo")
    assert checks.reconciliation(sent, full, "demo").first().balanced is True


def test_invalid_blobs_are_counted(spark):
    raw = ingest.raw_rows(messages(spark, envelope("a"), envelope("b")), "demo")
    broken = raw.withColumn("labels_json", F.when(F.col("insertId") == "a", "{").otherwise("{}"))
    found = {r.column_name: (r.present, r.valid, r.invalid) for r in checks.json_validity(broken).collect()}
    assert found["labels_json"] == (2, 1, 1) and found["operation_json"] == (0, 0, 0)


def test_spikes_and_small_groups(spark):
    def used(i, day, user, tokens):
        payload = event("api_response", user, total_token_count=tokens)
        return envelope(f"{user}{i}", f"2024-01-{day:02d}T10:00:00Z", payload=payload)

    rows = [used(i, i + 1, "calm", 100 + i % 2) for i in range(12)]
    rows += [used(i, i + 1, "wild", 100 if i < 11 else 5000) for i in range(12)]
    rows += [used(0, 1, "once", 9)]
    av = view(spark, *rows)
    found = anomalies(av, "2024-01-13", user_col="user_email").collect()
    assert [(r.user_email, str(r.day), r.tokens_used) for r in found] == [("wild", "2024-01-12", 5000)]
    groups = k_anonymous_stats(av, user_col="user_email", k=3).collect()
    assert [(str(g.day), g.user_count) for g in groups] == [("2024-01-01", 3)]


def test_quota_windows(spark):
    counts = {("a", "m", 0): 2, ("a", "m", 59): 1, ("a", "m", 60): 4, ("a", None, 0): 1}
    av = api_rows(spark, counts).withColumn("status_code", F.when(F.col("copy") == 1, 429))
    rows = views.quota_tracking(av).filter("model = 'm'").orderBy("minute").collect()
    assert [r.error_429_count_per_hour for r in rows] == [2, 2, 1]
    assert {r.error_429_count_per_day for r in rows} == {3} and {r.requests_per_day for r in rows} == {7}
