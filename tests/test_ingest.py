from __future__ import annotations

from pyspark.sql import functions as F

from tallybeam.operators import checks, ingest
from tests.samples import LOG, envelope, messages


def outcomes(spark, *values):
    rows = ingest.classify(messages(spark, *values), "demo").select("value", "outcome", "reason").collect()
    return {r.value: (r.outcome, r.reason) for r in rows}


NOT_ONE_OBJECT = [
    '{"a":1', '{"a":1} x', "{'a':1}", '{"a":1} {"b":2}', '{"a":1},{"b":2}', "[1]", "null", '"s"', "5", "",
    # Text that closes an enclosing array or object early must not pass either.
    '{"a":1}] x', '{"a":1}} x', '{"a":1}],[{"b":2}', '{"a":1},"z":1} x', '{"a":1},"z":1', '{"a":1}}, {"z":1',
    '{"a":NaN}', '{"a":1}]', '{"a":1}}', "{}{}", "{} []",
]


def test_only_one_json_object_per_message(spark):
    found = outcomes(spark, *NOT_ONE_OBJECT)
    assert {v: o for v, (o, _) in found.items() if o != ingest.DEAD_LETTER} == {}
    assert len(found) == len(NOT_ONE_OBJECT)


def test_reasons(spark):
    found = outcomes(spark, "[1]", "5", '{"a":1')
    assert found["[1]"][1] == found["5"][1] == "not_an_object"
    assert found['{"a":1'][1] == "malformed_json"


def test_whitespace_around_the_object_is_fine(spark):
    value = "  " + envelope() + " "
    assert outcomes(spark, value)[value] == (ingest.ROUTED, None)


def test_routing_and_exclusion(spark):
    other = envelope(logName="projects/demo/logs/other")
    foreign = envelope(logName="projects/demo2/logs/gemini_cli")
    diagnostic = envelope(payload={"event.name": "x", "logging.googleapis.com/diagnostic": {"code": 1}})
    present_but_null = envelope(payload={"logging.googleapis.com/diagnostic": None})
    mentioned = envelope(payload={"note": "logging.googleapis.com/diagnostic"})
    nested = envelope(payload={"deep": {"logging.googleapis.com/diagnostic": 1}})
    found = outcomes(spark, other, foreign, diagnostic, present_but_null, mentioned, nested, "{}")
    assert found[other][0] == found[foreign][0] == found["{}"][0] == ingest.OTHER_LOG
    assert found[diagnostic][0] == found[present_but_null][0] == ingest.DIAGNOSTIC
    assert found[mentioned][0] == found[nested][0] == ingest.ROUTED


def raw_of(spark, *values):
    return ingest.raw_rows(messages(spark, *values), "demo").collect()


BLOBS = [
    ("{}", "{}"), ('{"b":1.0,"a":[1, 2]}', '{"b":1.0,"a":[1,2]}'), ("[]", "[]"), ("[1]", "[1]"), ("7", "7"),
    ("true", "true"), ('"x"', '"x"'), ('"0"', '"0"'), ('"false"', '"false"'),
    ('"a\\"b"', '"a\\"b"'), ('"{\\"a\\":1}"', '"{\\"a\\":1}"'), ('"[1]"', '"[1]"'),
    ('""', None), ("0", None), ("-0", None), ("0.0", None), ("false", None), ("null", None),
]


def test_blob_text_follows_json_truthiness(spark):
    values = [envelope(str(i))[:-1] + f',"labels":{text}}}' for i, (text, _) in enumerate(BLOBS)]
    found = {int(r.insertId): r.labels_json for r in raw_of(spark, *values)}
    assert [(text, found[i]) for i, (text, _) in enumerate(BLOBS)] == BLOBS


def test_absent_blob_is_null(spark):
    row = raw_of(spark, envelope())[0]
    assert row.labels_json is None and row.operation_json is None
    assert row.resource_json == '{"type":"global","labels":{"project_id":"p"}}'
    assert row.logName == LOG


def test_last_of_duplicate_keys_wins(spark):
    value = envelope("first")[:-1] + ',"insertId":"second"}'
    assert [r.insertId for r in raw_of(spark, value)] == ["second"]


def test_timestamps(spark):
    rows = {
        r.insertId: r.timestamp
        for r in ingest.raw_rows(
            messages(
                spark,
                envelope("nanos", "2024-01-05T10:00:10.123456789Z"),
                envelope("bad", "nope"),
                envelope("zone", "2024-01-05T12:00:00+02:00"),
            ),
            "demo",
        )
        .withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .collect()
    }
    assert rows["nanos"] == "2024-01-05 10:00:10.123456"
    assert rows["bad"] is None
    assert rows["zone"] == "2024-01-05 10:00:00.000000"


def test_redelivery_is_dropped_and_rows_without_id_stay(spark):
    again, anonymous = envelope("a"), envelope(...)
    rows = raw_of(spark, again, again, envelope("b"), anonymous, anonymous)
    assert sorted(str(r.insertId) for r in rows) == ["None", "None", "a", "b"]


def test_earliest_receipt_wins(spark):
    late = envelope("a", received="2024-01-05T10:05:00Z", severity="ERROR")
    early = envelope("a", received="2024-01-05T10:01:00Z", severity="INFO")
    assert [r.severity for r in raw_of(spark, late, early)] == ["INFO"]


def test_hot_id_and_many_missing_ids(spark):
    """A third of the rows share one id and a third have none."""
    n = 3000
    ids = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("x"), "id"))
    rows = spark.range(n, numPartitions=6).select(
        F.to_json(F.struct(F.lit(LOG).alias("logName"), ids.alias("insertId"))).alias("value")
    )
    kept = ingest.raw_rows(rows, "demo")
    assert kept.count() == 1 + n // 3 + n // 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 1, Partial")
    assert plan.index("Exchange hashpartitioning(_key") < partial  # the limit runs below the shuffle


def test_messages_are_parsed_once(spark):
    """Filters on parsed fields must stay above the parse: two from_json calls, not more."""
    sent = messages(spark, envelope())
    raw = ingest.raw_rows(sent, "demo")
    for frame in (raw, ingest.dead_letters(sent), checks.missing_ids(sent, raw.limit(1), "demo").select("insertId")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") in (2, 4), plan  # twice for each scan of the messages


def test_only_new_rows(spark):
    day = F.to_date("timestamp")
    stored = ingest.raw_rows(messages(spark, envelope("a"), envelope(...)), "demo").withColumn("day", day)
    fresh = ingest.raw_rows(messages(spark, envelope("a"), envelope("b"), envelope(...)), "demo")
    kept = ingest.only_new(fresh.withColumn("day", day), stored)
    assert sorted(str(r.insertId) for r in kept.collect()) == ["None", "b"]


def test_groups_of_messages_are_sorted_by_hash(spark):
    """Keys begin alike, so sorting by them would compare whole strings."""
    rows = ingest.to_raw(ingest.classify(messages(spark, envelope("a"), envelope("a"), envelope(...)), "demo"))
    for kept in (ingest.deduplicate(rows), ingest.deduplicate_counted(rows)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        sorts = [line.partition("Sort [")[2] for line in plan.splitlines() if "Sort [" in line]
        assert sorts and all(line.startswith("_hash#") for line in sorts)
        assert sorted(str(r.insertId) for r in kept.collect()) == ["None", "a"]
