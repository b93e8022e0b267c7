from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallybeam import config
from tallybeam.functions.jsonx import json_scalar, with_payload_keys
from tallybeam.operators import base_view, ingest
from tallybeam.sources import tables
from tests.samples import envelope, messages


def view_of(spark, payload, **options):
    rows = ingest.raw_rows(messages(spark, envelope(payload=payload)), "demo")
    return base_view.analytics_view(rows, **options)


CASES = [
    ({"event": {"name": "x"}}, "event_name", None),
    ({"event.name": "x"}, "event_name", "x"),
    ({"input_token_count": "7"}, "input_tokens", 7),
    ({"input_token_count": 7}, "input_tokens", 7),
    ({"input_token_count": 1.0}, "input_tokens", 1),
    ({"input_token_count": 1.5}, "input_tokens", None),
    ({"input_token_count": {"n": 1}}, "input_tokens", None),
    ({"status_code": "abc"}, "status_code", None),
    ({"error": {"code": 1}}, "error", None),
    ({"error": "boom"}, "error", "boom"),
    ({"function_args": '{"k":1}'}, "function_args", '{"k":1}'),
    ({"function_args": {"k": 1}}, "function_args", None),
    ({"function_args": "[1"}, "function_args", "[1"),
    ({"gen_ai.response.finish_reasons": ["STOP"]}, "finish_reason", None),
    ({"model": None}, "model", None),
    ({"model": 5}, "model", "5"),
    ({"model": ""}, "model", ""),
    ({"success": True}, "function_success", True),
    ({"success": "false"}, "function_success", False),
    ({"success": "yes"}, "function_success", None),
    ({"duration_ms": 2.5}, "function_duration_ms", 2.5),
    ({"error.type": "T", "status_code": 429}, "error_code", "T"),
]


def test_extraction(spark):
    values = [envelope(str(i), payload=payload) for i, (payload, _, _) in enumerate(CASES)]
    view = base_view.stored_columns(base_view.analytics_view(ingest.raw_rows(messages(spark, *values), "demo")))
    rows = {int(r.insertId): r for r in view.collect()}
    assert [(p, c, rows[i][c]) for i, (p, c, _) in enumerate(CASES)] == CASES


def test_54_columns_in_order(spark):
    columns = view_of(spark, {}).columns
    assert len(columns) == 54
    assert columns[:2] == ["timestamp", "receiveTimestamp"] and columns[47] == "user_email"
    assert columns[-5:] == list(base_view.BLOBS)
    assert view_of(spark, {}, pseudonymize=True).columns[47] == "user_pseudonym"


def test_pseudonym_of_a_missing_email(spark):
    unknown = "b23a6a8439c0dde5515893e7c90c1e3233b8616e634470f20dc4928bcf3609bc"
    assert view_of(spark, {}, pseudonymize=True).first().user_pseudonym == unknown


def test_parsed_columns_are_null_on_bad_json(spark):
    raw = ingest.raw_rows(messages(spark, envelope()), "demo").withColumn("labels_json", F.lit("not valid json {"))
    row = base_view.analytics_view(raw).select(F.col("labels").isNull(), F.col("payload").isNull()).first()
    assert tuple(row) == (True, False)


def test_redaction_leaves_no_email(spark):
    view = view_of(
        spark, {"user.email": "a@example.com", "installation.id": "i"},
        pseudonymize=True, hash_installation=True, redact_payload=True,
    )
    row = view.drop(*base_view.PARSED).first()
    assert "a@example.com" not in json.dumps(row.asDict(), default=str)
    assert len(row.installation_id_hash) == 64


def test_json_scalar_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":"x","c":[1]},"d.e":"y","s":"{\\"k\\":1}"}',)], "j string")
    picked = df.select(*[json_scalar(F.col("j"), p) for p in ("$.a.b", "$.a.c", "$.a", "$['d.e']", "$.s", "$.no")])
    assert list(picked.first()) == ["x", None, None, "y", '{"k":1}', None]


def test_nested_looking_text(spark):
    """Strings that hold JSON stay, objects and arrays are left out, however the key stands elsewhere in the payload."""
    cases = {
        '{"error":"{\\"code\\":1}"}': '{"code":1}',
        '{"error":{"code":1}}': None,
        '{"error":["a"]}': None,
        '{"error":"[API Error]"}': "[API Error]",
        '{"other":{"error":{"a":1}},"error":"{x"}': "{x",
        '{"other":{"error":"{x"},"error":{"a":1}}': None,
        '{"error": "{spaced"}': "{spaced",
        '{"error": {"a": 1}}': None,
        '{"note":"\\"error\\":{","error":"{y"}': "{y",
        '{"error":"plain"}': "plain",
        '{"a":1}': None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "jsonPayload_json string")
    found = with_payload_keys(rows, {"error": "error"}).collect()
    assert {r.jsonPayload_json: r.error for r in found} == cases


def test_a_task_takes_little_of_what_it_sorts(spark):
    """Rows are many times their compressed size when they are sorted, so the package asks for small tasks."""
    for name in config.SIZE_CONF:
        assert spark.conf.get(name) == "16m"


def test_base_rows_of_a_batch_need_no_exchange(spark):
    """Raw files are split by day already; carrying a batch on stores its base rows beside those of others."""
    root = tables.work_dir(spark, "beside")
    for batch, day in (("one", "05"), ("two", "06")):
        raw = ingest.raw_rows(messages(spark, envelope(batch, f"2024-01-{day}T10:00:00Z")), "demo")
        rows = raw.withColumns({"day": F.to_date("timestamp"), "batch": F.lit(batch)}).localCheckpoint()
        assert "Exchange" not in tables._base_rows(rows)._jdf.queryExecution().executedPlan().toString()
        tables.add_base(rows, tables.base_path(root))
    assert {r.insertId for r in tables.read_base(spark, tables.base_path(root)).collect()} == {"one", "two"}
