"""Test events as log envelopes with the noise a log stream has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.flat import FLAT_SQL
from tallybeam import config
from tallybeam.sources import tables
from tallybeam.sources.envelopes import read_envelopes

PROJECT = "demo"

# Payload key for each flat column; a NULL column leaves its key out.
PAYLOAD = {
    "event.name": "event_name", "session.id": "session_id", "installation.id": "installation_id",
    "user.email": "user_email", "model": "model", "input_token_count": "input_tokens",
    "output_token_count": "output_tokens", "cached_content_token_count": "cached_tokens",
    "thoughts_token_count": "thoughts_tokens", "tool_token_count": "tool_tokens",
    "total_token_count": "total_tokens", "gen_ai.request.temperature": "temperature",
    "gen_ai.request.top_p": "top_p", "gen_ai.request.top_k": "top_k",
    "gen_ai.request.max_tokens": "max_output_tokens", "gen_ai.response.finish_reasons": "finish_reason",
    "gen_ai.usage.input_tokens": "gen_ai_input_tokens", "gen_ai.usage.output_tokens": "gen_ai_output_tokens",
    "status_code": "status_code", "error.type": "error_code", "error.message": "error_message",
    "error": "error", "duration_ms": "duration_ms", "function_name": "function_name",
    "function_args": "function_args", "success": "function_success", "tool_type": "tool_type",
    "mcp_server_name": "mcp_server_name", "decision_source": "decision_source",
    "decision_model": "decision_model", "failed": "failed", "routing_latency_ms": "routing_latency_ms",
    "tokens_before": "tokens_before", "tokens_after": "tokens_after", "approvalMode": "approval_mode",
    "turnCount": "turn_count", "sandbox_enabled": "sandbox_enabled",
    "log_user_prompts_enabled": "log_user_prompts_enabled", "output_format": "output_format",
    "extensions": "extensions", "extension_count": "extension_count",
    "gen_ai.output.messages": "output_messages",
}


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(spark.read.parquet(f"{sf_dir}/events.parquet"))


def flatten(events: DataFrame) -> DataFrame:
    events.createOrReplaceTempView("flat_source_events")
    return events.sparkSession.sql(FLAT_SQL.replace("FROM events", "FROM flat_source_events"))


def _instant(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _payload() -> Column:
    event, number = F.col("event_name"), F.col("event_id")
    # Values that are not scalars must read as NULL; they share a key with the scalar case.
    nested = [
        F.when((event == config.API_RESPONSE) & (number % 9 != 0), F.array(F.lit("STOP"))).alias(
            "gen_ai.response.finish_reasons"
        ),
        F.when((event == config.API_ERROR) & (number % 3 == 0), F.struct(number.alias("code"))).alias("error"),
        F.when((event == config.CONFIG) & (number % 12 == 0), F.array(F.lit("ext-a"))).alias("extensions"),
    ]
    return F.struct(*[F.col(c).alias(k) for k, c in PAYLOAD.items()], *nested)


def envelopes(flat: DataFrame) -> DataFrame:
    """One ``value`` per message: every event once, plus redelivered, broken and foreign messages."""
    return numbered_envelopes(flat).select("value")


def numbered_envelopes(flat: DataFrame) -> DataFrame:
    """As :func:`envelopes`, with ``copy``, the number of the message among those of its event."""
    number = F.col("event_id")
    clean = F.to_json(F.struct(
        _instant(F.col("ts")).alias("timestamp"),
        _instant(F.col("ts") + F.make_dt_interval(secs=number % 90)).alias("receiveTimestamp"),
        F.lit(config.log_name(PROJECT)).alias("logName"),
        F.col("insert_id").alias("insertId"),
        "severity",
        "trace",
        F.struct(
            F.lit("global").alias("type"), F.struct(F.col("resource_project_id").alias("project_id")).alias("labels")
        ).alias("resource"),
        F.when(F.col("cli_version").isNotNull(), F.struct("cli_version")).alias("labels"),
        F.when(F.col("operation_id").isNotNull(), F.struct(F.col("operation_id").alias("id"))).alias("operation"),
        _payload().alias("jsonPayload"),
    ))
    text = F.col("clean")

    def renamed(prefix: str) -> Column:
        return F.replace(text, F.lit('"insertId":"'), F.lit(f'"insertId":"{prefix}'))

    diagnostic = F.replace(
        renamed("diag-"), F.lit('"jsonPayload":{'), F.lit(f'"jsonPayload":{{"{config.DIAGNOSTIC_KEY}":{{"code":1}},')
    )
    foreign = F.replace(renamed("other-"), F.lit(f"logs/{config.LOG_ID}"), F.lit("logs/other"))
    copies = F.array(
        text,
        F.when(number % 97 == 0, text),
        F.when(number % 101 == 0, F.substring(text, F.lit(1), F.length(text) - F.lit(5))),
        F.when(number % 211 == 0, F.concat(text, F.lit(" trailing"))),
        F.when(number % 103 == 0, diagnostic),
        F.when(number % 107 == 0, foreign),
    )
    return (
        flat.select("event_id", clean.alias("clean"))
        .select(F.posexplode(F.array_compact(copies)).alias("copy", "value"))
    )


def audit_envelopes(flat: DataFrame) -> DataFrame:
    """Audit-log entries about sink changes, some of them failed, derived from the events."""
    number = F.col("event_id")
    method = F.when(number % 3 == 0, config.AUDIT_METHODS[0]).when(number % 3 == 1, config.AUDIT_METHODS[1])
    entry = F.struct(
        _instant(F.col("ts")).alias("timestamp"),
        F.lit(f"projects/{PROJECT}/{config.AUDIT_LOG}%2Factivity").alias("logName"),
        F.col("insert_id").alias("insertId"),
        F.struct(
            F.when(number % 11 != 0, config.AUDIT_SERVICE).otherwise("other.service").alias("serviceName"),
            F.coalesce(method, F.lit("ListSinks")).alias("methodName"),
            F.struct((number % 4).alias("code")).alias("status"),
        ).alias("protoPayload"),
    )
    return flat.select(F.to_json(entry).alias("value"))


# Roots already prepared, by application and input folder. Each holds written tables only.
_PREPARED: dict[tuple[str, str, str], str] = {}


def prepared(spark: SparkSession, sf_dir: str, kind: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _PREPARED:
        path = tables.work_dir(spark, kind)
        build(path)
        _PREPARED[key] = path
    return _PREPARED[key]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_envelopes(spark, messages_path(spark, sf_dir))


def messages_path(spark: SparkSession, sf_dir: str) -> str:
    def build(path: str) -> None:
        envelopes(flat_events(spark, sf_dir)).write.text(path)

    return prepared(spark, sf_dir, "messages", build)


def deliveries(spark: SparkSession, sf_dir: str, batches: int) -> list[DataFrame]:
    """The messages dealt to batches, each message to one. Copies of an event's message are dealt by their number as well, so
    that most redeliveries come in another batch than the first copy and some in the same."""
    by_number = F.pmod(F.xxhash64("value", "copy"), F.lit(batches)).cast("int").alias("delivery")

    def build(path: str) -> None:
        dealt = numbered_envelopes(flat_events(spark, sf_dir)).select("value", by_number)
        name = "spark.sql.maxConcurrentOutputFileWriters"  # a file for each batch is open at once, so tasks needn't sort texts
        before = spark.conf.get(name)
        spark.conf.set(name, str(batches))
        try:
            dealt.write.partitionBy("delivery").text(path)
        finally:
            spark.conf.set(name, before)

    path = prepared(spark, sf_dir, f"deliveries-{batches}", build)
    found = spark.read.schema("value string, delivery int").text(path)
    return [found.filter(F.col("delivery") == k).select("value") for k in range(batches)]


def audit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(path: str) -> None:
        audit_envelopes(flat_events(spark, sf_dir)).write.text(path)

    return read_envelopes(spark, prepared(spark, sf_dir, "audit", build))


def store(spark: SparkSession, sf_dir: str) -> str:
    """Root of the ingested log and its base table."""

    def build(root: str) -> None:
        source = messages(spark, sf_dir)
        tables.ingest_batch(source, root, PROJECT, ingest_ts="2024-01-31 00:00:00")
        tables.write_base(tables.read_raw(spark, root), tables.base_path(root))

    return prepared(spark, sf_dir, "store", build)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_raw(spark, store(spark, sf_dir))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_base(spark, tables.base_path(store(spark, sf_dir)))
