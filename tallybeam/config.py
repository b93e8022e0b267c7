"""Names, limits and session settings shared by the whole package."""

from __future__ import annotations

from pyspark.sql import SparkSession

# --- Fixed values of the log format: they must equal what the CLI and the log service write. ---
LOG_ID = "gemini_cli"
DIAGNOSTIC_KEY = "logging.googleapis.com/diagnostic"
AUDIT_LOG = "logs/cloudaudit.googleapis.com"
AUDIT_SERVICE = "logging.googleapis.com"
AUDIT_METHODS = (
    "google.logging.v2.ConfigServiceV2.CreateSink",
    "google.logging.v2.ConfigServiceV2.UpdateSink",
)
INFERENCE_MARKER = "gen_ai.client.inference"
TOOL_CALL_MARKER = "tool_call"

API_RESPONSE = "gemini_cli.api_response"
API_ERROR = "gemini_cli.api_error"
MALFORMED_JSON = "gemini_cli.malformed_json_response"
SLASH_COMMAND = "gemini_cli.slash_command"
AGENT_START = "gemini_cli.agent.start"
EXTENSION_INSTALL = "gemini_cli.extension_install"
CONVERSATION_FINISHED = "gemini_cli.conversation_finished"
FLASH_FALLBACK = "gemini_cli.flash_fallback"
CONTENT_RETRY = "gemini_cli.chat.content_retry"
CONTENT_RETRY_FAILURE = "gemini_cli.chat.content_retry_failure"
CHAT_COMPRESSION = "gemini_cli.chat_compression"
MODEL_ROUTING = "gemini_cli.model_routing"
CONFIG = "gemini_cli.config"

# --- Fixed limits and retention periods of the published rules. ---
RPM_LIMIT = 120
RPD_LIMIT = 2000
RPM_WARNING = 100
RPD_WARNING = 1800
ALERT_LOOKBACK_MINUTES = 10
ERROR_RATE_LIMIT = 0.05
MALFORMED_PER_DAY_LIMIT = 10
ERROR_SAMPLE_ROWS = 250
DEAD_LETTER_RATE_LIMIT = 0.001
LAG_LIMIT_SECONDS = 300
RETENTION_DAYS = {"raw": 90, "daily_rollup": 90, "quota_alerts": 30, "weekly_rollup": 52 * 7}

USER_EMAIL = "user_email"
USER_PSEUDONYM = "user_pseudonym"

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A value of an unexpected JSON type leaves its own field NULL, not the whole record (default).
    "spark.sql.json.enablePartialResults": "true",
    # The JVM does not compile methods of more than 8000 bytes of bytecode. Wide JSON projections
    # exceed that when fused into one stage; below this limit Spark splits them instead, which
    # halves the time to build the base table.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Keep dedup state off the JVM heap: it holds one entry per message of the horizon.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# How much of files or of a shuffle a task takes, unless the application names its own. Rows of JSON text are ten to twenty
# times their compressed size in memory, and raw and base rows are sorted there: with Spark's 128 and 64 MB these sorts spill.
SIZE_CONF = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the package relies on (all dates are UTC dates)."""
    given = spark.sparkContext.getConf()
    for key, value in (SESSION_CONF | {k: v for k, v in SIZE_CONF.items() if not given.contains(k)}).items():
        spark.conf.set(key, value)
    return spark


def log_name(project: str) -> str:
    return f"projects/{project}/logs/{LOG_ID}"
