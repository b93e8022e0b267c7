"""Build every output over a base view and check that all of them exist."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybeam.config import USER_EMAIL, USER_PSEUDONYM
from tallybeam.functions.timex import AsOf, as_datetime
from tallybeam.operators import rollups, views
from tallybeam.operators.base_view import with_pseudonyms
from tallybeam.operators.error_summary import error_429_summary

VIEW, TABLE = "view", "table"


@dataclass(frozen=True)
class Output:
    """A named output: a function of (base view, as_of, user column), and for a table the job that stores it."""

    name: str
    kind: str
    build: Callable[[DataFrame, AsOf, str], DataFrame]
    store: Callable[[DataFrame, str, AsOf, str], None] | None = None
    read: Callable[[SparkSession, str], DataFrame] | None = None


def _view(name: str, function) -> Output:
    return Output(name, VIEW, lambda av, as_of, user: function(av, user))


def _table(name: str, function, store, read) -> Output:
    return Output(name, TABLE, lambda av, as_of, user: function(av, as_of, user), store, read)


def _store_alerts(av: DataFrame, path: str, as_of: AsOf, user: str) -> None:
    rollups.run_quota_alerts(av, path, as_of, run=f"at-{as_datetime(as_of):%Y%m%dT%H%M%S}", user_col=user)


# The published names of the sixteen outputs, in build order.
OUTPUTS = (
    _view("daily_metrics", views.daily_metrics),
    _view("vw_user_activity", views.user_activity),
    _view("vw_error_analysis", views.error_analysis),
    _view("vw_tool_performance", views.tool_performance),
    _view("vw_cli_performance_and_resilience", views.cli_resilience),
    _view("vw_model_routing_analysis", views.model_routing_analysis),
    _view("vw_token_usage", views.token_usage),
    _view("vw_malformed_json_responses", views.malformed_json_responses),
    _view("vw_feature_adoption", views.feature_adoption),
    _view("vw_conversation_analysis", views.conversation_analysis),
    _view("vw_quota_tracking", views.quota_tracking),
    _view("vw_user_configuration", views.user_configuration),
    _view("vw_429_error_summary", error_429_summary),
    _table("daily_rollup_table", rollups.daily_rollup, rollups.run_daily_rollup, rollups.read_daily_rollup),
    _table("quota_alerts_table", rollups.quota_alerts, _store_alerts, rollups.read_alerts),
    _table("weekly_rollup_table", rollups.weekly_rollup, rollups.run_weekly_rollup, rollups.read_weekly_rollup),
)

_REPORT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def build_all(
    spark: SparkSession,
    av: DataFrame,
    as_of: AsOf,
    pseudonymize: bool = False,
    outputs: tuple[Output, ...] = OUTPUTS,
    table_root: str | None = None,
) -> DataFrame:
    """Register every output by name; one that fails is reported and does not stop the rest.

    Views are temporary views. With ``table_root`` each scheduled table adds the run of ``as_of`` to what it holds below
    that folder and is registered as a catalog table over it; else it is a view of that run alone. A view is ``created``
    when it is registered; that does not run it. A table has been run.
    """
    user_col = USER_PSEUDONYM if pseudonymize else USER_EMAIL
    source = with_pseudonyms(av) if pseudonymize else av
    source.createOrReplaceTempView("analytics_view")
    report = []
    for output in outputs:
        try:
            if output.store and table_root:
                path = f"{table_root}/{output.name}"
                output.store(source, path, as_of, user_col)
                _register(spark, output.name, output.read(spark, path), path)
            else:
                output.build(source, as_of, user_col).createOrReplaceTempView(output.name)
            report.append((output.name, kind_of(spark, output.name), "created", None))
        except Exception as failure:  # noqa: BLE001 - reported, and the next output is built
            report.append((output.name, None, "failed", str(failure).splitlines()[0]))
    return spark.createDataFrame(report, _REPORT)


# Partition columns of the scheduled tables.
_PARTITIONS = ("day", "week_start_date", "alert_date", "run")


def _register(spark: SparkSession, name: str, frame: DataFrame, path: str) -> None:
    """A catalog table over stored files, in place of what has the name."""
    spark.catalog.dropTempView(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    columns = ", ".join(f"`{c}` {kind}" for c, kind in frame.dtypes)
    partitions = ", ".join(c for c in frame.columns if c in _PARTITIONS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({partitions}) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def kind_of(spark: SparkSession, name: str) -> str | None:
    """What the catalog holds under a name: a table with files, a view, or nothing."""
    if not spark.catalog.tableExists(name):
        return None
    found = spark.catalog.getTable(name)
    return VIEW if found.isTemporary or found.tableType == "VIEW" else TABLE


def catalog_check(spark: SparkSession, outputs: tuple[Output, ...] = OUTPUTS) -> DataFrame:
    """Which outputs exist, as what the catalog says, and how many rows each gives."""
    kinds = {o.name: kind_of(spark, o.name) for o in outputs}
    counts = None
    for output in outputs:
        rows = (
            spark.table(output.name).agg(F.count("*").alias("row_count"))
            if kinds[output.name]
            else spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        )
        line = rows.select(
            F.lit(output.name).alias("name"),
            F.lit(kinds[output.name]).cast("string").alias("kind"),
            F.lit(kinds[output.name] is not None).alias("present"),
            "row_count",
        )
        counts = line if counts is None else counts.unionByName(line)
    return counts
