"""Carry new or changed raw rows on to the base table, the stored views and the general-access copy."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.config import USER_EMAIL
from tallybeam.operators import checks, incremental
from tallybeam.operators.base_view import GENERAL_ACCESS
from tallybeam.sources import commits, folders, tables
from tallybeam.streaming import quota


def derived(base: DataFrame) -> dict[str, DataFrame]:
    """What each stored view keeps of base rows, by the name of its folder."""
    kept = {f"incremental/{name}": incremental.partial(name, base) for name in incremental.ROLLUPS}
    return kept | {"quota_minutes": quota.minute_counts(base), "ingest_lag": checks.lag_partial(base)}


def derived_by_batch(base: DataFrame) -> dict[str, DataFrame]:
    """The same for rows of many batches, each batch by itself: the batch goes along with the user, which is a key of all."""
    user = F.struct(F.col(USER_EMAIL).alias("email"), F.col("batch").alias("of_batch"))
    tagged = base.withColumn(USER_EMAIL, user)
    # Minutes have no rows without a user, and the pair is never null.
    found = derived(tagged) | {"quota_minutes": quota.minute_counts(tagged.filter(f"{USER_EMAIL}.email is not null"))}
    by_user = {
        name: rows.withColumn("batch", F.col(f"{USER_EMAIL}.of_batch")).withColumn(USER_EMAIL, F.col(f"{USER_EMAIL}.email"))
        for name, rows in found.items()
        if USER_EMAIL in rows.columns
    }
    return by_user | {"ingest_lag": checks.lag_partial(base, "batch")}


def keep_general_copy(spark: SparkSession, root: str) -> None:
    """Begin the general-access copy of a log. From now on batches, repairs, erasure and retention carry it along."""
    tables.write_base(tables.read_raw(spark, root), tables.general_path(root), **GENERAL_ACCESS)


def write_together(found: dict[str, DataFrame], aside: str) -> None:
    """Stage small tables side by side; one after the other, each would leave most of a cluster idle."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for written in [pool.submit(tables.write_folders, rows, f"{aside}/{table}") for table, rows in found.items()]:
            written.result()


AT_ONCE = 5


def _staged(spark: SparkSession, root: str, aside: str, raw: DataFrame) -> None:
    """Stage base rows, and the general-access copy where there is one."""
    tables.add_base(raw, tables.base_path(aside))
    if folders.exists(spark, tables.general_path(root)):
        tables.add_base(raw, tables.general_path(aside), **GENERAL_ACCESS)


def refresh_batch(spark: SparkSession, root: str, batch: str) -> None:
    """Base rows and partial aggregates of one ingest batch, in place of those it had before, as one commit.

    Days that were compacted with rows of the batch are refreshed as a whole.
    """
    name = f"refresh.{batch}"
    aside = commits.begin(spark, root, name)
    _staged(spark, root, aside, tables.read_raw(spark, root).filter(F.col("batch") == batch))
    found = derived(tables.read_base(spark, tables.base_path(aside)))
    write_together({table: rows.withColumn("batch", F.lit(batch)) for table, rows in found.items()}, aside)
    moves: commits.Moves = []
    for table in ("base", "general", *found):
        if table != "general":
            folders.make(spark, f"{root}/{table}")
        moves += commits.replacing(spark, root, aside, table, batch)
    commits.commit(spark, root, name, moves)
    merged = tables.merged_days(spark, root, batch)
    if merged:
        refresh_days(spark, root, merged)


def refresh_days(spark: SparkSession, root: str, days: list[date | None]) -> None:
    """Base rows and partial aggregates of whole days, after their raw rows were compacted or erased, as one commit."""
    if not days or not folders.exists(spark, tables.base_path(root)):
        return
    name = "refresh.days"
    aside = commits.begin(spark, root, name)
    _staged(spark, root, aside, tables.read_raw(spark, root).filter(tables.of_days(days)))
    found = derived_by_batch(tables.read_base(spark, tables.base_path(aside)))
    write_together({table: rows for table, rows in found.items() if folders.exists(spark, f"{root}/{table}")}, aside)
    moves: commits.Moves = []
    for table in ("base", "general", *found):
        if folders.exists(spark, f"{root}/{table}"):
            moves += commits.whole_days(spark, aside, table, [tables.day_folder(day) for day in days])
    commits.commit(spark, root, name, moves)
