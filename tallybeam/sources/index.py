"""Small tables beside the log: which message ids, and which users, a batch has on which days.

Both are written with the batch they belong to, in the same commit, so they are never behind the raw table.

``ids`` holds ``id_hash, insertId``, sorted by hash. A new batch is compared by hash first, eight bytes an id; the id itself
is read only from files in which a hash was found. ``users`` holds the pseudonyms that have rows, and null where rows
have no user, so every day of a batch is listed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybeam.functions.identity import pseudonym
from tallybeam.functions.jsonx import json_scalar
from tallybeam.operators.base_view import EMAIL_KEY
from tallybeam.sources import folders

IDS, USERS = "ids", "users"
IDS_SCHEMA = "id_hash bigint, insertId string, day date, batch string"
USERS_SCHEMA = "user_pseudonym string, day date, batch string"


def paths(root: str) -> list[str]:
    return [f"{root}/{IDS}", f"{root}/{USERS}"]


def email_of(raw_payload: Column) -> Column:
    return json_scalar(raw_payload, f"$['{EMAIL_KEY}']")


def write(spark: SparkSession, raw: DataFrame, root: str, skip: list[date | None] = ()) -> None:
    """Index raw rows that have a day and a batch, but for some days."""
    if skip:
        listed = F.coalesce(F.col("day").isin([d for d in skip if d is not None]), F.lit(False))
        raw = raw.filter(~(listed | F.col("day").isNull() if None in skip else listed))
    ids = raw.filter("insertId is not null").select(F.xxhash64("insertId").alias("id_hash"), "insertId", "day", "batch")
    email = email_of(F.col("jsonPayload_json"))
    users = raw.select(F.when(email.isNotNull(), pseudonym(email)).alias("user_pseudonym"), "day", "batch").distinct()

    def store(rows: DataFrame, table: str, key: str) -> None:
        folders.make(spark, f"{root}/{table}")
        rows.sortWithinPartitions("day", "batch", key).write.mode("append").partitionBy("day", "batch").parquet(f"{root}/{table}")

    # Raw files are split by day already, so ids need no exchange; users are few. Both jobs are short, so they run together.
    # With a number Spark keeps the tasks apart, which else become one that writes a small file for each day in turn.
    days = len(folders.partition_values(spark, f"{root}/log/tier=raw", "day"))
    tasks = max(1, min(days, spark.sparkContext.defaultParallelism))
    with ThreadPoolExecutor(2) as pool:
        written = [
            pool.submit(store, ids, IDS, "id_hash"),
            pool.submit(store, users.repartition(tasks, "day"), USERS, "user_pseudonym"),
        ]
        for job in written:
            job.result()


def read_ids(spark: SparkSession, root: str, *parts: str) -> DataFrame:
    """The whole id index, or some of its folders or files."""
    path = f"{root}/{IDS}"
    return spark.read.schema(IDS_SCHEMA).option("basePath", path).parquet(*(parts or [path]))


def read_users(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(USERS_SCHEMA).parquet(f"{root}/{USERS}")


def hits(spark: SparkSession, root: str, batch: str, rows: DataFrame, days: list[str]) -> DataFrame | None:
    """Rows whose hashed id another batch has on their day, with the index file that says so; None if nothing is indexed."""
    parts = [part for day in days if folders.exists(spark, part := f"{root}/{IDS}/day={day}")]
    if not parts:
        return None
    other = read_ids(spark, root, *parts).filter(F.col("batch") != batch)
    other = other.select(F.col("day").alias("day_of_hash"), F.col("id_hash").alias("hash"), F.col("_metadata.file_path").alias("file"))
    new = rows.filter("insertId is not null").select("day", "insertId")
    same = F.col("day").eqNullSafe(F.col("day_of_hash")) & (F.xxhash64("insertId") == F.col("hash"))
    return new.join(other, same).select("day", "insertId", "file")


def redelivered(spark: SparkSession, root: str, batch: str, rows: DataFrame, days: list[str]) -> DataFrame | None:
    """``day, insertId`` of rows that other batches have; None if there is none. ``days`` are names of day folders."""
    found = hits(spark, root, batch, rows, days)
    if found is None:
        return None
    # Names of files only, of the days at hand.
    files = [unquote(r.file) for r in found.select("file").distinct().collect()]
    if not files:
        return None
    stored = read_ids(spark, root, *files).select(F.col("day").alias("stored_day"), F.col("insertId").alias("stored_id"))
    same = F.col("day").eqNullSafe(F.col("stored_day")) & (F.col("insertId") == F.col("stored_id"))
    return found.select("day", "insertId").distinct().join(stored, same, "left_semi")


def user_days(spark: SparkSession, root: str, email: str) -> list[date | None]:
    """Days on which indexed batches have rows of a user. One row a day reaches the driver, bounded by the retention."""
    if not folders.exists(spark, f"{root}/{USERS}"):
        return []
    own = read_users(spark, root).filter(F.col("user_pseudonym") == pseudonym(F.lit(email)))
    return [r.day for r in own.select("day").distinct().collect()]


def not_indexed(spark: SparkSession, root: str, raw_path: str) -> list[str]:
    """``<day>/batch=<id>`` of raw folders that the user index lacks: rows from before there was one."""
    raw, indexed = (
        {p.rpartition("/day=")[2] for p in folders.matching(spark, f"{path}/day=*/batch=*")}
        for path in (raw_path, f"{root}/{USERS}")
    )
    return sorted(raw - indexed)
