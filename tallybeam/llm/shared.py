"""Helpers of the text operators: stored intermediate tables, document groups, packed exchange between groups.

Documents are rows with ``doc_id`` and ``text``; operators select these two first, so other columns never clash.
A null ``doc_id`` stands for the smallest id while an operator works (``NO_ID``) and is null again in its result.
"""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)
GROUP_BYTES = 8 << 20

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _FALLBACK:
        _FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="tallybeam-")
    return _FALLBACK[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so that later steps don't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/tallybeam/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python a thousand rows at a time: a batch of the default ten thousand takes tens of megabytes, in the
    JVM and in each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no frame has."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_or_least(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def hashed_sample(docs: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashed ids.

    Rows are thinned by another hash to about four times the sample first, so that each task sends a few.
    """
    thin = max(1, docs.count() // (4 * size))
    few = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(thin)) == 0)
    return few.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def in_groups(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int]:
    """Documents as ``id, text, g`` partitioned by ``g``, and the number of groups.

    Groups follow the hash of the id and hold about ``group_bytes`` of text, so one group fits a Python task at any
    input size. Rows without an id, which may be many, follow the hash of their text as well. The exchange is the same wherever the frame is used in one query, so Spark writes it once.
    """
    groups = max(1, math.ceil(text_bytes(docs) / group_bytes))
    rows = docs.select(id_or_least().alias("id"), text_or_empty().alias("text"))
    spread = F.when(F.col("id") == NO_ID, F.xxhash64("text"))  # null, which changes no hash, where there is an id
    return rows.withColumn("g", F.pmod(F.xxhash64("id", spread), F.lit(groups)).cast("int")).repartition("g"), groups


def pack(*values, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(values, 5))


def unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


FAN_IN = 32  # blobs that one task of a tree adds up


def added_up(parts: DataFrame, tasks: int, fan_in: int = FAN_IN) -> tuple | None:
    """The sum, entry by entry, of packed tuples in the column ``blob``; None if there are none.

    ``tasks`` is about how many there are. Tasks add up ``fan_in`` of them at a time, in a tree, so the driver gets as few.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                total = _added(total, unpack(blob))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*total)], pa.binary())], ["blob"])

    while tasks > fan_in:
        tasks = math.ceil(tasks / fan_in)
        parts = parts.repartition(tasks, F.xxhash64("blob")).mapInArrow(merge, "blob binary")
    total = None
    for row in parts.toLocalIterator():
        total = _added(total, unpack(bytes(row.blob)))
    return total


def _added(total: tuple | None, values: tuple) -> tuple:
    return values if total is None else tuple(a + b for a, b in zip(total, values, strict=True))


def raw_texts(table: pa.Table | pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null is empty."""
    return [t or b"" for t in pc.cast(table.column(column), pa.large_binary()).to_pylist()]


def batches_of(rows: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, or one row."""
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(sizes) else []
        for begin, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(begin, end - begin)


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any bits of them can pick buckets or order."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` tokens, by its start."""
    count = max(len(tokens) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + count]
    return mixed(out)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64)


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``part`` with the positions that have it."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    values, starts = np.unique(part[order], return_index=True)
    for value, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
        yield value, rows


PACKED = "g int, bucket int, blob binary"


def packed(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """Rows of the PACKED schema."""
    g, bucket, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"g": pa.array(g, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})
