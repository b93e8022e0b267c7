"""Exact de-duplication by salted digests that compares whole texts at every stage.

Three combining stages: rows of one task (Spark's partial aggregate), then groups of one digest and salt, then the salt
winners of a digest. The grouping keys hold the text itself beside its digest, so equality is always that of the content.
The salt is the task that read the row, so a text that makes up a third of the table reaches any later task as one row for
each earlier task, divided by the salts.

Null text is empty text. A null ``doc_id`` loses against any id. Rows that repeat a ``doc_id`` and its text are one
document and share its fate in :func:`decisions`; :func:`survivors` returns one row of them. An empty table gives an
empty result. Other columns are carried by :func:`survivors` and ignored by :func:`decisions`; of rows that agree in id and
text the one with the largest other columns stays, where maps and other types without an order compare as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybeam.llm.shared import stored, text_or_empty

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _combined(rows: DataFrame, salts: int, carried: bool = False) -> DataFrame:
    """One row for each distinct text, ``digest, text, best, group_size``, partitioned by digest.

    ``best`` of ``rows`` decides; with ``carried`` a column of that name, of any type, goes along with the largest.
    """
    largest = [F.max("best").alias("best")]
    if carried:
        largest.append(F.max_by("carried", "best").alias("carried"))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    by_salt = salted.groupBy("digest", "salt", "text").agg(*largest, F.count("*").alias("n"))
    winners = by_salt.drop("salt").repartition("digest")
    return winners.groupBy("digest", "text").agg(*largest, F.sum("n").alias("group_size"))


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def survivors(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The row with the largest ``doc_id`` of each text, with all columns of ``docs``."""
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    plain, rest = [f.name for f in others if _ordered(f.dataType)], [f.name for f in others if not _ordered(f.dataType)]
    column = lambda name: F.col(f"`{name}`")
    content = text_or_empty()
    # The text is the grouping key, so of the row only the rest and whether the text was null is carried.
    own = [F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("given"), *[column(c).alias(f"c{k}") for k, c in enumerate(plain)]]
    written = [F.to_json(F.struct(column(c).alias("v"))).alias(f"r{k}") for k, c in enumerate(rest)]
    carried = [F.struct(*[column(c).alias(f"r{k}") for k, c in enumerate(rest)]).alias("carried")] if rest else []
    rows = docs.select(sha256(content).alias("digest"), content.alias("text"), F.struct(*own, *written).alias("best"), *carried)
    best = _combined(rows, salts, bool(rest))
    columns = {"doc_id": F.col("best.id"), "text": F.when(F.col("best.given"), F.col("text"))}
    columns |= {c: F.col(f"best.c{k}") for k, c in enumerate(plain)} | {c: F.col(f"carried.r{k}") for k, c in enumerate(rest)}
    return best.select(*[columns[c].alias(c) for c in docs.columns])


def decisions(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows find their group by digest alone where all rows with the digest had one content. Contents that share a digest
    (``digest`` may be a weaker function than SHA-256) are told apart by the text again.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
    combined = _combined(rows.withColumn("best", F.col("doc_id")), salts)
    # A digest has one content but for collisions, so this window sees one row at a time; rows are already in place.
    contents = combined.withColumn("contents", F.count("*").over(Window.partitionBy("digest"))).select(
        "digest", F.col("best").alias("keep_id"), "group_size", F.when(F.col("contents") > 1, F.col("text")).alias("only_text")
    )
    groups = stored(contents, "exact-groups")
    plain, shared = groups.filter("only_text is null").drop("only_text"), groups.filter("only_text is not null")
    found = rows.select("doc_id", "digest", sha256(F.col("text")).alias("text_sha256")).join(plain, "digest")
    if not shared.isEmpty():
        again = rows.join(shared.withColumnRenamed("only_text", "text"), ["digest", "text"])
        found = found.unionByName(again.select(*[sha256(F.col("text")).alias(c) if c == "text_sha256" else F.col(c) for c in found.columns]))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, "text_sha256")
