"""Shards of about equal bytes by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are one group and never part. Groups enter, largest first, the shard with the least capacity
left that still holds them, found in a balanced tree. Groups of one size are alike, so the plan is made on how many groups
have each size: the tightest shard takes as many of them as fit, as it would one by one. Groups then find their shard by
rank within their size, and documents theirs by the digest of the text.

:func:`by_capacity` uses as few shards of a given capacity as that finds. :func:`even` has a given number of shards and takes
the smallest capacity for which they suffice; a group that exceeds its share of what is left has a shard to itself first.

Only the histogram reaches the driver: sizes that differ add up to the bytes of the table, so there are at most the square
root of twice that many of them, far fewer in practice. A text that makes up a third of the table is one row for each
task and digest until documents look up their shard; those of texts with more than a thousandth of all rows look it up
in a broadcast table of at most a thousand rows. Ranks and slots are counted by the task that wrote the rows.

Null text counts as empty. Null and repeated ids are rows like others, other columns are ignored, an empty table gives no
rows. Texts are told apart by SHA-256 and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybeam.llm.shared import stored, text_or_empty

HOT_SHARE = 1000  # a text with more than this part of the rows looks up its shard in a broadcast table
STRETCH = 1024


class SpaceTree:
    """Shards by the capacity they have left, in a treap: the tightest that holds a size takes logarithmic time."""

    @dataclass(slots=True)
    class Node:
        key: tuple[int, int]
        weight: int
        low: SpaceTree.Node | None = None
        high: SpaceTree.Node | None = None

    def __init__(self) -> None:
        self.root: SpaceTree.Node | None = None

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        mixed = (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        return (mixed ^ mixed >> 29) * 0x94D049BB133111EB & (2**64 - 1)

    def _split(self, node: Node | None, key: tuple[int, int]) -> tuple[Node | None, Node | None]:
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.high, rest = self._split(node.high, key)
            return node, rest
        rest, node.low = self._split(node.low, key)
        return rest, node

    def _merge(self, low: Node | None, high: Node | None) -> Node | None:
        if low is None or high is None:
            return low or high
        if low.weight > high.weight:
            low.high = self._merge(low.high, high)
            return low
        high.low = self._merge(low, high.low)
        return high

    def add(self, space: int, shard: int) -> None:
        key = space, shard
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, self.Node(key, self._weight(key))), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the shard with the least space of ``size`` or more (of equal ones the first)."""
        node, found = self.root, None
        while node is not None:
            if node.key >= (size, -1):
                node, found = node.low, node.key
            else:
                node = node.high
        if found is not None:
            low, rest = self._split(self.root, found)
            _, high = self._split(rest, (found[0], found[1] + 1))
            self.root = self._merge(low, high)
        return found


Run = tuple[int, int, int, int]  # size, rank of the first group, groups, shard


@dataclass
class Plan:
    """Shards numbered from ``first``, filled one size after another."""

    capacity: int
    first: int = 0
    shards: int = 0
    runs: list[Run] = field(default_factory=list)

    @classmethod
    def fill(cls, sizes: Iterable[tuple[int, int, int]], capacity: int, first: int = 0, most: int | None = None) -> Plan | None:
        """Best fit of ``(size, rank of the first group, groups)``, sizes falling; None if more than ``most`` are needed.

        A group above the capacity gets a shard of its own.
        """
        plan, open_shards = cls(capacity, first), SpaceTree()
        for size, rank, left in sizes:
            while left:
                found = open_shards.take_tightest(size)
                if found is None:
                    if plan.shards == most:
                        return None
                    found = max(capacity, size), first + plan.shards
                    plan.shards += 1
                space, shard = found
                taken = min(left, space // size)
                plan.runs.append((size, rank, taken, shard))
                rank, left = rank + taken, left - taken
                if space - taken * size:
                    open_shards.add(space - taken * size, shard)
        return plan


def even_plan(histogram: dict[int, int], shards: int) -> list[Run]:
    """Runs of an even filling of a number of shards."""
    sizes = [[size, 0, histogram[size]] for size in sorted(histogram, reverse=True)]
    total = sum(size * groups for size, _, groups in sizes)
    runs: list[Run] = []
    alone = 0
    # The largest group, while it has more than an even share of what is left, is a shard.
    while sizes and alone < shards - 1 and sizes[0][0] * (shards - alone) > total:
        size, rank, groups = sizes[0]
        runs.append((size, rank, 1, alone))
        alone, total = alone + 1, total - size
        sizes[0] = [size, rank + 1, groups - 1]
        if groups == 1:
            sizes.pop(0)
    if not sizes:
        return runs
    least = max(sizes[0][0], -(-total // (shards - alone)))
    # Capacities that don't suffice, then those that do: steps double until one does, then halve.
    step, plan = 1, Plan.fill(sizes, least, alone, shards - alone)
    low = least
    while plan is None:
        low, least = least, least + step
        step *= 2
        plan = Plan.fill(sizes, least, alone, shards - alone)
    while least - low > 1:
        middle = (low + least) // 2
        better = Plan.fill(sizes, middle, alone, shards - alone)
        if better is None:
            low = middle
        else:
            least, plan = middle, better
    return runs + plan.runs


def with_task(rows: DataFrame, name: str) -> DataFrame:
    """Rows stored with the task that wrote them and their place in it."""
    placed = rows.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    return stored(placed, name)


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` of :func:`with_task` with their rank (from 0) within ``key``, as column ``name``.

    A key's rows stay with the tasks that wrote them; only the counts by task are added up in order.
    """
    counts = rows.groupBy(key, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(key, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy(key, "task").orderBy("place")) - 1
    return rows.withColumn("within", within).join(earlier, [key, "task"]).withColumn(
        name, F.col("within") + F.col("earlier")
    ).drop("within", "earlier")


def sized(docs: DataFrame) -> DataFrame:
    """Size, checksum and digest of each document's text, stored."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    return with_task(rows, "sharding-sizes")


def group_totals(rows: DataFrame) -> DataFrame:
    """One row a text: ``digest, size, n`` and the bytes of all its documents."""
    groups = rows.groupBy("digest", "size").agg(F.count("*").alias("n"))
    return with_task(groups.withColumn("total", F.col("n") * F.col("size")), "sharding-groups")


def histogram_of(groups: DataFrame) -> dict[int, int]:
    return {r["total"]: r["count"] for r in groups.groupBy("total").count().toLocalIterator()}


def placed_groups(groups: DataFrame, runs: list[Run]) -> DataFrame:
    """Groups with their ``shard``, stored: each takes the place of its rank within its size."""
    spark = groups.sparkSession
    plan = spark.createDataFrame(runs, "total long, first_rank long, groups long, shard int")
    # A run joins on its size and every stretch of ranks that it touches, so the join is on equal keys.
    first, last = (F.floor(x / STRETCH) for x in (F.col("first_rank"), F.col("first_rank") + F.col("groups") - 1))
    places = plan.withColumn("stretch", F.explode(F.sequence(first, last)))
    found = ranked(groups, "total", "rank").withColumn("stretch", F.floor(F.col("rank") / STRETCH)).join(places, ["total", "stretch"])
    return stored(found.filter("rank >= first_rank and rank < first_rank + groups").select("digest", "size", "n", "shard"), "sharding-plan")


def with_shard(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each document with the shard of its text."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    common = groups.filter(hot).select("digest", "size", F.col("shard").alias("hot_shard"))  # fewer than HOT_SHARE rows
    known = rows.join(F.broadcast(common), ["digest", "size"], "left")
    others = known.filter("hot_shard is null").drop("hot_shard").join(groups.filter(~hot).select("digest", "size", "shard"), ["digest", "size"])
    return known.filter("hot_shard is not null").withColumnRenamed("hot_shard", "shard").unionByName(others)


RESULT = ("doc_id", "size", "text_crc32", "shard", "slot")


def _sharded(docs: DataFrame, plan: Callable[[dict[int, int]], list[Run]]) -> DataFrame:
    rows = sized(docs)
    groups = group_totals(rows)
    placed = with_shard(rows, placed_groups(groups, plan(histogram_of(groups))))
    numbered = with_task(placed.drop("task", "place", "digest"), "sharding-placed")
    return ranked(numbered, "shard", "slot").select(*RESULT)


def by_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """Documents in as few shards of ``capacity`` bytes as best fit finds: the RESULT columns."""

    def plan(histogram: dict[int, int]) -> list[Run]:
        return Plan.fill([(size, 0, histogram[size]) for size in sorted(histogram, reverse=True)], capacity).runs

    return _sharded(docs, plan)


def even(docs: DataFrame, shards: int) -> DataFrame:
    """Documents in ``shards`` shards of bytes as near equal as best fit finds: the RESULT columns."""
    return _sharded(docs, lambda histogram: even_plan(histogram, shards))
