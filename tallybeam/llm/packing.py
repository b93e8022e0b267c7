"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents become pieces of at most ``size`` tokens. A plan is made from how many pieces have each length: bins are filled
largest length first by best fit, many equal bins at a time, so its cost depends on ``size`` and not on the documents.
A plan row gives a run of ranks of one length the bins that it fills. Pieces then get their rank within their length and
take the slot of that rank by a join. Ranks are counted in blocks (hash of the id), whose offsets come from the block
counts, so a length that a third of the pieces have is spread over many tasks. Pieces of full size need no plan.

Null text is empty text and has the closing id only. Repeated rows are packed each by itself (rows that agree in id and
piece are told apart by nothing, so their slots may swap). Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybeam.llm.shared import batches_of, id_or_least, id_or_null, stored, text_or_empty

SIZE = 2048
BLOCKS = 64
SPECIAL = "<|endoftext|>"  # fixed value: the one special token of the byte-level vocabulary


class Encoder:
    """Ids as the ``tokenizers`` library gives them for a file.

    Where the same vocabulary lies beside it as ranks, ordinary text is encoded from the ranks, which is several times
    faster and gives the same ids; text that holds the special token goes to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ranked = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.ranked is None or SPECIAL in text:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of each document: its ids and a closing 0, cut into ``size`` with a shorter piece first."""
    fields = PIECES + (", ids array<int>" if with_ids else "")

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches_of(rows):
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text), 0], "<u4")
                starts = [0, *range(len(ids) % size or size, len(ids), size)]
                for k, (low, high) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    own = ids[low:high]
                    for column, value in zip(out, (key, k, low, high - low, zlib.crc32(own.tobytes()), own.view("<i4")), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            arrays = [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    return docs.select(id_or_least().alias("id"), text_or_empty().alias("text")).mapInArrow(cut, fields)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best fit, largest length first, over counts.

    Returns runs ``(length, first_rank, ranks, first_bin, offset)``: ``ranks`` pieces of the length, from ``first_rank``,
    take one place each at ``offset`` in bins numbered from ``first_bin`` on.
    """
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free space: runs of bins (first, number)
    spaces: list[int] = []
    made, runs = 0, []

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if not open_bins[space]:
                bisect.insort(spaces, space)
            open_bins[space].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):  # the fullest bins that still have the space
                space = spaces[at]
                first, number = open_bins[space].pop()
                if not open_bins[space]:
                    spaces.pop(at)
                used = min(number, left)
                put(space, first + used, number - used)
            else:
                space, first = size, made
                # Bins of this length alone: as many as hold all that is left.
                used = min(left, -(-left // (size // length)))
                made += used
            runs.append((length, rank, used, first, size - space))
            put(space - length, first, used)
            rank, left = rank + used, left - used
    return runs


RUNS = "length long, first_rank long, ranks long, first_bin long, offset long"


def pack(pieces: DataFrame, size: int = SIZE, blocks: int = BLOCKS) -> DataFrame:
    """``pieces`` (``id, piece, length`` and any others) with ``sequence_id`` and ``offset``.

    Reads ``pieces`` several times: pass a stored frame. Only the counts by length, at most ``size`` of them, and the plan
    made from them pass through the driver.
    """
    spark = pieces.sparkSession
    partial = pieces.filter(F.col("length") < size).withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))
    histogram = {r["length"]: r["count"] for r in partial.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan_bins(histogram, size), RUNS)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = partial.groupBy("length", "block").agg(F.count("*").alias("n")).select(
        "length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")
    )
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "piece")) - 1
    ranked = partial.withColumn("within", within).join(offsets, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("within") + F.col("earlier")).drop("within", "earlier", "block")
    # A run joins on its length and every stretch of ranks that it touches, so the join is on equal keys.
    stretch = 1024
    first, last = (F.floor(x / stretch) for x in (F.col("first_rank"), F.col("first_rank") + F.col("ranks") - 1))
    slots = runs.withColumn("stretch", F.explode(F.sequence(first, last)))
    found = ranked.withColumn("stretch", F.floor(F.col("rank") / stretch)).join(slots, ["length", "stretch"])
    found = found.filter("rank >= first_rank and rank < first_rank + ranks")
    bin_number = F.col("first_bin") + F.col("rank") - F.col("first_rank")
    planned = found.select(*pieces.columns, bin_number.alias("sequence_id"), "offset")
    # A full piece fills a sequence. Its number is negative and unique: position in its partition and the partition.
    whole = pieces.filter(F.col("length") == size)
    whole = whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return planned.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and the ids if asked for."""
    pieces = stored(token_pieces(docs, path, size, with_ids), "pieces")
    return pack(pieces, size).withColumn("doc_id", id_or_null("id")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids
    )
