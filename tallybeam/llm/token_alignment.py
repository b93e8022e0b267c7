"""Alignment of two tokenizers' tokens of the same texts, all documents of a batch in lockstep.

Both token sequences cover the same bytes. One NumPy state vector holds where each document stands in its A and its B
tokens; a step emits the pair of tokens that overlap there, advances the one that ends first, or both, which is a cut, and
drops finished documents from the vector. Documents longer than ``LANE`` bytes are several entries of the vector, one for
each stretch: a step covers the bytes up to the nearer of two token ends and belongs to the stretch in which that end lies.

How often an id pair is linked in the whole corpus takes one exchange of distinct pairs: a batch sends each of its pairs once
with its count, pairs are summed and compared by B id, and the sums go back to the batches that asked. A pair that every
text has is so one row a batch. What a batch needs to finish (which documents have which of its pairs) waits in the shared
folder, so no text is tokenized twice.

Texts are null, empty or not what the tokens' bytes say (a tokenizer that replaces characters): they have no tokens. Null
and repeated ids are rows like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.shared import pack, raw_texts, stored, unpack

LANE = 2048
BATCH_BYTES = 2 << 20
MARK = "▁"  # fixed value: a space in the piece model's vocabulary


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Ids of a byte-level vocabulary file, without special tokens, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        of = byte_of_character()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            if set(token) <= of.keys():
                self.bytes_of[k] = bytes(map(of.__getitem__, token))
        # The same vocabulary as ranks, where it lies beside the file, is encoded faster and to the same ids.
        self.ranked = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """Ids of a sentencepiece model file and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        names = [self.library.id_to_piece(k) for k in ids]
        self.bytes_of = [
            bytes([int(name[1:-1], 16)]) if self.library.is_byte(k) else name.replace(MARK, " ").encode()
            for k, name in zip(ids, names, strict=True)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


_LOADED: dict[tuple[type, str], ByteTokens | PieceTokens] = {}


def loaded(kind: type, path: str):
    """A vocabulary, loaded once in a worker."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


@dataclass(frozen=True)
class Side:
    """Tokens of the aligned documents, one after another: ids, the byte where each ends, the document of each."""

    ids: np.ndarray
    ends: np.ndarray
    document: np.ndarray

    @staticmethod
    def of(tokens: list[list[int]], sizes: np.ndarray) -> Side:
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ids = np.fromiter((k for own in tokens for k in own), np.int64, counts.sum())
        return Side(ids, np.cumsum(sizes[ids]), np.repeat(np.arange(len(tokens)), counts))


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """Links and cuts between two sequences of token ends over the same bytes, in lanes from byte ``starts`` to ``stops``.

    Returns the A and B positions of each link, in no order, and those of the tokens that end in a cut, in order.
    """
    beyond = np.iinfo(np.int64).max
    ends_a, ends_b = np.append(ends_a, beyond), np.append(ends_b, beyond)
    i, j = np.searchsorted(ends_a, starts, "right"), np.searchsorted(ends_b, starts, "right")
    links_a, links_b, cuts_a, cuts_b = ([np.zeros(0, np.int64)] for _ in range(4))
    while len(stops):
        end_a, end_b = ends_a[i], ends_b[j]
        live = np.minimum(end_a, end_b) <= stops
        if not live.all():
            i, j, stops, end_a, end_b = i[live], j[live], stops[live], end_a[live], end_b[live]
        links_a.append(i)
        links_b.append(j)
        cut = end_a == end_b
        cuts_a.append(i[cut])
        cuts_b.append(j[cut])
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
    return np.concatenate(links_a), np.concatenate(links_b), np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


@dataclass(frozen=True)
class Aligned:
    """The alignment of a batch. ``rows`` are the places in the batch of the documents that have tokens."""

    rows: np.ndarray
    a: Side
    b: Side
    links_a: np.ndarray
    links_b: np.ndarray
    cuts_a: np.ndarray
    cuts_b: np.ndarray

    def counts(self, of_document: np.ndarray) -> np.ndarray:
        return np.bincount(of_document, minlength=len(self.rows))


def align_batch(texts: list[bytes], path_a: str, path_b: str) -> Aligned:
    a, b = loaded(ByteTokens, path_a), loaded(PieceTokens, path_b)
    rows = [k for k, text in enumerate(texts) if text]
    strings = [texts[k].decode() for k in rows]
    same, tokens_a, tokens_b = [], [], []
    for k, own_a, own_b in zip(rows, a.encode(strings), b.encode(strings), strict=True):
        whole = b" " + texts[k]
        if b"".join(map(a.bytes_of.__getitem__, own_a)) == whole and b"".join(map(b.bytes_of.__getitem__, own_b)) == whole:
            same.append(k)
            tokens_a.append(own_a)
            tokens_b.append(own_b)
    sides = [
        Side.of(tokens, np.fromiter(map(len, side.bytes_of), np.int64, len(side.bytes_of)))
        for side, tokens in ((a, tokens_a), (b, tokens_b))
    ]
    sizes = np.array([len(texts[k]) + 1 for k in same], np.int64)
    ends = np.cumsum(sizes)
    lanes = -(-sizes // LANE)
    number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    starts = np.repeat(ends - sizes, lanes) + number * LANE
    stops = np.minimum(starts + LANE, np.repeat(ends, lanes))
    return Aligned(np.array(same, np.int64), *sides, *lockstep(sides[0].ends, sides[1].ends, starts, stops))


def group_digests(found: Aligned, path_a: str, path_b: str) -> list[str]:
    """SHA-256 of each document's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    parts, keys, documents = [], [], []
    for side, cuts, marks, odd in ((found.a, found.cuts_a, ",|", 0), (found.b, found.cuts_b, ",;", 1)):
        last = np.zeros(len(side.ids), np.int64)
        last[cuts] = 1
        # Ids with what follows them: a comma inside a group, the mark of the side at its end.
        written = np.array([f"{k}{mark}" for mark in marks for k in range(int(side.ids.max(initial=0)) + 1)], object)
        parts.append(written[side.ids + last * (len(written) // 2)])
        keys.append(2 * (np.cumsum(last) - last) + odd)  # the group's number, A before B
        documents.append(side.document)
    order = np.argsort(np.concatenate(keys), kind="stable")
    parts, documents = np.concatenate(parts)[order], np.concatenate(documents)[order]
    bounds = np.searchsorted(documents, np.arange(len(found.rows) + 1))
    return [
        hashlib.sha256("".join(parts[low : high].tolist())[:-1].encode()).hexdigest()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True)
    ]


def whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts in batches of about ``BATCH_BYTES``, small ones of Spark's joined and large ones cut."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text) + 64  # many empty texts fill a batch too
            if size >= BATCH_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document both token sequences and the cuts: how many tokens of A, and of B, lie before the end of each group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in whole_batches(batches):
            found = align_batch(texts, path_a, path_b)
            columns = []
            for side, cuts in ((found.a, found.cuts_a), (found.b, found.cuts_b)):
                first = np.searchsorted(side.document, np.arange(len(found.rows) + 1))
                of_cut = np.searchsorted(side.document[cuts], np.arange(len(found.rows) + 1))
                own, ends = [[]] * len(texts), [[]] * len(texts)
                for n, k in enumerate(found.rows):
                    own[k] = side.ids[first[n] : first[n + 1]]
                    ends[k] = cuts[of_cut[n] : of_cut[n + 1]] + 1 - first[n]
                columns += [own, ends]
            lists = [pa.array(columns[k], pa.list_(pa.int32())) for k in (0, 2, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return _documents(docs).mapInArrow(work, ALIGNED)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then their next ones and so on, which pack better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


SUMMARY = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summaries(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the SUMMARY columns; the last but one two weigh its links by the corpus-wide counts of their id pairs."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, (ids, texts) in enumerate(whole_batches(batches)):
            found = align_batch(texts, path_a, path_b)
            keys = found.a.ids[found.links_a] << 32 | found.b.ids[found.links_b]
            pairs, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            document = found.a.document[found.links_a]
            # Links by document, then pair; of each only its distance from the one before is kept.
            places = np.sort(document * max(len(pairs), 1) + which)
            links = found.counts(document)
            which = places - np.repeat(np.arange(len(links)), links) * max(len(pairs), 1)
            steps = np.diff(which, prepend=0)
            starts = np.cumsum(links) - links
            steps[starts] = which[starts]
            totals = [found.counts(x) for x in (found.a.document, found.b.document, found.a.document[found.cuts_a])]
            blob = pack(ids, found.rows, totals, links, group_digests(found, path_a, path_b), _planes(steps))
            size = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(size + 1, first + number)),
                    pa.concat_arrays([pa.array(pairs), pa.nulls(1, pa.int64())]),
                    pa.concat_arrays([pa.array(times.astype(np.int64)), pa.nulls(1, pa.int64())]),
                    pa.concat_arrays([pa.nulls(size, pa.binary()), pa.array([blob], pa.binary())]),
                ],
                ["batch", "pair", "times", "documents"],
            )

    schema = "batch long, pair long, times long, documents binary"
    found = stored(_documents(docs).mapInArrow(align, schema), "aligned")
    pairs = found.filter("pair is not null")
    # A row for each distinct pair, so its size is bounded by the two vocabularies.
    counted = stored(pairs.groupBy("pair").agg(F.sum("times").alias("count")), "pair-counts")
    piece = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counted.groupBy(piece.alias("piece")).agg(F.max("count").alias("highest"))
    # One row for each id of the B vocabulary at most, so few that every executor may have them.
    ranked = counted.withColumn("piece", piece).join(F.broadcast(highest), "piece")
    ranked = ranked.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = pairs.select(F.col("batch").alias("asker"), "pair").join(ranked, "pair")

    def finish(batch: pa.Table, answers: pa.Table) -> pa.Table:
        ids, rows, totals, links, digests, planes = unpack(batch.column("documents").to_pylist()[0])
        order = np.argsort(answers.column("pair").to_numpy())
        counts = answers.column("count").to_numpy()[order]
        best = answers.column("best").to_numpy()[order].astype(np.int64)
        starts = np.cumsum(links) - links
        steps = _from_planes(planes)
        along = np.cumsum(steps)
        before = np.where(starts > 0, along[starts - 1], 0) if len(starts) else along[:0]
        which = along - np.repeat(before, links)
        # Every document with tokens has a link, so no stretch of the sums is empty.
        sums = [np.add.reduceat(v[which], starts) if len(starts) else starts for v in (best, counts)]
        columns = [*totals, links, *sums]
        out = [np.zeros(len(ids), np.int64) for _ in columns]
        for column, values in zip(out, columns, strict=True):
            column[rows] = values
        written = np.full(len(ids), "", object)
        written[rows] = digests
        arrays = [pa.array(ids, pa.int64()), *map(pa.array, out), pa.array(written, pa.string())]
        return pa.table(arrays, names=[c.split()[0] for c in SUMMARY.split(", ")])

    waiting = found.filter("documents is not null").select("batch", "documents")
    return waiting.groupBy("batch").cogroup(answers.groupBy("asker")).applyInArrow(finish, SUMMARY)
