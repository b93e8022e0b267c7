"""Content-chosen anchors that find repeated stretches without shipping every window of a text.

Every window of ``length`` tokens picks the smallest hash among the runs of ``gram`` tokens inside it, its anchor. Equal
windows pick equal anchors, wherever they stand. Neighbouring windows mostly share theirs, so a text has one anchor for
about half of ``length - gram`` windows. Only windows whose anchor occurs twice somewhere can be repeated.

The exchange has two rounds. Each group of documents sends the sorted distinct anchor hashes it has to buckets of the hash;
a bucket answers each group which of them were seen more than once. A list is answered in its own order by one bit each.

An anchor in very many different stretches is hot: its windows go to tasks one by one, by the hash of the whole window, so
equal windows still meet and no task gets all stretches of one anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybeam.llm.shared import PACKED, bucket_of, gram_hashes, pack, packed, split_by, unpack

LOW = np.uint64((1 << 24) - 1)
CHUNK = 1 << 23


def anchored_runs(
    tokens: np.ndarray, sizes: np.ndarray, length: int, gram: int, grams: Callable[[np.ndarray, int], np.ndarray] = gram_hashes
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in texts laid end to end: first start, last start, place and hash of the anchor.

    ``sizes`` are the token counts of the texts; no window crosses from one text to the next.
    """
    n = len(tokens)
    if n > CHUNK:  # windows of a very long stretch are looked at in parts that overlap by less than a window
        ends = np.cumsum(sizes)
        parts = []
        for low in range(0, n, CHUNK):
            high = min(n, low + CHUNK + length - 1)
            own = np.diff(np.clip(ends, low, high), prepend=low)
            first, last, place, h = anchored_runs_of(tokens[low:high], own, length, gram, grams)
            parts.append((first + low, last + low, place + low, h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    return anchored_runs_of(tokens, np.asarray(sizes), length, gram, grams)


def anchored_runs_of(tokens, sizes, length, gram, grams):
    n, wide = len(tokens), length - gram + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    h = grams(tokens, gram)
    # The place in the low bits makes the leftmost of equal hashes the smallest.
    low = (h & ~LOW) | (np.arange(len(h), dtype=np.uint64) & LOW)
    span = 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: span - wide], low[wide - span :])
    inside = np.zeros(n + 1, np.int32)
    ends = np.cumsum(sizes)
    fits = sizes >= length
    np.add.at(inside, (ends - sizes)[fits], 1)
    np.add.at(inside, (ends - length + 1)[fits], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(low)])
    if not len(starts):
        return empty, empty, empty, np.zeros(0, np.uint64)
    places = starts + (((low[starts] & LOW).astype(np.int64) - starts) & int(LOW))
    new = np.flatnonzero(np.r_[True, (np.diff(places) != 0) | (np.diff(starts) != 1)])
    first, last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    return first, last, places[new], h[places[new]]


# Sorted hashes travel as differences, byte plane by byte plane, which the compressor shortens.


def pack_sorted(values: np.ndarray) -> bytes:
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


# So do columns of whole numbers, whose differences may be negative and come with the sign in the last bit.


def pack_columns(rows: np.ndarray) -> bytes:
    steps = np.diff(rows.astype(np.int64), axis=0, prepend=np.int64(0))
    signed = ((steps << 1) ^ (steps >> 63)).astype("<i8")
    return np.ascontiguousarray(signed.T).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_columns(planes: bytes, columns: int) -> np.ndarray:
    signed = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").reshape(columns, -1)
    steps = (signed >> np.uint64(1)).astype(np.int64) ^ -(signed & np.uint64(1)).astype(np.int64)
    return np.cumsum(steps, axis=1).T


def crowd(values: np.ndarray, counts: np.ndarray, stretches: Iterator[tuple[int, bytes]]) -> np.ndarray:
    """Counts of a group's anchors of which those seen three times or more are of distinct stretches, but two at least.

    ``stretches`` gives each anchor and its stretch for occurrences of anchors in ``values[counts > 2]``.
    """
    found: dict[int, set[bytes]] = {}
    for anchor, text in stretches:
        found.setdefault(anchor, set()).add(text)
    often = np.flatnonzero(counts > 2)
    out = counts.copy()
    out[often] = [max(2, len(found[v])) for v in values[often].tolist()]
    return out


def hot_anchors(wanted: np.ndarray, totals: np.ndarray, limit: int, groups: int) -> np.ndarray:
    """The sorted anchors that stand in too many different stretches for one task; the same in each group.

    A stretch counts once or twice for each group that has it, so the limit isn't below four times the groups.
    """
    return wanted[totals > max(limit, 4 * groups)]


def announcement(g: int, hashes: np.ndarray, buckets: int, counted: Callable | None = None) -> tuple[pa.Table, np.ndarray]:
    """Rows that tell the buckets which hashes group ``g`` has, each with its count, or with what ``counted`` makes of these."""
    values, counts = np.unique(hashes, return_counts=True)
    if counted is not None:
        counts = counted(values, counts)
    counts = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)
    rows = [(g, b, pack(pack_sorted(values[at]), counts[at])) for b, at in split_by(bucket_of(values, buckets))]
    return packed(rows), values


def count_in_buckets(announced: DataFrame) -> DataFrame:
    """Answers to announcements: per list, a bit for each hash that occurs twice or more, and the totals of those."""

    def count(table: pa.Table) -> pa.Table:
        lists = [unpack(b) for b in table.column("blob").to_pylist()]
        hashes = [unpack_sorted(planes) for planes, _ in lists]
        values, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, np.concatenate([c for _, c in lists]), len(values)).astype(np.int64)
        rows, at = [], 0
        for g, own in zip(table.column("g").to_pylist(), hashes, strict=True):
            total = totals[where[at : at + len(own)]]
            at += len(own)
            again = total > 1
            rows.append((g, table.column("bucket")[0].as_py(), pack(np.packbits(again), total[again].astype(np.uint32))))
        return packed(rows)

    return announced.groupBy("bucket").applyInArrow(count, PACKED)


def repeated(hashes: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the hashes that a group announced, the sorted repeated ones and their totals."""
    values = np.unique(hashes)
    lists = dict(split_by(bucket_of(values, buckets)))
    kept, totals = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
        bits, counts = unpack(blob)
        own = values[lists[bucket]]
        kept.append(own[np.unpackbits(bits, count=len(own)).astype(bool)])
        totals.append(counts.astype(np.int64))
    kept, totals = np.concatenate(kept), np.concatenate(totals)
    order = np.argsort(kept)
    return kept[order], totals[order]


def among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def in_order(table: pa.Table, limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of a group, by id and then text, in portions of about ``limit`` bytes or one text."""
    ids = table.column("id").to_pylist()
    texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    begin = size = 0
    for k, at in enumerate(order):
        size += len(texts[at])
        if size >= limit or k + 1 == len(order):
            portion = order[begin : k + 1]
            yield [ids[x] for x in portion], [texts[x] for x in portion]
            begin, size = k + 1, 0


class Passages:
    """Distinct candidate stretches of a group, the smallest place of each, and where they occur.

    A place is ``(id, first token)``. Documents are numbered as :func:`in_order` gives them.
    """

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.places: list[tuple[int, int]] = []
        self.occurrences: list[tuple[int, int, int, int]] = []  # document, first start, last start, stretch

    def add(self, text: bytes, document: int, place: tuple[int, int], last: int) -> bool:
        """Whether the stretch is new."""
        k = self.number.setdefault(text, len(self.places))
        new = k == len(self.places)
        if new:
            self.places.append(place)
        elif place < self.places[k]:
            self.places[k] = place
        self.occurrences.append((document, place[1], last, k))
        return new

    def rows(self, g: int, bucket: np.ndarray, *more: list, packing: Callable[..., bytes] = pack) -> pa.Table:
        """A row for each bucket with its stretches, places and what else belongs to them, and one that comes back to the
        group, by way of a bucket below zero of its own, with the occurrences and the bucket of each stretch."""
        texts, places = list(self.number), np.array(self.places, np.int64).reshape(-1, 2)
        rows = [
            (g, b, packing(places[own], [texts[k] for k in own], *[[values[k] for k in own] for values in more]))
            for b, own in split_by(bucket)
        ]
        occurrences = np.array(self.occurrences, np.int64).reshape(-1, 4)
        back = pack(pack_columns(occurrences), pack_columns(bucket.reshape(-1, 1)), level=3)
        return packed([*rows, (g, -1 - g, back)] if texts else [])


def came_back(answers: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, bytes]] | None:
    """A group's occurrences (document, first start, last start, stretch), the bucket of each stretch, and what each bucket
    answers; None for a group without any."""
    blobs = dict(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
    if not blobs:
        return None
    occurrences, bucket = unpack(blobs.pop(min(blobs)))
    return unpack_columns(occurrences, 4), unpack_columns(bucket, 1)[:, 0], blobs


def answered(answers: pa.Table) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]]:
    """Per document that has any candidates: first and last start, first place and bits of each occurrence.

    A bucket answers with the first places of the stretches it got, one row each, and, packed, one bit for each window.
    """
    found = came_back(answers)
    if found is None:
        return
    occurrences, bucket, blobs = found
    place, bits = None, [b""] * len(bucket)
    for b, own in split_by(bucket):
        places, flags = unpack(blobs[b])
        if place is None:
            place = np.zeros((len(bucket), *places.shape[1:]), np.int64)
        place[own] = places
        for k, flag in zip(own.tolist(), flags, strict=True):
            bits[k] = flag
    for document, rows in split_by(occurrences[:, 0]):
        _, first, last, k = occurrences[rows].T
        yield document, (first, last, place[k], [bits[x] for x in k.tolist()])


def covered(size: int, length: int, first: np.ndarray, last: np.ndarray, own: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which of a document's tokens a repeated window covers.

    In an ``own`` occurrence, the first of its stretch, the windows with a bit are repeated, else all are.
    """
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, first[~own], 1)
    np.add.at(marks, last[~own] + length, -1)
    for k in np.flatnonzero(own).tolist():
        if any(bits[k]):
            starts = first[k] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[k], np.uint8), count=last[k] + 1 - first[k]))
            marks[starts] += 1
            marks[starts + length] -= 1
    return np.cumsum(marks[:-1]) > 0
