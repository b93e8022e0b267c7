"""Removal of byte strings that a document with a smaller id has too, by sorted suffixes.

A byte is removed where a string of ``length`` bytes covers it that also starts in a document with a smaller id. Strings
are judged on the input and never cross documents.

Candidates are the runs of strings whose anchor, ``gram`` bytes inside them, occurs twice (see ``anchors``). Their suffixes
are range-partitioned by leading bytes, those of the anchor, with splitters sampled from the documents. A bucket lays out
the suffixes of its candidates, cut to ``length`` bytes, and sorts them by multikey quicksort on eight-byte keys: all by
the first key, then only the ties by the next. Equal neighbours are one string; its smallest document id decides. Splitters
are whole anchors, and equal strings have equal anchors, so no string lies in two buckets; ``compare_across`` confirms on
the ends of each bucket that its splitters hold.

Null text and text shorter than ``length`` lose nothing. Rows that share a ``doc_id`` never remove from each other. A null
``doc_id`` comes before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.anchors import (
    Passages,
    among,
    anchored_runs,
    announcement,
    came_back,
    count_in_buckets,
    covered,
    crowd,
    hot_anchors,
    in_order,
    pack_columns,
    repeated,
    unpack_columns,
)
from tallybeam.llm.shared import GROUP_BYTES, PACKED, hashed_sample, id_or_null, in_groups, mixed, pack, packed, split_by, unpack

LENGTH = 50
GRAM = 16
PORTION = 1 << 20
PART_BYTES = 1 << 20
HOT = 5000  # different stretches of an anchor that one task lays out
SAMPLE_DOCUMENTS = 400
SAMPLE_BYTES = 4096


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; the last seven places have none."""
    out = data.astype(np.uint64)
    for step in (1, 2, 4):
        out = (out[:-step] << np.uint64(8 * step)) | out[step:]
    return out


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` bytes, 8 < n <= 16."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    words = _words_at(data)
    count = len(data) - n + 1
    return mixed(mixed(words[:count] * np.uint64(0x9E3779B97F4A7C15)) + words[n - 8 : n - 8 + count] * np.uint64(0xD6E8FEB86659FD93))


def multikey_groups(keys: list[np.ndarray]) -> np.ndarray:
    """Number of the equal class of each row, where ``keys`` are its parts in order; classes are sorted.

    Rows are sorted by the first key; rows that tie are sorted by the next among themselves, until none tie or no key is
    left.
    """
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable")
    cut = np.r_[True, np.diff(keys[0][order]) != 0] if n else np.zeros(0, bool)
    for key in keys[1:]:
        begins = np.flatnonzero(cut)
        sizes = np.diff(np.r_[begins, n])
        tied = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(cut)[at]
        rows = order[at]
        sub = np.lexsort((key[rows], group))
        order[at] = rows[sub]
        values = key[order[at]]
        cut[at[1:]] |= (np.diff(values) != 0) & (np.diff(group) == 0)
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(cut) - 1
    return out


def smallest_ids(texts: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the smallest id of a text that has the string, for each string of ``length`` bytes in it."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    words = _words_at(data)
    windows = sizes - length + 1
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), windows)
    firsts = np.cumsum(windows) - windows
    starts = np.arange(len(owner)) - np.repeat(firsts - begins, windows)
    # The last key overlaps the one before, so that it holds the last eight bytes.
    keys = [words[starts + at] for at in [*range(0, length - 8, 8), length - 8]]
    group = multikey_groups(keys)
    least = np.full(group.max() + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids[owner])
    return np.split(least[group], firsts[1:])


def compare_across(low: bytes, leading: list[bytes], high: bytes | None) -> bool:
    """Whether the leading bytes of a bucket's first and last suffix lie between its splitters."""
    return not leading or (low <= min(leading) and (high is None or max(leading) < high))


def _runs(texts: list[bytes], length: int, gram: int, bits: int = 64):
    """Of each run of strings: text, first byte, last string's first byte, first byte and the low ``bits`` of the hash of its
    anchor. Anchors that share them are taken for equal, which makes candidates and no matches."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first, last, place, anchor = anchored_runs(np.frombuffer(b"".join(texts), np.uint8), sizes, length, gram, byte_grams)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, first, "right") - 1
    return owner, first - begins[owner], last - begins[owner], place - begins[owner], anchor & np.uint64((1 << bits) - 1)


def pack_stretches(places: np.ndarray, texts: list[bytes], starts: list[int]) -> bytes:
    """Ids and stretches with the place of the anchor in each, or -1 for a single window; texts in one piece."""
    columns = np.column_stack([places[:, 0], np.array([len(t) for t in texts], np.int64), np.array(starts, np.int64)])
    return pack(pack_columns(columns), b"".join(texts), level=3)


def unpack_stretches(blob: bytes, gram: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Ids, stretches and their anchors."""
    columns, joined = unpack(blob)
    ids, sizes, starts = unpack_columns(columns, 3).T
    ends = np.cumsum(sizes)
    begins, starts = (ends - sizes).tolist(), starts.tolist()
    texts = [joined[a:b] for a, b in zip(begins, ends.tolist(), strict=True)]
    return ids.tolist(), texts, [joined[a + s : a + s + gram] if s >= 0 else b"" for a, s in zip(begins, starts, strict=True)]


def judged(table: pa.Table, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Per document that has any candidates: first and last start of each occurrence, whether it is of the smallest id that
    its stretch has anywhere, and if so a bit for each window.

    ``ids`` are those of the group's documents in their order, so a stretch's first document has its smallest id here. A
    bucket answers whether that is the smallest of all, one bit for each stretch, and with the bits of those that are.
    """
    found = came_back(table)
    if found is None:
        return {}
    occurrences, bucket, blobs = found
    document, first, last, stretch = occurrences.T
    n = len(bucket)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, stretch, document)
    widths = np.zeros(n, np.int64)
    widths[stretch] = (last - first + 8) // 8
    leads, bits = np.zeros(n, bool), [b""] * n
    for b, own in split_by(bucket):
        flags, joined = unpack(blobs[b])
        leads[own] = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(own)).astype(bool)
        at = 0
        for k in own[leads[own]].tolist() if joined else []:
            bits[k] = joined[at : at + widths[k]]
            at += widths[k]
    key = np.array(ids, np.int64)
    own = leads[stretch] & (key[document] == key[least[stretch]])
    return {d: (first[rows], last[rows], own[rows], [bits[k] for k in stretch[rows].tolist()]) for d, rows in split_by(document)}


def _group_anchors(portions: list[tuple]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[p[-1] for p in portions]])


def sampled_splitters(docs: DataFrame, buckets: int, gram: int = GRAM) -> list[bytes]:
    """``buckets - 1`` sorted leading strings that cut the suffixes of a bounded sample of texts into equal parts."""
    if buckets < 2:
        return []
    rows = hashed_sample(docs.filter("text is not null"), SAMPLE_DOCUMENTS).select(F.substring("text", 1, SAMPLE_BYTES))
    texts = [r[0].encode() for r in rows.collect()]
    heads = sorted({t[k : k + gram] for t in texts for k in range(0, len(t) - gram + 1, 7)})
    return [heads[len(heads) * k // buckets] for k in range(1, buckets)] if heads else []


SCHEMA = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, with_bytes: bool = False, most: int = HOT
) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the kept bytes if asked for."""
    rows, groups = in_groups(docs, group_bytes)
    buckets = max(1, groups // 2)
    splitters = sampled_splitters(docs, buckets, gram)
    schema = SCHEMA + (", kept binary" if with_bytes else "")
    # Announced hashes have as many bits as keep all but about one in a thousand of the table's anchors apart.
    bits = min(64, 28 + groups.bit_length())

    def runs_of(table: pa.Table) -> list[tuple]:
        return [(ids, texts, *_runs(texts, length, gram, bits)) for ids, texts in in_order(table, PORTION)]

    def announce(table: pa.Table) -> pa.Table:
        portions = runs_of(table)

        def counted(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
            return crowd(values, counts, stretches(portions, values[counts > 2]))

        return announcement(table.column("g")[0].as_py(), _group_anchors(portions), buckets, counted)[0]

    def stretches(portions: list[tuple], of: np.ndarray):
        for _, texts, *runs in portions:
            keep = np.flatnonzero(among(runs[-1], of))
            for owner, first, last, anchor in zip(*[runs[c][keep].tolist() for c in (0, 1, 2, 4)], strict=True):
                yield anchor, texts[owner][first : last + length]

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed([])
        portions = runs_of(table)
        wanted, totals = repeated(_group_anchors(portions), answers, buckets)
        hot = hot_anchors(wanted, totals, most, groups)
        found, starts, bucket, before = Passages(), [], [], 0
        for ids, texts, *runs in portions:
            keep = np.flatnonzero(among(runs[-1], wanted))
            alone = among(runs[-1][keep], hot).tolist()
            for owner, first, last, place, single in zip(*[r[keep].tolist() for r in runs[:4]], alone, strict=True):
                text = texts[owner]
                if single:  # single windows have the buckets after those of the stretches
                    for k in range(first, last + 1):
                        window = text[k : k + length]
                        if found.add(window, before + owner, (ids[owner], k), k):
                            starts.append(-1)
                            bucket.append(buckets + xxhash.xxh3_64_intdigest(window) % buckets)
                elif found.add(text[first : last + length], before + owner, (ids[owner], first), last):
                    starts.append(place - first)
                    bucket.append(bisect_right(splitters, text[place : place + gram]))
            before += len(ids)
        return found.rows(table.column("g")[0].as_py(), np.array(bucket, np.int64), starts, packing=pack_stretches)

    def sort(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        sent = [unpack_stretches(b, gram) for b in table.column("blob").to_pylist()]
        smallest: dict[bytes, int] = {}
        head_of: dict[bytes, bytes] = {}
        for ids, texts, heads in sent:
            for key, text, head in zip(ids, texts, heads, strict=True):
                old = smallest.get(text)
                if old is None or key < old:
                    smallest[text] = key
                head_of[text] = head

        def reply(bits_of: Callable[[bytes], bytes]) -> pa.Table:
            rows = []
            for g, (ids, texts, _) in zip(table.column("g").to_pylist(), sent, strict=True):
                leads = [smallest[t] == key for key, t in zip(ids, texts, strict=True)]
                joined = b"".join([bits_of(t) for t, lead in zip(texts, leads, strict=True) if lead])
                rows.append((g, bucket, pack(np.packbits(np.array(leads, bool)).tobytes(), joined)))
            return packed(rows)

        if bucket >= buckets:  # windows of hot anchors, one by one: the smallest id has no earlier one, all others have
            return reply(lambda _: b"")
        low = splitters[bucket - 1] if bucket else b""
        high = splitters[bucket] if bucket < len(splitters) else None
        if not compare_across(low, list(head_of.values()), high):
            raise ValueError("a suffix lies outside its bucket")
        # Strings with one anchor stay together; a part of the bucket at a time is laid out and sorted.
        order = sorted(smallest, key=head_of.get)
        answer: dict[bytes, bytes] = {}
        begin = size = 0
        for k, text in enumerate(order):
            size += len(text)
            if k + 1 == len(order) or size >= PART_BYTES and head_of[order[k + 1]] != head_of[text]:
                part = order[begin : k + 1]
                own = np.array([smallest[t] for t in part], np.int64)
                for t, key, least in zip(part, own.tolist(), smallest_ids(part, own, length), strict=True):
                    answer[t] = np.packbits(least < key).tobytes()
                begin, size = k + 1, 0
        return reply(answer.__getitem__)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        portions = list(in_order(table, PORTION))
        found = judged(answers, [key for ids, _ in portions for key in ids])
        out: list[list] = [[] for _ in range(6)]
        document = 0
        for ids, texts in portions:
            for key, text in zip(ids, texts, strict=True):
                size, removed, spans = len(text), 0, 0
                if document in found:
                    gone = covered(size, length, *found[document])
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    text = np.frombuffer(text, np.uint8)[~gone].tobytes()
                for column, value in zip(out, (key, size, removed, spans, hashlib.sha256(text).hexdigest(), text), strict=True):
                    column.append(value)
                document += 1
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes]
        return pa.table({n: pa.array(v, kind) for n, v, kind in zip(names, out, kinds, strict=False)})

    answers = count_in_buckets(rows.groupBy("g").applyInArrow(announce, PACKED))
    sent = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(send, PACKED)
    matched = sent.groupBy("bucket").applyInArrow(sort, PACKED)
    result = rows.groupBy("g").cogroup(matched.groupBy("g")).applyInArrow(finish, schema)
    return result.withColumn("doc_id", id_or_null("id")).select("doc_id", *[c for c in result.columns if c != "id"])
