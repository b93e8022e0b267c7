"""Removal of repeated passages with suffix automata.

A window is ``length`` consecutive words of one document. A word is removed where a window covers it that also starts
earlier: in a document with a smaller id, or earlier in the same one. Windows are judged on the input.

Candidates are the runs of windows whose anchor occurs twice (see ``anchors``). Each group of documents sends its distinct
candidate passages to the shard of their anchor. A shard lays its passages in order of first place and reads each through
the suffix automaton of the passages before it: the matching statistic at a word is the longest suffix that the automaton
holds, and where it reaches ``length`` the window ending there has an earlier place. Only then the passage joins the
automaton, if it had a window that was new. The shard answers each group with the first place of each passage and its
repeated windows; a passage at any later place is repeated throughout. Where rows that share an id have different texts,
the windows of passages that meet are judged by their places instead, within the shard. The reference being the whole table, its automata
have no size bound as a whole, so no automaton is sent to every executor: shards, each with its own, go to tasks, and
passages are streamed to the shard that can hold them.

Null text and text of fewer words than a window lose nothing. Rows that share a ``doc_id`` are read as one place: none is
earlier than the other. A null ``doc_id`` comes before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tallybeam.llm.anchors import Passages, among, anchored_runs, announcement, answered, count_in_buckets, covered, crowd, hot_anchors, in_order, repeated
from tallybeam.llm.shared import GROUP_BYTES, PACKED, WordHashes, bucket_of, id_or_null, in_groups, pack, packed, unpack

LENGTH = 20
GRAM = 8
SHARD_WORDS = 40_000
HOT = 2000  # different stretches of an anchor that one automaton holds
PORTION = 1 << 20

HASHES = WordHashes()


class SuffixAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` that only suffixes through ``state`` reach."""
        copy = len(self.next)
        self.next.append(self.next[target].copy())
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            target = self.next[last].get(word)
            if target is not None:
                exact = self.length[target] == self.length[last] + 1
                last = target if exact else self._split(last, word, target)
                continue
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            state = last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][word]
                exact = self.length[target] == self.length[state] + 1
                self.link[new] = target if exact else self._split(state, word, target)
            last = new

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """At each word the length of the longest suffix read so far that the automaton holds."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            target = self.next[state].get(word)
            if target is None:
                size = 0
            else:
                state, size = target, size + 1
            yield size


def repeated_windows(passages: list[list[bytes]], length: int) -> list[np.ndarray]:
    """For passages in order of first place, which of their windows an earlier passage has."""
    automaton, found = SuffixAutomaton(), []
    for words in passages:
        flags = np.fromiter(automaton.statistics(words), np.int64, len(words))[length - 1 :] >= length
        if not flags.all():
            automaton.add(words)
        found.append(flags)
    return found


def contested(spans: list[tuple[int, int, int]]) -> list[int]:
    """Of spans ``id, first, last`` in order, those that meet another of their id.

    Runs of one document never do, so these are of different rows under one id.
    """
    out, widest = set(), 0
    for k, (key, first, last) in enumerate(spans):
        if k and spans[widest][0] == key and first <= spans[widest][2]:
            out |= {k, widest}
        if not k or spans[widest][0] != key or last > spans[widest][2]:
            widest = k
    return sorted(out)


def judge_contested(passages: list[list[bytes]], places: list[tuple[int, int]], flags: list[np.ndarray], length: int) -> None:
    """Set the flags of passages whose order of first places isn't that of their windows, by the places of all windows."""
    spans = [(key, first, first + len(own) - 1) for (key, first), own in zip(places, flags, strict=True)]
    doubtful = contested(spans)
    if not doubtful:
        return
    windows = lambda words: (tuple(words[k : k + length]) for k in range(len(words) - length + 1))
    least = dict.fromkeys((w for k in doubtful for w in windows(passages[k])), (2**63, 0))
    for words, (key, first) in zip(passages, places, strict=True):
        for at, window in enumerate(windows(words), first):
            if window in least and (key, at) < least[window]:
                least[window] = key, at
    for k in doubtful:
        key, first = places[k]
        flags[k] = np.array([least[w] < (key, at) for at, w in enumerate(windows(passages[k]), first)], bool)


def _runs(texts: list[bytes], length: int, gram: int):
    """Of each run of windows: text, first word, last window's first word, anchor hash."""
    lists = [t.split() for t in texts]  # bytes split at the six ASCII white-space characters
    sizes = np.array([len(w) for w in lists], np.int64)
    first, last, _, anchor = anchored_runs(HASHES.of([w for words in lists for w in words]), sizes, length, gram)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, first, "right") - 1
    return owner, first - begins[owner], last - begins[owner], anchor


def _group_anchors(portions: list[tuple]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[p[-1] for p in portions]])


SCHEMA = "id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_bytes: int = GROUP_BYTES, with_text: bool = False, most: int = HOT
) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_sha256``, and the kept words joined by a space if asked for."""
    rows, groups = in_groups(docs, group_bytes)
    buckets = max(1, groups // 4)
    schema = SCHEMA + (", kept string" if with_text else "")

    def runs_of(table: pa.Table) -> list[tuple]:
        return [(ids, texts, *_runs(texts, length, gram)) for ids, texts in in_order(table, PORTION)]

    def announce(table: pa.Table) -> pa.Table:
        portions = runs_of(table)

        def counted(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
            return crowd(values, counts, stretches(portions, values[counts > 2]))

        return announcement(table.column("g")[0].as_py(), _group_anchors(portions), buckets, counted)[0]

    def stretches(portions: list[tuple], of: np.ndarray):
        for _, texts, *runs in portions:
            keep = np.flatnonzero(among(runs[-1], of))
            at = words = None
            for owner, first, last, anchor in zip(*[r[keep].tolist() for r in runs], strict=True):
                if owner != at:
                    at, words = owner, texts[owner].split()
                yield anchor, b" ".join(words[first : last + length])

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed([])
        portions = runs_of(table)
        wanted, totals = repeated(_group_anchors(portions), answers, buckets)
        hot = hot_anchors(wanted, totals, most, groups)
        passages, anchors, singles, before = Passages(), [], [], 0
        for ids, texts, *runs in portions:
            keep = np.flatnonzero(among(runs[-1], wanted))
            at = words = None
            alone = among(runs[-1][keep], hot).tolist()
            for owner, first, last, anchor, single in zip(*[r[keep].tolist() for r in runs], alone, strict=True):
                if owner != at:
                    at, words = owner, texts[owner].split()
                # A stretch, or each window of a hot anchor by itself.
                for low, high in [(k, k) for k in range(first, last + 1)] if single else [(first, last)]:
                    text = b" ".join(words[low : high + length])
                    if passages.add(text, before + owner, (ids[owner], low), high):
                        anchors.append(xxhash.xxh3_64_intdigest(text) if single else anchor)
                        singles.append(single)
            before += len(ids)
        # Single windows have buckets of their own after the others.
        bucket = bucket_of(np.array(anchors, np.uint64), buckets) + buckets * np.array(singles, np.int64)
        return passages.rows(table.column("g")[0].as_py(), bucket, anchors)

    def match(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            return table
        sent = [unpack(b) for b in table.column("blob").to_pylist()]
        places: dict[bytes, tuple[int, int]] = {}
        anchor_of: dict[bytes, int] = {}
        for at, texts, anchors in sent:
            for place, anchor, text in zip(map(tuple, at.tolist()), anchors, texts, strict=True):
                if text not in places or place < places[text]:
                    places[text] = place
                anchor_of[text] = anchor
        if bucket >= buckets:  # windows of hot anchors, one by one: the first place has no earlier one, all others have
            return packed([
                (g, bucket, pack(np.array([places[t] for t in texts], np.int64).reshape(-1, 2), [b"\0"] * len(texts)))
                for g, (_, texts, _) in zip(table.column("g").to_pylist(), sent, strict=True)
            ])
        # Equal windows have equal anchors, so an automaton needs the passages of some anchors only.
        order = sorted(places, key=lambda t: (anchor_of[t], places[t]))
        answer: dict[bytes, bytes] = {}
        begin = size = 0
        for k, text in enumerate(order):
            size += text.count(b" ") + 1
            if k + 1 == len(order) or size >= SHARD_WORDS and anchor_of[order[k + 1]] != anchor_of[text]:
                shard = sorted(order[begin : k + 1], key=places.get)
                passages = [t.split(b" ") for t in shard]
                flags = repeated_windows(passages, length)
                judge_contested(passages, [places[t] for t in shard], flags, length)
                answer.update(zip(shard, [np.packbits(f).tobytes() for f in flags], strict=True))
                begin, size = k + 1, 0
        return packed([
            (g, bucket, pack(np.array([places[t] for t in texts], np.int64).reshape(-1, 2), [answer[t] for t in texts]))
            for g, (_, texts, _) in zip(table.column("g").to_pylist(), sent, strict=True)
        ])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(answered(answers))
        out: list[list] = [[] for _ in range(5)]
        document = 0
        for ids, texts in in_order(table, PORTION):
            for key, text in zip(ids, texts, strict=True):
                words = text.split()
                size = len(words)
                if document in found:
                    first, last, place, bits = found[document]
                    own = (place[:, 0] == key) & (place[:, 1] == first)
                    gone = covered(size, length, first, last, own, bits)
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                row = key, size, size - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                document += 1
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        names = ["id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
        return pa.table({n: pa.array(v, kind) for n, v, kind in zip(names, out, kinds, strict=False)})

    answers = count_in_buckets(rows.groupBy("g").applyInArrow(announce, PACKED))
    sent = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(send, PACKED)
    matched = sent.groupBy("bucket").applyInArrow(match, PACKED)
    result = rows.groupBy("g").cogroup(matched.groupBy("g")).applyInArrow(finish, schema)
    return result.withColumn("doc_id", id_or_null("id")).select("doc_id", *[c for c in result.columns if c != "id"])
