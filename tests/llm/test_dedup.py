"""Exact, near and substring de-duplication against brute force."""

from __future__ import annotations

import hashlib
import os
import types
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybeam.llm import automaton_dedup, exact_dedup, jaccard_join, queries, suffix_dedup
from tallybeam.llm.anchors import Passages, anchored_runs, came_back, pack_columns, pack_sorted, unpack_columns, unpack_sorted
from tallybeam.llm.shared import NO_ID, in_groups, pack
from tests.conftest import SF_DIR
from tests.llm.samples import frame, odd_rows, sentences

LEAST = -(10**30)


def order(key):
    return LEAST if key is None else key


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])


def table(spark, which):
    if which == "odd":
        return frame(spark, odd_rows()), odd_rows()
    docs = queries.documents(spark, SF_DIR)
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def expected_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for key, text in rows:
        own = groups[text or ""]
        keep = max((k for k in own if k is not None), default=None)
        out.append((key, keep, len(own), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: (F.length(text) % 3).cast("string")])
def test_exact_decisions(spark, digest):
    """Also with a digest that most texts share."""
    docs, rows = table(spark, "odd")
    found = by_row(exact_dedup.decisions(docs, digest=digest), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found == sorted(expected_exact(rows), key=lambda r: [(x is not None, x) for x in r])


def test_exact_survivors(spark):
    docs, rows = table(spark, "odd")
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert kept.schema == docs.schema
    found = {r.text or "": r.doc_id for r in kept.collect()}
    assert kept.count() == len(found)
    assert found == {t or "": keep for (_, t), (_, keep, *_) in zip(rows, expected_exact(rows), strict=True)}


def expected_words(rows, length):
    seen, out = {}, []
    for key, text in sorted(rows, key=lambda r: order(r[0])):
        words = (text or "").encode().split()
        for k in range(len(words) - length + 1):
            place = order(key), k
            window = tuple(words[k : k + length])
            seen[window] = min(seen.get(window, place), place)
    for key, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - length + 1):
            if seen[tuple(words[k : k + length])] < (order(key), k):
                gone.update(range(k, k + length))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((key, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which, group", [("odd", 4000), ("sf", 40_000)])
def test_automaton_dedup(spark, which, group):
    docs, rows = table(spark, which)
    found = by_row(automaton_dedup.remove_repeats(docs, group_bytes=group), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(expected_words(rows, 20), key=lambda r: [(x is not None, x) for x in r])
    assert sum(r[2] for r in found) > 0


def expected_bytes(rows, length):
    first = {}
    for key, text in rows:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, order(key)), order(key))
    out = []
    for key, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < order(key):
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which, group", [("odd", 4000), ("sf", 40_000)])
def test_suffix_dedup(spark, which, group):
    docs, rows = table(spark, which)
    columns = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    found = by_row(suffix_dedup.remove_repeats(docs, group_bytes=group), *columns)
    assert found == sorted(expected_bytes(rows, 50), key=lambda r: [(x is not None, x) for x in r])
    assert sum(r[2] for r in found) > 0


def test_stretches_travel_narrow():
    """What groups send and get back is a few bytes beside the texts, and no two groups' occurrences meet in one bucket."""
    columns = np.array([[-(2**63), 0, 5], [2**63 - 1, -7, 5], [3, 2**40, 0]])
    assert (unpack_columns(pack_columns(columns), 3) == columns).all()
    assert unpack_columns(pack_columns(columns[:0]), 3).shape == (0, 3)
    texts = [sentences(k, 12).encode()[:66] for k in range(3000)]
    tables = []
    for g in (4, 5):
        found = Passages()
        for k, text in enumerate(texts):
            found.add(text, k // 40, (1000 + k // 40, k % 40 * 17), k % 40 * 17 + 16)
        tables.append(found.rows(g, np.arange(len(texts)) % 7, [k % 30 for k in range(len(texts))], packing=suffix_dedup.pack_stretches))
        occurrences, bucket, blobs = came_back(tables[-1])
        assert [tuple(r) for r in occurrences.tolist()] == found.occurrences and (bucket == np.arange(len(texts)) % 7).all()
        ids, own, heads = suffix_dedup.unpack_stretches(blobs[3], 16)
        assert own == texts[3::7] and ids == [1000 + k // 40 for k in range(3, 3000, 7)]
        assert heads == [texts[k][k % 30 : k % 30 + 16] for k in range(3, 3000, 7)]
    back = [min(t.column("bucket").to_pylist()) for t in tables]
    assert max(back) < 0 and len(set(back)) == 2
    sent = {b: len(blob.as_py()) for b, blob in zip(tables[0].column("bucket").to_pylist(), tables[0].column("blob"), strict=True)}
    assert sent.pop(back[0]) < 5 * len(texts)
    alone = sum(len(pack(b"".join(texts[b::7]), level=3)) for b in range(7))
    assert sum(sent.values()) < alone + 4 * len(texts)


def test_announced_hashes_are_short():
    """Hashes have no more bits than tell the anchors apart, so announcements take about half of eight bytes each."""
    texts = [sentences(k, 400, 100_000).encode() for k in range(100)]
    whole, short = (suffix_dedup._runs(texts, 50, 16, bits) for bits in (64, 36))
    assert all((a == b).all() for a, b in zip(whole[:4], short[:4], strict=True))
    assert len(np.unique(short[4])) == len(np.unique(whole[4]))
    sizes = [len(pack(pack_sorted(np.unique(x[4])))) for x in (whole, short)]
    assert sizes[1] < 0.55 * sizes[0]


def frequent_line():
    """A line in many texts with different words around it, some of them in two texts, and copies of whole texts."""
    rows = [(k, f"{sentences(k % 150, 30)} {' '.join(f'frequent{j}' for j in range(16))} {sentences(k % 150 + k // 170 * 500, 30)}") for k in range(200)]
    return [*rows, *[(200 + k, text) for k, (_, text) in enumerate(rows[:20])], (7, rows[9][1]), (None, rows[11][1])]


@pytest.mark.parametrize("run, expected, columns, stretch", [
    (automaton_dedup.remove_repeats, lambda rows: expected_words(rows, 20), ("doc_id", "n_words", "n_removed", "kept_sha256"), "repeated_windows"),
    (suffix_dedup.remove_repeats, lambda rows: expected_bytes(rows, 50), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "smallest_ids"),
])
def test_frequent_line_is_dealt_by_window(spark, tmp_path, run, expected, columns, stretch):
    """With a low limit the line's anchors are hot: no task works on all its stretches at once, and rows stay the same."""
    rows = frequent_line()
    module, log = __import__(run.__module__, fromlist=["x"]), str(tmp_path)
    original = getattr(module, stretch)

    def watched(passages, *arguments):
        size = sum(b"frequent3" in (p if isinstance(p, bytes) else b" ".join(p)) for p in passages)
        with open(f"{log}/{size}", "w"):
            return original(passages, *arguments)

    # Functions go to workers by their globals, so the watched one does too in a copy of the function.
    watching = types.FunctionType(run.__code__, run.__globals__ | {stretch: watched, "SHARD_WORDS": 100, "PART_BYTES": 1000, "__name__": "__main__"}, run.__name__, run.__defaults__)
    found = by_row(watching(frame(spark, rows), group_bytes=8000, most=20), *columns)
    assert found == sorted(expected(rows), key=lambda r: [(x is not None, x) for x in r])
    assert sum(r[2] for r in found) > 0
    assert max(map(int, os.listdir(log)), default=0) < 60  # of 170 different ones


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def expected_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists, places = defaultdict(list), defaultdict(list)
    for x, s in enumerate(sets):
        counts = Counter(y for token in s for y in lists[token])
        linked = [y for y, i in counts.items() if 100 * i >= 75 * (len(s) + len(sets[y]) - i)]
        if s:
            linked += places[rows[x][0]]
            places[rows[x][0]].append(x)
        for token in s:
            lists[token].append(x)
        for y in linked:
            up[root(x)] = root(y)
    least = {}
    for x, (key, _) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), key), key, key=order)
    return [(key, len(s), least[root(x)] if s else key) for x, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("which, group, block", [("odd", 4000, 150), ("sf", 40_000, 3_000_000)])
def test_jaccard_components(spark, which, group, block):
    """With small blocks, so that some are cut into chunks."""
    docs, rows = table(spark, which)
    found = by_row(jaccard_join.components(docs, group_bytes=group, block_tokens=block), "doc_id", "n_shingles", "component_id")
    assert found == sorted(expected_components(rows), key=lambda r: [(x is not None, x) for x in r])


def third_without_id():
    """A third of the rows have no id; some are copies and near copies of rows that have one."""
    rows = [(None if k % 3 == 0 else k, sentences(k % 70, 60 + k % 70)) for k in range(120)]
    near = [sentences(k, 60 + k).split() for k in range(0, 30, 5)]
    return [*rows, *[(None, " ".join([*words[:-2], "another", "end"])) for words in near], (None, None), (None, "")]


def test_rows_without_an_id_are_spread(spark):
    rows, groups = in_groups(frame(spark, third_without_id()), 2000)
    sizes = {r.g: r["count"] for r in rows.filter(F.col("id") == NO_ID).groupBy("g").count().collect()}
    assert groups > 10
    assert len(sizes) > groups / 2
    assert max(sizes.values()) < 12


@pytest.mark.parametrize(
    ("run", "expected", "columns"),
    [
        (lambda d: jaccard_join.components(d, group_bytes=4000, block_tokens=300), lambda rows: expected_components(rows),
         ("doc_id", "n_shingles", "component_id")),
        (lambda d: automaton_dedup.remove_repeats(d, group_bytes=4000), lambda rows: expected_words(rows, 20),
         ("doc_id", "n_words", "n_removed", "kept_sha256")),
        (lambda d: suffix_dedup.remove_repeats(d, group_bytes=4000), lambda rows: expected_bytes(rows, 50),
         ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")),
    ],
)
def test_a_third_of_rows_without_an_id(spark, run, expected, columns):
    found = by_row(run(frame(spark, third_without_id())), *columns)
    assert found == sorted(expected(third_without_id()), key=lambda r: [(x is not None, x) for x in r])


def test_family_of_near_copies():
    """A family in which most pairs don't link: the forest holds the components of all links."""
    rng = np.random.default_rng(4)
    texts, words = [], [f"t{k}" for k in range(120)]
    for _ in range(80):
        words = list(words)
        words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
        texts.append((len(texts), " ".join(words)))
    expected = expected_components(texts)
    sets = jaccard_join.shingle_sets([jaccard_join.words_of(t.encode()) for _, t in texts])
    sizes = np.array([len(s) for s in sets])
    order_ = np.argsort(sizes, kind="stable")
    forest = jaccard_join.Forest(len(texts))
    for a, b in jaccard_join.links_in_block([sets[k] for k in order_], sizes[order_], 75):
        forest.join(int(order_[a]), int(order_[b]))
    assert forest.roots(np.arange(len(texts))).tolist() == [c for _, _, c in expected]


def test_large_family_is_dealt_in_bounded_tasks(spark):
    """A family of many chunks is not copied to every pair of them, and no task gets more than a pair of chunks or so."""
    base, rng = [f"b{k}" for k in range(300)], np.random.default_rng(8)
    rows = []
    for key in range(400):
        words = list(base)
        words[rng.integers(len(words))] = f"e{rng.integers(10**6)}"
        rows.append((key, " ".join(words)))
    # Texts that hang together with the family by a shingle that is rare in both, but link with none of it.
    rows += [(400 + k, " ".join(rows[k][1].split()[:40] + [f"o{k}x{j}" for j in range(60)])) for k in range(40)]
    docs, limit, dealt = frame(spark, rows), 6000, []
    original = jaccard_join.in_tasks

    def watched(*arguments):
        found = original(*arguments)
        dealt.append(found.groupBy("task").agg(F.sum(F.size("shared"))).collect())
        return found

    jaccard_join.in_tasks = watched
    try:
        found = by_row(jaccard_join.components(docs, block_tokens=limit), "doc_id", "n_shingles", "component_id")
    finally:
        jaccard_join.in_tasks = original
    assert found == sorted(expected_components(rows))
    whole = 400 * 296
    assert sum(tokens for tasks in dealt for _, tokens in tasks) < 4 * whole  # all pairs of chunks: 20 times
    assert max(tokens for tasks in dealt for _, tokens in tasks) < 6 * limit


def test_anchors_are_chosen_by_content():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**63, 60).astype(np.uint64)
    texts = [np.r_[rng.integers(0, 2**63, n).astype(np.uint64), shared] for n in (17, 40)]
    found = []
    for tokens in texts:
        first, last, _, anchor = anchored_runs(tokens, np.array([len(tokens)]), 20, 8)
        assert first[0] == 0 and last[-1] == len(tokens) - 20 and (first[1:] == last[:-1] + 1).all()
        at = len(tokens) - 60
        found.append({(max(f, at) - at, l - at, a) for f, l, a in zip(first.tolist(), last.tolist(), anchor.tolist()) if l >= at})
    assert found[0] == found[1]
    values = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert (unpack_sorted(pack_sorted(values)) == values).all()


@pytest.mark.parametrize(
    "run",
    [exact_dedup.decisions, exact_dedup.survivors, automaton_dedup.remove_repeats, suffix_dedup.remove_repeats, jaccard_join.components],
)
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []
