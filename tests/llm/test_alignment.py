"""Token alignment and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallybeam.llm import queries, sharding, token_alignment
from tests.conftest import SF_DIR
from tests.llm.samples import collected, frame, odd_rows, sentences

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    more = [(70, "<s> </s> <unk> <0x0A> <|endoftext|> plain"), (71, "line\nline\ttab \x00 \x7f 🙂🙂 é"), (72, "▁ marked"), (73, " two  spaces ")]
    return odd_rows() + more + [(74, sentences(9, 3000, 3000)), (75, "ab" * 2500), (76, "<|endoftext|>")]


def expected_alignment(rows):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {k: t for t, k in library.get_vocab().items()}
    byte_of = token_alignment.byte_of_character()

    def piece_bytes(k):
        return bytes([int(pieces.id_to_piece(k)[3:5], 16)]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode()

    found, total = [], Counter()
    for key, text in rows:
        sides = []
        for ids, of in (
            (library.encode(" " + (text or ""), add_special_tokens=False).ids, lambda k: bytes(byte_of[c] for c in names[k])),
            (pieces.encode(text or ""), piece_bytes),
        ):
            at, side = 0, []
            for k in ids:
                side.append((k, at, at + len(of(k))))
                at += len(of(k))
            sides.append((side, b"".join(map(of, ids))))
        whole = (" " + (text or "")).encode()
        if not text or any(raw != whole for _, raw in sides):
            found.append((key, [], [], [], ""))
            continue
        a, b = sides[0][0], sides[1][0]
        links = [(x, y) for x, low, high in a for y, start, stop in b if low < stop and start < high]
        cuts = sorted({end for *_, end in a} & {end for *_, end in b})
        groups, low = [], 0
        for high in cuts:
            own = [",".join(str(k) for k, start, _ in side if low <= start < high) for side in (a, b)]
            groups.append("|".join(own))
            low = high
        found.append((key, a, b, links, ";".join(groups)))
        total.update(links)
    highest = defaultdict(int)
    for (_, y), count in total.items():
        highest[y] = max(highest[y], count)
    return sorted(
        (
            (key, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(total[p] == highest[p[1]] for p in links),
             sum(total[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
            for key, a, b, links, groups in found
        ),
        key=lambda r: (r[0] is not None, *r),
    )


COLUMNS = [c.split()[0] for c in token_alignment.SUMMARY.split(", ")]


@pytest.mark.parametrize("lane, batch", [(2048, 4 << 20), (7, 900)])
def test_alignment(spark, monkeypatch, lane, batch):
    """Also with lanes shorter than tokens and several batches. The module's values don't reach workers, so they are called here."""
    rows = [(k, t) for k, t in texts() if t is None or len(t) < 4000]
    expected = expected_alignment(rows)
    if lane == 2048:
        found = token_alignment.summaries(frame(spark, rows).repartition(5), A, B).collect()
        assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=lambda r: (r[0] is not None, *r)) == expected
        return
    monkeypatch.setattr(token_alignment, "LANE", lane)
    aligned = token_alignment.align_batch([(t or "").encode() for _, t in rows], A, B)
    by_row = dict(zip(aligned.rows.tolist(), token_alignment.group_digests(aligned, A, B), strict=True))
    links = aligned.counts(aligned.a.document[aligned.links_a])
    found = sorted(((k is not None, k or 0, by_row.get(n, "")) for n, (k, _) in enumerate(rows)))
    assert found == sorted((r[0] is not None, r[0] or 0, r[-1]) for r in expected)
    assert sorted(links.tolist()) == sorted(r[4] for r in expected if r[4])


def test_alignment_lists(spark):
    rows = [(1, "Grüße, Welt"), (2, None), (3, "one two")]
    found = {r.doc_id: r for r in token_alignment.alignments(frame(spark, rows), A, B).collect()}
    assert found[2].a_ids == [] == found[2].b_cuts
    for key in (1, 3):
        r = found[key]
        assert r.a_cuts[-1] == len(r.a_ids)
        assert r.b_cuts[-1] == len(r.b_ids)
        assert len(r.a_cuts) == len(r.b_cuts)
    assert Tokenizer.from_file(A).encode(" one two", add_special_tokens=False).ids == found[3].a_ids


def test_alignment_of_the_table(spark):
    docs = queries.documents(spark, SF_DIR)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 1500]
    found = token_alignment.summaries(docs.filter("length(coalesce(text, '')) < 1500"), A, B).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found) == expected_alignment(rows)
    assert queries.op12_token_alignment(spark, SF_DIR).count() == docs.count()


def test_alignment_empty(spark):
    assert token_alignment.summaries(frame(spark, []), A, B).collect() == []
    assert [r.n_links for r in token_alignment.summaries(frame(spark, [(1, None)]), A, B).collect()] == [0]


def test_space_tree():
    rng = random.Random(2)
    tree, plain = sharding.SpaceTree(), []
    for _ in range(3000):
        if rng.random() < 0.6 or not plain:
            entry = rng.randrange(500), rng.randrange(10**6)
            tree.add(*entry)
            plain.append(entry)
        else:
            size = rng.randrange(600)
            best = min((e for e in plain if e[0] >= size), default=None)
            assert tree.take_tightest(size) == best
            if best:
                plain.remove(best)


def one_by_one(sizes, capacity):
    """Best fit decreasing without a histogram or a tree: the space left in each shard."""
    spaces = []
    for size in sorted(sizes, reverse=True):
        fitting = [(space, k) for k, space in enumerate(spaces) if space >= size]
        if fitting:
            spaces[min(fitting)[1]] -= size
        else:
            spaces.append(max(capacity, size) - size)
    return spaces


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 40), 17, 90]) for _ in range(300)]
    counts = Counter(sizes)
    plan = sharding.Plan.fill([(s, 0, counts[s]) for s in sorted(counts, reverse=True)], 97)
    used = Counter()
    for size, _, groups, shard in plan.runs:
        used[shard] += size * groups
    assert sorted(97 - used[k] for k in range(plan.shards)) == sorted(one_by_one(sizes, 97))


def check_shards(spark, found, rows, shards=None, capacity=None):
    table = collected(found, "doc_id", "shard", "slot")
    given = sorted(((k is not None, k or 0), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted(((k == k, 0 if k != k else int(k)), s, c) for k, s, c in zip(table.doc_id, table["size"], table.text_crc32, strict=True)) == given
    for _, own in table.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    place = defaultdict(set)
    for crc, size, shard in zip(table.text_crc32, table["size"], table.shard, strict=True):
        place[crc, size].add(shard)
    assert all(len(p) == 1 for p in place.values())
    used = table.groupby("shard")["size"].sum()
    groups = Counter()
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + 1
    if capacity:
        assert len(used) == len(one_by_one(groups.values(), capacity))
        assert max(used) <= max(capacity, max(groups.values()))
    if shards:
        assert set(used.index) <= set(range(shards))
        least = [used.get(k, 0) for k in range(shards)]
        ordinary = [v for v in least if v < max(groups.values())] or least
        return max(ordinary) - min(ordinary)


def test_sharding(spark):
    docs = frame(spark, odd_rows()).repartition(4)
    check_shards(spark, sharding.even(docs, 8), odd_rows(), shards=8)
    check_shards(spark, sharding.by_capacity(docs, 2000), odd_rows(), capacity=2000)
    check_shards(spark, sharding.even(docs, 1), odd_rows(), shards=1)


def test_sharding_with_a_hot_text(spark):
    rows = [(k, "hot " * 20) for k in range(700)] + [(1000 + k, sentences(k, 5 + k % 9)) for k in range(1400)]
    rows += [(k, None) for k in range(5000, 5200)]
    apart = check_shards(spark, sharding.even(frame(spark, rows).repartition(7), 8), rows, shards=8)
    assert apart <= max(len(t or "") + 1 for k, t in rows if k >= 1000 and t)


def test_sharding_of_the_table(spark):
    found = queries.op13_sharding(spark, SF_DIR)
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF_DIR).collect()]
    apart = check_shards(spark, found, rows, shards=8)
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert apart < 0.01 * total
    assert dict(found.dtypes)["slot"] == "bigint"
    assert dict(found.dtypes)["shard"] == "int"
    assert found.select("law", "grown_shard").distinct().collect() == [("bytes", None)]


def test_sharding_empty(spark):
    assert sharding.even(frame(spark, []), 8).collect() == []


def test_even_plan_keeps_large_groups_apart():
    runs = sharding.even_plan({1000: 1, 10: 70, 1: 20}, 8)
    used = Counter()
    for size, _, groups, shard in runs:
        used[shard] += size * groups
    assert sorted(used.values())[-1] == 1000
    assert max(sorted(used.values())[:-1]) - min(used.values()) <= 10
    assert sum(used.values()) == 1720
