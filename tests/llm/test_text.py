"""Scoring, language, packing, secrets, fingerprints and sentence pieces."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybeam.llm import language_id, lm_scoring, packing, pieces, queries, secret_links, simhash
from tests.conftest import SF_DIR
from tests.llm.samples import collected, frame, odd_rows, sentences

BYTE_BPE, PIECE_BPE = (queries.tokenizer(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def held_out(key, folds):
    return zlib.crc32(("" if key is None else str(key)).encode()) % folds == 1


# Language model


def test_lm_counts_and_base(spark):
    rows = odd_rows()
    found = lm_scoring.score_texts(frame(spark, rows), BYTE_BPE, ~queries.fold(5), group_bytes=4000).collect()
    lists = [[w for w in (t or "").encode().lower().split()] + [None] for _, t in rows]
    counts = Counter(w for (key, _), words in zip(rows, lists, strict=True) if not held_out(key, 5) for w in words)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (str(key), held_out(key, 5), len(words), sum(counts[w] > 0 for w in words), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6))
        for (key, _), words in zip(rows, lists, strict=True)
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_lm_beats_base_on_held_out_texts(spark):
    docs = queries.documents(spark, SF_DIR.replace("0.001", "0.01"))
    found = lm_scoring.score_texts(docs, BYTE_BPE, ~queries.fold(5)).filter("held_out and n_known = n_tokens").toPandas()
    assert len(found) > 20
    assert found.score.sum() > found.base_score.sum()


def test_lm_is_a_distribution_and_learns():
    """Class probabilities sum to one, training lowers the loss, and gradients equal finite differences."""
    rng = np.random.default_rng(0)
    model = lm_scoring.new_model(np.arange(50)[::-1] + 1.0, families=3, members=4, width=4, hidden=6)
    sequences = [rng.integers(0, 12, 70), np.arange(40) % 12, rng.integers(0, 12, 5)]
    read, target, real = lm_scoring.windows(sequences, model.start)
    assert real.sum() == 115
    assert [x for s in sequences for x in s] == target[real].tolist()
    total = sum(np.exp(lm_scoring.scorer(model)(read, np.full_like(target, c))) for c in range(12))
    assert np.allclose(total, 1, atol=1e-4)
    for name, x in model.weights.items():
        model.weights[name] = x.astype(np.float64)

    def loss():
        return -(lm_scoring.scorer(model)(read, target) * real).sum() / real.sum()

    gradients = lm_scoring._gradients(model, read, target, real)
    for name, x in model.weights.items():
        at = tuple(rng.integers(0, d) for d in x.shape)
        old = x[at]
        x[at] = old + 1e-5
        high = loss()
        x[at] = old - 1e-5
        low = loss()
        x[at] = old
        assert abs((high - low) / 2e-5 - gradients[name][at]) < 1e-5
    before = loss()
    lm_scoring.fit(model, sequences, steps=60)
    assert loss() < before


def small_language(seed=7):
    """Sequences of words of one to three ids, ids below 20 begin a word; a model of them and its untrained weights."""
    rng = np.random.default_rng(seed)
    begins = np.arange(40) < 20
    words = [np.concatenate([rng.integers(0, 20, 1), rng.integers(20, 40, rng.integers(0, 3))]) for _ in range(30)]
    texts = [np.concatenate([words[k] for k in rng.integers(0, 30, 25)]) for _ in range(60)]
    counts = np.bincount(np.concatenate(texts), minlength=40)
    return begins, texts, lm_scoring.new_model(counts, families=4, members=5, width=8, hidden=12, begins=begins)


@pytest.mark.parametrize("steps", [0, 300])
def test_lm_words_have_a_probability_of_at_most_one(steps):
    """Over all words of one, two and three ids after some text, trained or not; with long words it comes near 1."""
    begins, texts, model = small_language()
    if steps:
        lm_scoring.fit(model, [model.class_of[t] for t in texts], steps=steps)
    word_ids, others = np.flatnonzero(begins), np.flatnonzero(~begins)
    for before in (texts[0][:0], texts[1][:7], texts[2][:33]):

        def mass(words):
            # After each word stands a begin of the next; its probability doesn't depend on which.
            ids, begin = lm_scoring.scores(model, [np.concatenate([before, w, [0]]) for w in words])
            size = len(before) + len(words[0]) + 1
            ids, begin = ids.reshape(-1, size).astype(float), begin.reshape(-1, size).astype(float)
            at = len(before)
            return (10 ** (ids[:, at:-1].sum(1) - begin[:, at] + begin[:, -1])).sum()

        one = mass([[b] for b in word_ids])
        two = mass([[b, k] for b in word_ids for k in others])
        three = mass([[b, k, m] for b in word_ids for k in others for m in others])
        assert one + two + three <= 1 + 1e-5
        assert one + two + three > (0.9 if steps else 0.5)


def test_lm_chain_of_words():
    """Each word by itself, with its end, from the probabilities of ids and begins."""
    begins, texts, model = small_language()
    ends = [t.copy() for t in texts[:3]]
    for t in ends:
        t[-1] = 3  # the end token is a word of one id
    first = np.flatnonzero(begins[np.concatenate(ends)])
    found = lm_scoring.word_chains(model, ends, first)
    expected = []
    for t in ends:
        ids, begin = lm_scoring.scores(model, [t])
        starts = np.flatnonzero(begins[t])
        for k, low in enumerate(starts):
            high = starts[k + 1] if k + 1 < len(starts) else len(t)
            expected.append(ids[low:high].sum() - begin[low] + (begin[high] if high < len(t) else 0))
    assert np.allclose(found, expected, atol=1e-4)


def test_lm_learns_from_every_training_text(spark):
    """Trainers of all texts, none of the held-out ones; the average of theirs is better than their common start."""
    docs = queries.documents(spark, SF_DIR.replace("0.001", "0.01"))
    coder = lm_scoring.subwords(BYTE_BPE)
    sequences = lm_scoring.training_sequences(docs, F.lit(True), coder, 200)
    counts = np.bincount(np.concatenate(sequences), minlength=coder.size)
    start = lm_scoring.new_model(counts, begins=coder.begins())
    lm_scoring.fit(start, [start.class_of[s] for s in sequences[:60]], steps=60)
    fitted = [lm_scoring.fit_on_all(start, docs, ~queries.fold(5), BYTE_BPE, 2, 150) for _ in range(2)]
    held = [s for s in lm_scoring.training_sequences(docs, queries.fold(5), coder, 100)]
    score = [lm_scoring.id_scores(m, held).mean() for m in (start, fitted[0])]
    assert score[1] > score[0]
    assert all(np.allclose(fitted[0].weights[k], fitted[1].weights[k], atol=1e-5) for k in start.weights)
    none = lm_scoring.fit_on_all(start, docs, F.lit(False), BYTE_BPE)
    assert none is start
    other = docs.withColumn("text", F.when(queries.fold(5), F.lit("other words")).otherwise(F.col("text")))
    same = lm_scoring.fit_on_all(start, other, ~queries.fold(5), BYTE_BPE, 2, 150)
    assert all(np.allclose(fitted[0].weights[k], same.weights[k], atol=1e-5) for k in start.weights)


def test_lm_learns_from_whole_texts(spark):
    """Words anywhere in a long text change what is learned from it."""
    coder = lm_scoring.subwords(BYTE_BPE)
    words = ["apple", "bread", "chair", "dance"] * 100
    counts = np.ones(coder.size)
    counts[coder.packed([b"apple", b"bread", b"chair", b"dance", b"eagle"])[1]] = 1000
    start = lm_scoring.new_model(counts, begins=coder.begins())

    def learned(words):
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        return lm_scoring.fit_on_all(start, docs, F.lit(True), BYTE_BPE, 1).weights["member_bias"]

    plain = learned(words)
    for at in range(0, 400, 80):
        other = words[:at] + ["eagle"] * 10 + words[at + 10 :]
        assert not np.array_equal(learned(other), plain), at


def test_lm_windows_equal_one_pass():
    """A text cut into overlapping windows scores as if each id had its own window with the whole context."""
    rng = np.random.default_rng(1)
    model = lm_scoring.new_model(np.ones(60), families=5, members=5, width=4, hidden=6)
    text = rng.integers(0, 60, 130)
    whole = lm_scoring.id_scores(model, [text])
    assert len(whole) == 130
    for k in (0, 5, 15, 16, 77, 129):
        prefix = lm_scoring.id_scores(model, [text[: k + 1]])
        assert abs(prefix[-1] - whole[k]) < 1e-4


def test_lm_sees_fifteen_ids_before():
    model = lm_scoring.new_model(np.ones(60))
    text = np.random.default_rng(2).integers(0, 60, 40)
    whole = lm_scoring.id_scores(model, [text])
    other = text.copy()
    other[10] = (text[10] + 1) % 60
    changed = np.flatnonzero(lm_scoring.id_scores(model, [other]) != whole)
    assert changed.max() == 26 and model.weights["into"].shape == (48, 32)


def test_lm_word_of_many_ids(spark):
    """A word of more than 65,536 ids, scored like any other and without harm to the texts beside it."""
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 300_000))
    rows = [(1, f"before {long} after"), *[(k, sentences(k, 40)) for k in range(2, 9)]]
    found = {r.doc_id: r.score for r in lm_scoring.score_texts(frame(spark, rows), BYTE_BPE, F.lit(False)).collect()}
    coder = lm_scoring.subwords(BYTE_BPE)
    model = lm_scoring.new_model(np.zeros(coder.size, np.int64), begins=coder.begins())
    for key, text in rows:
        words = lm_scoring.words_of(text.encode())
        sizes, ids = coder.packed(words)
        assert (sizes.max() > 65_536) == (key == 1)
        # A word's end is the next word's begin, so all but the first begin of the text cancel.
        of_ids, begin = lm_scoring.scores(model, [ids])
        direct = of_ids.sum(dtype=np.float64) - float(begin[0]) + len(words) * math.log10(1 - lm_scoring.MIX)
        assert math.isclose(found[key], direct, rel_tol=1e-4), key


# Language


def test_language_of_held_out_texts(spark):
    docs = queries.documents(spark, SF_DIR.replace("0.001", "0.01"))
    found = queries.op2_language_id(spark, SF_DIR.replace("0.001", "0.01"))
    right = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")))
    assert right.first()[0] > 0.97


def test_language_of_odd_texts(spark):
    texts = [("the cat sat on the mat and the dog " * 9).encode(), "la maison est très près du château ".encode() * 9]
    net = language_id.fit([(texts[0], "en"), (texts[1], "fr")] * 20, steps=60)
    rows = [*odd_rows(), (100, texts[0].decode()), (101, texts[1].decode()), (102, "été"), (103, "a")]
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame(spark, rows), net).collect()}
    assert found[100][0] == "en" and found[101][0] == "fr"
    assert all(found[k] == ("und", 0.0) for k in (0, 1, 2, 13))
    assert all(0 <= s <= 1 for _, s in found.values())
    alone = language_id.predict(net, [texts[1], b"", b"a"])
    together = language_id.predict(net, [texts[0] * 40, b"a", texts[1]])
    assert np.allclose(alone[0], together[2], atol=1e-5) and np.allclose(alone[2], together[1], atol=1e-5)
    nothing = language_id.identify(frame(spark, rows), language_id.fit([])).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert language_id.training_sample(frame(spark, []), F.lit(True)) == []


def test_gated_network_gradient():
    rng = np.random.default_rng(2)
    table, loop = rng.standard_normal((9, 6)), rng.standard_normal((3, 6))
    codes, weight = rng.integers(0, 9, (7, 4)), rng.standard_normal((7, 4, 3)).astype(np.float32)

    def loss(t, l):
        return (language_id.run_direction(codes, t.astype(np.float32), l.astype(np.float32)) * weight).sum(dtype=np.float64)

    states = language_id.run_direction(codes, table.astype(np.float32), loop.astype(np.float32))
    g_table, g_loop = language_id._step_back(codes, table.astype(np.float32), loop.astype(np.float32), states, weight)
    for x, g, at in ((table, g_table, (int(codes[2, 1]), 4)), (table, g_table, (int(codes[0, 0]), 1)), (loop, g_loop, (1, 2)), (loop, g_loop, (2, 5))):
        step = np.zeros_like(x)
        step[at] = 1e-2
        pair = [(table + s, loop) if x is table else (table, loop + s) for s in (step, -step)]
        assert abs((loss(*pair[0]) - loss(*pair[1])) / 2e-2 - g[at]) < 2e-2 * max(1, abs(g[at]))


# Packing


def check_packing(spark, docs, rows, size):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    found = packing.pack_documents(docs, BYTE_BPE, size, with_ids=True).collect()
    parts, sequences = {}, {}
    for r in found:
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= size
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    for key, own in parts.items():
        if len(texts[key]) == 1:
            own = sorted(own, key=lambda r: r.piece)
            assert [i for r in own for i in r.ids] == texts[key][0]
            assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
            assert [r.piece for r in own] == list(range(len(own))) and all(r.length == size for r in own[1:])
    assert sum(r.length for r in found) == sum(len(i) for lists in texts.values() for i in lists)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    least = -(-sum(r.length for r in found) // size)
    assert len(sequences) <= least * 1.05 + 1


@pytest.mark.parametrize("size", [64, 2048])
def test_packing_odd(spark, size):
    check_packing(spark, frame(spark, odd_rows()), odd_rows(), size)


def test_packing_documents(spark):
    docs = queries.documents(spark, SF_DIR)
    check_packing(spark, docs, [(r.doc_id, r.text) for r in docs.collect()], packing.SIZE)


def test_plan_is_best_fit_on_documents():
    """The plan on counts opens as many bins as best fit, largest first, on single pieces."""
    rng = np.random.default_rng(6)
    lengths = sorted(rng.integers(1, 100, 3000).tolist(), reverse=True)
    free = []
    for length in lengths:
        at = min((k for k, f in enumerate(free) if f >= length), key=lambda k: free[k], default=None)
        if at is None:
            free.append(100)
            at = len(free) - 1
        free[at] -= length
    runs = packing.plan_bins(dict(Counter(lengths)), 100)
    filled, placed = Counter(), Counter()
    for length, first, ranks, first_bin, offset in runs:
        assert first == placed[length]
        placed[length] += ranks
        for k in range(first_bin, first_bin + ranks):
            assert filled[k] == offset
            filled[k] += length
    assert placed == Counter(lengths) and max(filled.values()) <= 100
    assert len(filled) <= len(free) + 1


def test_packing_empty(spark):
    assert packing.pack_documents(frame(spark, []), BYTE_BPE).collect() == []


# Secrets

SECRETS = [
    "password = 'hunter2000' token: abc api_key=ABCDEF0123", "secret=token=abcdefgh Token: token: abcdef", "AKIA" + "Z" * 16 + " AKIA123",
    "ffff" * 8 + " " + "a" * 23 + " AKIA" + "A1" * 10, "ſecret=abcdefgh toKen=abcdefgh api-key=abcdefgh apikey:abcdefgh", None, "", "é" * 9 + 'passwd" : "x_y-z.w=="',
]


def base_findings(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (name, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return [s for *_, s in sorted(out)]


def test_secret_base_spans(spark):
    rows = [*odd_rows(), *enumerate(SECRETS, 200)]
    docs = [(r.doc_id, r.text) for r in queries.documents(spark, SF_DIR).collect()]
    for part in (rows, docs):
        expected = sorted(
            (str(k), hashlib.sha256(",".join(s := base_findings(t or "")).encode()).hexdigest(), len(s)) for k, t in part
        )
        found = secret_links.find_secrets(frame(spark, part)).collect()
        assert sorted((str(r.doc_id), r.base_sha256, r.n_assign + r.n_access + r.n_hex) for r in found) == expected
        for r in found:
            assert {s for s in r.spans.split(",") if s.split(":")[0] in secret_links.BASE_KINDS} == set(
                base_findings(next(t or "" for k, t in part if k == r.doc_id))
            )


def linked_slowly(text, scope):
    base = secret_links.base_spans(text)
    hit = lambda a, b: a[1] < b[2] and b[1] < a[2]
    weak = [(kind, m.start(1), m.end(1)) for kind, p in secret_links.WEAK.items() for m in p.finditer(text)]
    weak = [s for s in weak if not any(hit(s, b) for b in base)]
    role = lambda s: {"access": "identifier", "assign": "value", "hex": "value"}.get(s[0], s[0])
    breaks = [m.start() for m in secret_links.BREAK.finditer(text)]

    def meet(a, b):
        low, high = min(a[1], b[1]), max(a[2], b[2])
        return not hit(a, b) and high - low <= scope and not any(low <= x < high for x in breaks)

    wanted = lambda s: ("identifier", "endpoint") if s[0] == "value" else ("value",)
    return {s for s in weak if any(role(o) in wanted(s) and meet(s, o) for o in [*weak, *base])}


def test_weak_parts_need_their_complement():
    rng = np.random.default_rng(8)
    words = ["client_id=svc_account", "k9Xw27QmZp41Lr8TbV3c", "https://api.example.com/v1", "\n\n", "plain words here", "password: hunter2000", "user: bob", "AKIA" + "Q" * 16]
    for _ in range(150):
        text = " ".join(words[k] + " x" * int(rng.integers(0, 40)) for k in rng.integers(0, len(words), 9))
        found = secret_links.linked_parts(text, secret_links.base_spans(text), 120)
        assert set(found) == linked_slowly(text, 120) and len(found) == len(set(found))
    # A long base span that covers many later ones also covers a weak part behind them.
    covering = [("assign", 0, 200), *[("hex", k, k + 24) for k in range(5, 105, 25)]]
    inside = " " * 120 + "client_id=svc_account and k9Xw27QmZp41Lr8TbV3c" + " " * 40
    assert secret_links.linked_parts(inside, covering) == []
    alone = "the id k9Xw27QmZp41Lr8TbV3c stands alone"
    assert secret_links.linked_parts(alone, []) == []
    both = "client_id=svc_account and k9Xw27QmZp41Lr8TbV3c"
    assert [s[0] for s in secret_links.linked_parts(both, [])] == ["identifier", "value"]


def test_redaction(spark):
    rows = [(1, "password = 'hunter2000' stays"), (2, None), (3, "clean text"), (4, "")]
    docs = frame(spark, rows)
    clean = secret_links.redacted(docs)
    assert clean.schema == docs.schema
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "[secret]' stays", 2: None, 3: "clean text", 4: ""}


# Fingerprints


def test_fingerprints_of_edited_texts(spark):
    rows = odd_rows()
    found = collected(simhash.edited_fingerprints(frame(spark, rows), queries=F.col("doc_id") % 2 == 0), "doc_id", "edited_sha256")
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(10**30) if r[0] is None else r[0], r[1].encode()))
    expected = []
    for k, (key, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[: len(text) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        expected.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((str(None if k != k else int(k)), n, s) for k, n, s in zip(found.doc_id, found.n_chars, found.edited_sha256)) == sorted(expected)
    prints = dict(zip(found.doc_id, found.fingerprint, strict=True))
    assert prints[3] == prints[4] == prints[14] and prints[1] == prints[2] == "0" * 32
    assert ((found.near_edited >= 0) & (found.near_edited <= 1)).all()
    numbers = {int(p, 16) for p in found.fingerprint}
    for key, own, near in zip(found.doc_id, found.fingerprint, found.n_near, strict=True):
        if key == key and key % 2 == 0:
            assert near == sum((int(own, 16) ^ other).bit_count() <= simhash.RADIUS for other in numbers)
        else:
            assert near != near


def test_next_document_in_uneven_ids(spark):
    """One id that half of the rows share, far-off ids, null ids: parts stay small and each row has one successor."""
    rows = [(7, f"same id {k}") for k in range(400)] + [(k * 3 + 10, f"text {k}") for k in range(200)]
    rows += [(2**62, "far"), (-(2**62), "far below"), *[(None, f"none {k}") for k in range(150)]]
    docs = frame(spark, rows).repartition(6)
    others, ends = simhash.with_next(docs, 20)
    found = others.unionByName(ends).collect()
    assert len(found) == len(rows)
    sizes = Counter(r.part for r in found)
    assert max(sizes.values()) <= 120
    at = {(r.part, r.place): r for r in found}
    assert len(at) == len(rows)
    here, seen = at[min(at)], []
    for _ in rows:
        seen.append((here.id, here.text))
        after = at[here.next_part, here.next_place]
        assert here.next_text == after.text
        here = after
    assert len(set(seen)) == len(rows)
    assert [k for k, _ in seen] == sorted(k for k, _ in seen)


def test_fingerprint_by_hand(spark):
    docs = spark.createDataFrame([(1, "One two two."), (2, "")], "k int, text string")
    hashed = spark.sql(
        "SELECT xxhash64('one', 'two', 0) a, xxhash64('two', 'two.', 0) b, xxhash64('two.', null, 0) c,"
        " xxhash64('one', 'two', 1) d, xxhash64('two', 'two.', 1) e, xxhash64('two.', null, 1) f"
    ).first()
    words = []
    for terms in (hashed[:3], hashed[3:]):
        bits = 0
        for b in range(64):
            votes = sum(w if h >> b & 1 else -w for w, h in zip((6, 7, 4), terms, strict=True))
            bits |= (votes > 0) << b
        words.append(bits - (1 << 64) * (bits >> 63))
    found = {r.k: list(r.words) for r in simhash.fingerprints(docs, ["k"]).collect()}
    assert found == {1: words, 2: [0, 0]}


def test_near_copies_are_within_the_radius(spark):
    """Copies with words changed to a shingle similarity of about 0.75: most are neighbours of their originals."""
    rng, rows = np.random.default_rng(12), []
    for k in range(60):
        words = sentences(1000 + k, 300, 3000).split()
        rows.append((2 * k, " ".join(words)))
        for at in range(8):  # 8 x 5 of 296 shingles change: 256 / 336 are left, 0.76
            words[at * 37 + int(rng.integers(30))] = f"new{k}x{at}"
        rows.append((2 * k + 1, " ".join(words)))
    found = simhash.edited_fingerprints(frame(spark, rows), queries=F.col("doc_id") % 2 == 0)
    near = [r.n_near for r in found.filter("doc_id % 2 = 0").collect()]
    assert len(near) == 60 and sum(n > 1 for n in near) >= 30


def test_permuted_blocks_find_all(spark):
    rng = np.random.default_rng(9)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    near = []
    for p in prints:
        for flips in (1, 3, 4, 6):
            q = p % 2**64
            for b in rng.choice(64, flips, replace=False):
                q ^= 1 << int(b)
            near.append(q - (1 << 64) * (q >> 63))
    pairs = [[p, 7] for p in prints + near] + [[5, p] for p in prints]
    index = spark.createDataFrame([(x,) for x in pairs], "words array<long>")
    found = simhash.near_fingerprints(index, index, 3)
    distinct = {tuple(x) for x in pairs}
    apart = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b))
    expected = {(a, b, d) for a in distinct for b in distinct if (d := apart(a, b)) <= 3}
    rows = [(tuple(r[0]), tuple(r[1]), r[2]) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


@pytest.mark.parametrize("radius", [0, 2, 7, 18])
def test_block_tables_at_every_radius(spark, radius):
    """Pairs at the radius and just beyond it, with the bits that differ spread, in one block, or in all but one."""
    rng, pairs = np.random.default_rng(radius), [(0, 0), (-1, -1)]
    for k in range(200):
        p = int.from_bytes(rng.bytes(16), "big")
        flips = rng.choice(np.r_[:128] if k % 3 == 0 else np.r_[:64] if k % 3 == 1 else np.r_[40:128], radius + k % 2, replace=False)
        q = p ^ sum(1 << int(b) for b in flips)
        pairs += [tuple((x >> at) % 2**64 - (1 << 64) * (x >> at + 63 & 1) for at in (0, 64)) for x in (p, q)]
    index = spark.createDataFrame([(list(x),) for x in pairs], "words array<long>")
    asked = index.limit(150).union(index.limit(3))
    found = [(tuple(r[0]), tuple(r[1]), r[2]) for r in simhash.near_fingerprints(asked, index, radius).collect()]
    apart = lambda a, b: sum(((x ^ y) % 2**64).bit_count() for x, y in zip(a, b))
    expected = {(a, b, d) for a in set(pairs[:150]) for b in set(pairs) if (d := apart(a, b)) <= radius}
    assert set(found) == expected and len(found) == len(expected) and len(found) >= 100


def test_candidates_of_the_block_tables_are_few(spark):
    """Rows of the tables are in proportion to the fingerprints, and keys tell nearly all of them apart."""
    made = []
    for n in (1000, 4000):
        index = spark.range(n).select(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("words"))
        found = simhash.near_fingerprints(index.limit(n // 50), index)
        assert found.count() == n // 50
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
        sizes = simhash.allowances(simhash.RADIUS, simhash.BLOCKS)
        bits = simhash.BITS // simhash.BLOCKS
        made.append(n * len(sizes) + n // 50 * sum(len(simhash._flips(bits, k)) for k in sizes))
    assert made[1] < 30 * 4000  # were 190 for each fingerprint
    assert sum(len(simhash._flips(bits, k)) for k in sizes) / 2**bits < 0.004  # of all pairs; were 190 / 2**12.8, 0.027


def test_near_fingerprints_exchanged_once_for_each_first_block(spark):
    index = spark.range(300).select(F.array(F.xxhash64("id"), F.xxhash64("id", F.lit(1))).alias("words"))
    with simhash.joined_by_first_block(spark):
        found = simhash.near_fingerprints(index.limit(5), index)
        assert found.count() == 5
        plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = re.findall(r"hashpartitioning\((.*?), \d+\)", plan)
    assert exchanged and not any("key" in by or "table" in by for by in exchanged), exchanged


def test_fingerprints_native_and_of_empty_table(spark):
    df = simhash.edited_fingerprints(frame(spark, odd_rows()))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    assert simhash.edited_fingerprints(frame(spark, [])).collect() == []


# Sentence pieces

ODD = ["", " ", "  ", "\n", "\x00a", "▁", "a▁b", "▁▁ x", " ▁", "日本語 テスト", "😀 a", "a  b   c", "\t\t", "<s>", "<unk>", "trail  ", "é" * 100, "a" * 300, " " * 40, "⁇", "x​", "ab" * 90 + " thention"]


def test_pieces_equal_library(spark):
    import random

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    model = pieces.PieceModel(PIECE_BPE, keep=50)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" ▁\nabé日😀<s>\x01́thening") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text.encode()).tolist() == ids
        assert model.decode(model.encode(text.encode())) == library.decode(ids)
        raw, spans, at = text.encode(), model.spans(text.encode()), 0
        assert [k for k, _, _ in spans] == ids[1:-1]
        for _, low, high in spans:  # the spans cover the text in order without a gap
            assert low <= at <= high or low == at
            at = max(at, high)
        assert at == len(raw)
        assert spans == spans_slowly(model, raw, ids[1:-1])
    for ids in ([259, 200, 200, 13, 300], [3, 131, 260, 0, 5], [1, 2], [231, 154, 136, 233]):
        assert model.decode(np.array(ids)) == library.decode(ids)
    rows = [*odd_rows(), *enumerate(ODD, 300)]
    found = pieces.encode_digests(frame(spark, rows), PIECE_BPE).collect()
    expected = []
    for key, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digests = (hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids).encode()))
        raw = (text or "").encode()
        spans = [(ids[0], 0, 0), *spans_slowly(model, raw, ids[1:-1]), (ids[-1], len(raw), len(raw))]
        placed = hashlib.sha256(np.array(spans, "<u4").tobytes()).hexdigest()
        expected.append((str(key), len(ids), *digests, placed))
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(expected)


def spans_slowly(model, raw, ids):
    """Original bytes of each piece, character by character; the mark that is put before a text has none."""
    places, at = [(0, 0)] if raw else [], 0
    for character in raw.decode():
        places.append((at, at + len(character.encode())))
        at = places[-1][1]
    out, k, used = [], 0, 0
    for piece in ids:
        if piece in model.bytes_of:
            out.append((piece, *places[k]))
            used += 1
            if used == places[k][1] - places[k][0]:
                k, used = k + 1, 0
        else:
            more = k + len(model.names[piece])
            out.append((piece, places[k][0], places[more - 1][1]))
            k = more
    return out


def test_character_map_takes_the_longest_prefix():
    """A small double-array trie: 'a' -> 'x', 'ab' -> 'yz'; spans go back to the bytes read."""
    model = pieces.PieceModel(PIECE_BPE)
    rules = {b"a": b"x", b"ab": b"yz"}
    model.map = type("Map", (), {"units": [0], "longest": staticmethod(
        lambda data, at: next(((n, rules[data[at : at + n]]) for n in (2, 1) if data[at : at + n] in rules), None)
    )})()
    clean, source = model.normalised("abaé".encode())
    assert clean == "yzxé".encode() and source.tolist() == [0, 0, 2, 3, 3, 5]
    assert model.spans("abaé".encode())[-1][1:] == (3, 5)
