"""Scoring of texts with a small causal language model.

The model reads subword ids of a published tokenizer. Ids in common use are classes of their own and the rest share one;
in that class the ids are told apart by their counts. Classes are predicted in two steps, a family of classes of like
frequency and then the member, which costs two short softmaxes. A family's ids either all begin a word or all go on with
one, so the first softmax also tells how likely a word ends. One layer of causal self-attention sees the last ``CONTEXT`` ids:
a query from the id, keys and values from the ids in reach, with a learned weight for each distance; a feed-forward layer
reads what attention brings beside the id and the one before it, and the softmaxes follow.

It is trained in numpy by gradient descent, first on a few texts to a common start, and then on the whole of all training
texts. Rounds of a part of the texts each deal them to trainers of about ``TRAINER_BYTES``, and no more than
``TRAINER_TEXTS``; every trainer goes on from the same weights, and the round ends with their average.

Long texts are scored in windows that overlap by the context: each window scores its last ``STRIDE`` ids, so each id is
scored once with its whole context. Windows of many texts go through the attention as one batch under one mask.

A word's probability mixes two parts: the chain of its subwords under the model, and its share of the training words. The
chain is that of the first id, given that a word begins, times that of each further id, times that of the word's end: that
the id after it begins a word. (A text ends with its end token, which has no end of its own.) Both parts sum to at most 1
over all words. The counts of words and of subwords come from all training texts: groups of documents send their distinct
words to buckets of the word's hash, which answer with the totals.

Text is lower-cased (A-Z) and cut into words at ASCII white space; each text ends with one end token. Null text is empty
text: an end token alone. Repeated rows are scored and counted each by itself; groups follow the hash of id and text, so
rows without an id spread out. Without training texts every score uses uniform counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.anchors import in_order
from tallybeam.llm.packing import encoder
from tallybeam.llm.shared import (
    GROUP_BYTES,
    PACKED,
    added_up,
    hashed_sample,
    id_or_least,
    id_or_null,
    pack,
    packed,
    raw_texts,
    split_by,
    stored,
    text_bytes,
    text_or_empty,
    unpack,
)

CONTEXT = 16
STRIDE = 16
WIDTH = 16
HIDDEN = 32
FAMILIES = 32
MEMBERS = 32
SAMPLE = 1500
SAMPLE_IDS = 400
STEPS = 1000
ROUNDS = 2
TRAINER_TEXTS = 20_000
TRAINER_BYTES = 8 << 20
MIX = 0.5
PORTION = 1 << 19
AT_ONCE = 2048
BATCH = 96
LOCAL_RATE = 0.004
BLOCK = 64

SPACE = "Ġ"  # fixed value: how byte-level vocabularies write a space
END_WORD = b" "  # no word has a space, so it can stand for the end token


class Subwords:
    """Ids of words; each word is encoded by itself with a leading space."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.size = self.encoder.library.get_vocab_size() + 1
        self.end = self.size - 1

    def begins(self) -> np.ndarray:
        """Which ids stand at the beginning of a word, which is encoded with a space before it."""
        out = np.zeros(self.size, bool)
        for token, k in self.encoder.library.get_vocab().items():
            out[k] = token.startswith(SPACE)
        out[self.end] = True
        return out

    def ids(self, word: bytes) -> list[int]:
        return [self.end] if word == END_WORD else self.encoder(" " + word.decode(errors="replace")) or [self.end]

    def packed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids of all words end to end."""
        coded = [self.ids(w) for w in words]
        return np.fromiter(map(len, coded), np.int64, len(coded)), np.array([i for ids in coded for i in ids], np.int32)


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


@dataclass
class Model:
    """Weights, the class of each subword id, and the log10 share of each id in its class."""

    class_of: np.ndarray
    share: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    word_families: int = 0  # the first families, whose ids begin a word

    @property
    def start(self) -> int:
        """The class that stands before a text."""
        return len(self.weights["embed"]) - 1


def new_model(
    counts: np.ndarray,
    families: int = FAMILIES,
    members: int = MEMBERS,
    width: int = WIDTH,
    hidden: int = HIDDEN,
    seed: int = 3,
    begins: np.ndarray | None = None,
) -> Model:
    """An untrained model whose classes follow the counts of subword ids; class k is member k % members of a family.

    ``begins`` tells which ids begin a word (without it, all do). They have the first families, as many as their part of the
    common ids; the last class of either kind holds its rare ids.
    """
    n = families * members
    begins = np.ones(len(counts), bool) if begins is None else begins
    common = np.argsort(-counts, kind="stable")[: n - 1]
    word_families = families
    if not begins.all():
        word_families = int(np.clip(round(families * begins[common].mean()), 1, families - 1))
    class_of = np.empty(len(counts), np.int32)
    for kind, low, high in ((begins, 0, word_families * members), (~begins, word_families * members, n)):
        own = np.flatnonzero(kind)
        own = own[np.argsort(-counts[own], kind="stable")]
        class_of[own] = np.minimum(low + np.arange(len(own)), high - 1)
    weight = counts + 0.5
    share = np.log10(weight) - np.log10(np.maximum(np.bincount(class_of, weight, n), 0.5))[class_of]
    rng = np.random.default_rng(seed)
    make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    weights = {
        "embed": (rng.standard_normal((n + 1, width)) * 0.5).astype(np.float32),
        "query": make(width, width), "key": make(width, width), "value": make(width, width),
        "distance": np.zeros(CONTEXT, np.float32),
        "into": make(3 * width, hidden), "into_bias": np.zeros(hidden, np.float32),
        "family": make(hidden, families), "family_bias": np.zeros(families, np.float32),
        "member": make(families, hidden, members), "member_bias": np.zeros((families, members), np.float32),
    }
    return Model(class_of, share.astype(np.float32), weights, word_families)


def _mask() -> tuple[np.ndarray, np.ndarray]:
    """For the queries of a window (rows) and the places in reach (columns): the distance, and whether it is seen.

    Columns are the CONTEXT places before the window and its own; a query sees itself and the CONTEXT - 1 places before.
    """
    away = CONTEXT + np.arange(STRIDE)[:, None] - np.arange(CONTEXT + STRIDE)[None, :]
    return np.clip(away, 0, CONTEXT - 1), (away >= 0) & (away < CONTEXT)


AWAY, SEEN = _mask()


def forward(model: Model, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """State from which the next class is predicted; ``before`` (windows, CONTEXT + STRIDE) holds the classes read."""
    w = model.weights
    x = w["embed"][before]
    own, previous = x[:, CONTEXT:], x[:, CONTEXT - 1 : -1]
    q, k, v = own @ w["query"], x @ w["key"], x @ w["value"]
    a = q @ k.transpose(0, 2, 1)
    a *= np.float32(1 / np.sqrt(q.shape[2]))
    a += np.where(SEEN, w["distance"][AWAY], np.float32(-1e9))
    a -= a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    joined = np.concatenate([own, previous, a @ v], -1)
    h = joined @ w["into"]
    h += w["into_bias"]
    np.maximum(h, 0, out=h)
    return h, joined, a, q, k, v, x


def _by_family(target: np.ndarray, members: int):
    """Rows of each family among targets, and the member that each row has."""
    family = (target // members).astype(np.uint8 if target.max(initial=0) < 256 * members else np.int64)
    order = np.argsort(family, kind="stable")
    ends = np.cumsum(np.bincount(family))
    begin = 0
    for f, end in enumerate(ends.tolist()):
        if end > begin:
            rows = order[begin:end]
            yield f, rows, target[rows] - f * members
        begin = end


def scorer(model: Model):
    """Natural log of the probability of target classes, and on request of that a word begins there; what depends on one
    class alone is looked up in tables."""
    w = model.weights
    width, members = w["query"].shape[0], w["member"].shape[2]
    q_of = w["embed"] @ w["query"] * np.float32(1 / np.sqrt(width))
    k_of, v_of = w["embed"] @ w["key"], w["embed"] @ w["value"]
    own_of = w["embed"] @ w["into"][:width] + w["into_bias"]
    previous_of = w["embed"] @ w["into"][width : 2 * width]
    into = w["into"][2 * width :]
    reach = np.where(SEEN, w["distance"][AWAY], np.float32(-1e9))
    before_type = into.dtype
    ones = np.ones((reach.shape[1], 1), before_type)
    in_word = np.ones((w["family"].shape[1], 2), before_type)  # sums over all families, and over those that begin a word
    in_word[model.word_families :, 1] = 0
    of_member = np.ones(members, before_type)

    def exponents(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The chosen logits; ``logits`` become their exponents."""
        own = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + which)
        if logits.max(initial=0) > 60:
            top = logits.max(-1)
            logits -= top[:, None]
            own = own - top
        np.exp(logits, out=logits)
        return own

    def states(before: np.ndarray) -> np.ndarray:
        own = before[:, CONTEXT:]
        a = q_of.take(own, 0) @ k_of.take(before, 0).transpose(0, 2, 1)
        a += reach
        if a.max() > 60:
            a -= a.max(-1, keepdims=True)
        np.exp(a, out=a)
        seen = a @ v_of.take(before, 0)
        seen /= a @ ones
        h = seen.reshape(-1, width) @ into
        h += own_of.take(own.ravel(), 0)
        h += previous_of.take(before[:, CONTEXT - 1 : -1].ravel(), 0)
        return np.maximum(h, 0, out=h)

    def log_odds(before: np.ndarray, target: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        flat = target.ravel()
        family = flat // members
        out, h = np.empty(len(flat), before_type), np.empty((len(flat), into.shape[1]), before_type)
        for k in range(0, len(before), BLOCK):  # small enough for the cache; families are gathered over all of them
            part = slice(k * STRIDE, (k + BLOCK) * STRIDE)
            h[part] = states(before[k : k + BLOCK])
            logits = h[part] @ w["family"]
            logits += w["family_bias"]
            own = exponents(logits, family[part])
            sums = np.log(np.maximum(logits @ in_word, 1e-38))
            out[part] = own - sums[:, 0]
            if begin is not None:
                begin[k : k + BLOCK] = np.minimum(sums[:, 1] - sums[:, 0], 0).reshape(-1, STRIDE)
        for f, rows, member in _by_family(flat, members):
            logits = h.take(rows, 0) @ w["member"][f]
            logits += w["member_bias"][f]
            own = exponents(logits, member)
            out[rows] += own - np.log(logits @ of_member)
        return out.reshape(target.shape)

    return log_odds


def _softmax_error(logits: np.ndarray, which: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted loss by the logits."""
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    p[np.arange(len(p)), which] -= 1
    p *= weight[:, None]
    return p


def _gradients(model: Model, before: np.ndarray, target: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
    w = model.weights
    h, joined, a, q, k, v, x = forward(model, before)
    width, members = x.shape[2], w["member"].shape[2]
    flat = lambda m: m.reshape(-1, m.shape[-1])
    weight = (counted / max(counted.sum(), 1)).ravel().astype(h.dtype)
    states, which = flat(h), target.ravel()
    p = _softmax_error(states @ w["family"] + w["family_bias"], which // members, weight)
    g = {"family": states.T @ p, "family_bias": p.sum(0)}
    g_h = p @ w["family"].T
    g["member"], g["member_bias"] = np.zeros_like(w["member"]), np.zeros_like(w["member_bias"])
    for f, rows, member in _by_family(which, members):
        p = _softmax_error(states[rows] @ w["member"][f] + w["member_bias"][f], member, weight[rows])
        g["member"][f], g["member_bias"][f] = states[rows].T @ p, p.sum(0)
        g_h[rows] += p @ w["member"][f].T
    g_h = g_h.reshape(h.shape) * (h > 0)
    g["into"], g["into_bias"] = flat(joined).T @ flat(g_h), flat(g_h).sum(0)
    g_joined = g_h @ w["into"].T
    g_own, g_previous, g_seen = (g_joined[..., i * width : (i + 1) * width] for i in range(3))
    g_a = g_seen @ v.transpose(0, 2, 1)
    g_v = a.transpose(0, 2, 1) @ g_seen
    g_score = a * (g_a - (g_a * a).sum(-1, keepdims=True))
    g["distance"] = np.bincount(AWAY[SEEN], g_score.sum(0)[SEEN], CONTEXT).astype(h.dtype)
    g_score *= np.float32(1 / np.sqrt(width))
    g_q, g_k = g_score @ k, g_score.transpose(0, 2, 1) @ q
    own = x[:, CONTEXT:]
    g["query"], g["key"], g["value"] = flat(own).T @ flat(g_q), flat(x).T @ flat(g_k), flat(x).T @ flat(g_v)
    g_x = g_k @ w["key"].T + g_v @ w["value"].T
    g_x[:, CONTEXT:] += g_own + g_q @ w["query"].T
    g_x[:, CONTEXT - 1 : -1] += g_previous
    g["embed"] = np.zeros_like(w["embed"])
    np.add.at(g["embed"], before, g_x)
    return g


def windows(sequences: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of class sequences: classes read, classes to predict, and which of these are real.

    Before a text stands the start class; the places of a text's last window beyond its end don't count.
    """
    counts = [-(-len(s) // STRIDE) for s in sequences]
    read = np.full((sum(counts), CONTEXT + STRIDE), start, np.int32)
    target = np.zeros((len(read), STRIDE), np.int64)
    real = np.zeros((len(read), STRIDE), bool)
    at = 0
    for s, n in zip(sequences, counts, strict=True):
        padded = np.full(CONTEXT + 1 + n * STRIDE, start, np.int32)
        padded[CONTEXT + 1 : CONTEXT + 1 + len(s)] = s
        rows = np.arange(n)[:, None] * STRIDE
        read[at : at + n] = padded[rows + np.arange(CONTEXT + STRIDE)]
        target[at : at + n] = np.where((own := padded[rows + CONTEXT + 1 + np.arange(STRIDE)]) == start, 0, own)
        real[at : at + n] = rows + np.arange(STRIDE) < len(s)
        at += n
    return read, target, real


def fit(model: Model, sequences: list[np.ndarray], steps: int | None = STEPS, seed: int = 5, rate: float = 0.015) -> Model:
    """Train the weights on class sequences by Adam; without ``steps`` each window is seen once."""
    if not sequences:
        return model
    read, target, real = windows(sequences, model.start)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(read))
    many = steps or -(-len(read) // BATCH)
    means = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in model.weights.items()}
    for step in range(1, many + 1):
        pick = rng.integers(0, len(read), BATCH) if steps else order[(step - 1) * BATCH : step * BATCH]
        grads = _gradients(model, read[pick], target[pick], real[pick])
        now = rate * min(1, 3 * (1 - step / (many + 1)))
        for name, x in model.weights.items():
            m, v = means[name]
            m += 0.1 * (grads[name] - m)
            v += 0.01 * (grads[name] ** 2 - v)
            x -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit_on_all(model: Model, docs: DataFrame, training: Column, path: str, rounds: int = ROUNDS, trainer_texts: int = TRAINER_TEXTS) -> Model:
    """Train on the whole of every training text: rounds of trainers that go on from the same weights, then their average.

    A text belongs to one round and one trainer, by its hash. Weights of a trainer count as often as it has ids.
    """
    texts = docs.filter(training).select("doc_id", text_or_empty().alias("text"))
    rows = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    many, size_of_all = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    trainers = max(1, -(-many // (rounds * trainer_texts)), -(-size_of_all // (rounds * TRAINER_BYTES)))
    place = F.pmod("key", F.lit(rounds * trainers))
    for turn in range(rounds if many else 0):
        start = model

        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("key", "ascending"), ("text", "ascending")])
            coder, known, sequences = subwords(path), {}, []
            for text in raw_texts(table):
                ids = []
                for word in words_of(text):
                    if word not in known:
                        known[word] = coder.ids(word)
                    ids += known[word]
                sequences.append(start.class_of[ids])
            own = Model(start.class_of, start.share, {k: v.copy() for k, v in start.weights.items()}, start.word_families)
            fit(own, sequences, None, rate=LOCAL_RATE / (turn + 1))
            size = sum(map(len, sequences))
            return pa.table({"blob": pa.array([pack(size, *[v * np.float64(size) for v in own.weights.values()])], pa.binary())})

        dealt = rows.filter(F.floor(place / F.lit(trainers)) == turn).withColumn("trainer", place % trainers)
        # Much work: a stated number of partitions keeps Spark from putting trainers together.
        dealt = dealt.repartition(2 * trainers, "trainer")
        # Stored, because the sum reads one partition after the other, which would run the trainers one by one.
        trained = stored(dealt.groupBy("trainer").applyInArrow(train, "blob binary"), "trained")
        total = added_up(trained, trainers)
        if total is not None and total[0]:
            weights = {k: (v / total[0]).astype(x.dtype) for (k, x), v in zip(model.weights.items(), total[1:], strict=True)}
            model = Model(model.class_of, model.share, weights, model.word_families)
    return model


def scores(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each subword id given those before it, and of that a word begins there, texts end to end."""
    classes = [model.class_of[t] for t in texts]
    read, target, real = windows(classes, model.start)
    out, begin, log_odds = np.empty(target.shape, np.float32), np.empty(target.shape, np.float32), scorer(model)
    for k in range(0, len(read), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        out[part] = log_odds(read[part], target[part], begin[part])
    scale = np.float32(1 / np.log(10))
    return out[real] * scale + model.share[np.concatenate(texts)], begin[real] * scale


def id_scores(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    return scores(model, texts)[0]


def word_chains(model: Model, texts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """log10 probability of each word by its subwords and its end; ``first`` are the places of the words' first ids.

    The last word of a text is its end token, one id that nothing follows.
    """
    ids, begin = scores(model, texts)
    ids, begin = ids.astype(np.float64), begin.astype(np.float64)[first]
    ends = np.append(begin[1:], 0.0)
    last = np.searchsorted(first, np.cumsum([len(t) for t in texts]), "left") - 1
    ends[last] = 0.0
    return np.add.reduceat(ids, first) - begin + ends


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END_WORD]


def _bucket(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _groups(docs: DataFrame, training: Column, group_bytes: int) -> tuple[DataFrame, int]:
    groups = max(1, -(-text_bytes(docs) // group_bytes))
    rows = docs.select(id_or_least().alias("id"), text_or_empty().alias("text"), (~training).alias("held_out"))
    g = F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("int")
    return rows.withColumn("g", g).repartition("g"), groups


def _numbered(table: pa.Table) -> tuple[Numbers, list[tuple[list[int], list[np.ndarray]]]]:
    """The distinct words of a group in the order in which its sorted texts have them, and ids and word numbers by portion."""
    number = Numbers()
    portions = [(ids, [number.of(words_of(text)) for text in texts]) for ids, texts in in_order(table, PORTION)]
    return number, portions


def _held(table: pa.Table) -> dict[int, bool]:
    return dict(zip(table.column("id").to_pylist(), table.column("held_out").to_pylist(), strict=True))


def _training_counts(portions: Iterable[tuple[list[int], list[np.ndarray]]], held: dict[int, bool], kinds: int) -> np.ndarray:
    counts = np.zeros(kinds, np.int64)
    for ids, texts in portions:
        own = [t for key, t in zip(ids, texts, strict=True) if not held[key]]
        if own:
            counts += np.bincount(np.concatenate(own), minlength=kinds)
    return counts


TOTALS = "g int, bucket int, blob binary, tokens long, kinds long, ids array<long>, id_counts array<long>"
SCHEMA = "id long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def score_texts(docs: DataFrame, path: str, training: Column, mix: float = MIX, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``training`` tells which documents are learned from; ``path`` is the tokenizer's file on every worker.
    """
    rows, groups = _groups(docs, training, group_bytes)
    buckets = max(1, groups // 4)

    def announce(table: pa.Table) -> pa.Table:
        number, portions = _numbered(table)
        words, counts = list(number), _training_counts(portions, _held(table), len(number))
        g = table.column("g")[0].as_py()
        return packed([
            (g, b, pack(b"\n".join([words[k] for k in at]), counts[at])) for b, at in split_by(_bucket(words, buckets))
        ])

    def total(table: pa.Table) -> pa.Table:
        sent = [unpack(b) for b in table.column("blob").to_pylist()]
        lists = [joined.split(b"\n") for joined, _ in sent]
        totals: dict[bytes, int] = {}
        for words, (_, counts) in zip(lists, sent, strict=True):
            for word, count in zip(words, counts.tolist(), strict=True):
                totals[word] = totals.get(word, 0) + count
        # Each distinct word is encoded here, once; groups get the ids with the totals.
        words = list(totals)
        weight = np.fromiter(totals.values(), np.int64, len(words))
        sizes, ids = subwords(path).packed(words)
        ends = np.cumsum(sizes)
        id_counts = np.bincount(ids, np.repeat(weight, sizes), subwords(path).size).astype(np.int64)
        used = np.flatnonzero(id_counts)
        number = {w: k for k, w in enumerate(words)}
        out = []
        for k, (g, own) in enumerate(zip(table.column("g").to_pylist(), lists, strict=True)):
            at = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            picked = np.repeat(ends[at] - np.cumsum(sizes[at]), sizes[at]) + np.arange(sizes[at].sum())
            answer = pack(weight[at], sizes[at].astype(np.int32), ids[picked].astype(np.uint16 if subwords(path).size < 65536 else np.int32))
            facts = (int(weight.sum()), int((weight > 0).sum()), used, id_counts[used]) if k == 0 else (0, 0, [], [])
            out.append((g, table.column("bucket")[0].as_py(), answer, *facts))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["g", "bucket", "blob", "tokens", "kinds", "ids", "id_counts"]
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds, strict=True)})

    announced = rows.groupBy("g").applyInArrow(announce, PACKED)
    totals = stored(announced.groupBy("bucket").applyInArrow(total, TOTALS), "word-totals")
    tokens, kinds = totals.agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = tokens or 0, kinds or 0
    coder = subwords(path)
    # At most one row for each id of the vocabulary.
    id_counts = np.zeros(coder.size, np.int64)
    pairs = totals.select(F.explode(F.arrays_zip("ids", "id_counts")).alias("one")).groupBy("one.ids").agg(F.sum("one.id_counts").alias("n"))
    for row in pairs.collect():
        id_counts[row[0]] = row[1]
    model = new_model(id_counts, begins=coder.begins())
    fit(model, [model.class_of[s] for s in training_sequences(docs, training, coder)])
    model = fit_on_all(model, docs, training, path)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        number, portions = _numbered(table)
        words = list(number)
        # Per word its count, how many ids it has, and where they begin in the pool.
        counts, n_ids, begin = np.zeros(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pool, pooled = [np.zeros(0, np.int32)], 0
        lists = dict(split_by(_bucket(words, buckets)))
        for bucket, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
            at = lists[bucket]
            counts[at], sizes, ids = unpack(blob)
            n_ids[at] = sizes
            begin[at] = pooled + np.cumsum(n_ids[at]) - n_ids[at]
            pool.append(ids.astype(np.int32))
            pooled += len(ids)
        pool = np.concatenate(pool)
        share, log_count = counts / max(tokens, 1), np.log10(counts + 0.5)
        held = _held(table)
        columns: list[list] = [[] for _ in range(6)]
        for keys, texts in portions:
            sizes = np.array([len(own) for own in texts])
            flat = np.concatenate(texts)
            lengths = n_ids[flat]
            first = np.cumsum(lengths) - lengths
            ids = pool[np.repeat(begin[flat] - first, lengths) + np.arange(lengths.sum())]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            chained = word_chains(model, np.split(ids, first[starts[1:]]), first)
            known = share[flat] > 0
            both = chained + np.log10(1 - mix)
            both[known] = np.log10(mix * share[flat][known] + (1 - mix) * 10.0 ** np.maximum(chained[known], -300))
            for column, values in zip(columns, (
                keys, [held[k] for k in keys], sizes, np.add.reduceat(counts[flat] > 0, starts, dtype=np.int64),
                np.add.reduceat(log_count[flat], starts), np.add.reduceat(both, starts),
            ), strict=True):
                column.extend(values.tolist() if isinstance(values, np.ndarray) else values)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["id", "held_out", "n_tokens", "n_known", "base_sum", "score"]
        return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds, strict=True)})

    found = rows.groupBy("g").cogroup(totals.select("g", "bucket", "blob").groupBy("g")).applyInArrow(score, SCHEMA)
    base = F.col("base_sum") - F.col("n_tokens") * F.log10(F.lit(tokens + 0.5 * (kinds + 1)))
    return found.select(
        id_or_null("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
    )


def _begin(length: int) -> Column:
    """A place in a text that leaves room for a stretch, picked by the hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - F.lit(length), F.lit(1))).cast("int") + 1


def stretch(length: int) -> Column:
    return F.substring("text", _begin(length), F.lit(length))


def stretch_words(text: str, from_start: bool, length: int) -> list[bytes]:
    """Whole words of a stretch: its first may be cut unless it begins the text, its last unless it ends it."""
    return words_of(text.encode())[0 if from_start else 1 : None if len(text) < length else -2]


def training_sequences(docs: DataFrame, training: Column, coder: Subwords, size: int = SAMPLE) -> list[np.ndarray]:
    """Subword ids of at most ``size`` training texts, from a place in each that its hash picks."""
    length = 3 * SAMPLE_IDS
    rows = hashed_sample(docs.filter(training & F.col("text").isNotNull()), size)
    out = []
    for row in rows.select(stretch(length), _begin(length) == 1).collect():
        words = stretch_words(row[0], row[1], length)
        if words:
            out.append(coder.packed(words)[1][:SAMPLE_IDS])
    return out
