"""Language identification with a bidirectional gated recurrent network over bytes.

A text is read in stretches of ``STRETCH`` bytes. In each, one network runs forward and one backward over the bytes; both
states label every position with a language, and the mean of the log probabilities over all positions of the text is its
score for each language. Every byte of a text is read. Stretches are grouped by length so that one numpy step moves a few
thousand of them; gates use the rational function x / (1 + |x|), which costs less than the exponential.

The network is fitted by backpropagation through time, on the driver, with a sample of at most ``SAMPLE`` labelled texts
(thinned and chosen by hashed ids) and one stretch of each at most ``SAMPLE_STRETCHES`` times; both are parameters.

Null text and text without a letter get ``und`` and score 0. Rows without a language are predicted but not learned from.
Without any labelled row every text is ``und``. Repeated rows are predicted each by itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.shared import batches_of, hashed_sample, raw_texts

UNDECIDED = "und"
STRETCH = 96
WIDTH = 6
PADDING = 256  # code of a place without a byte
SAMPLE = 1500
SAMPLE_STRETCHES = 6
STEPS = 260
AT_ONCE = 1024


@dataclass
class Network:
    """Weights: per direction the byte table (256 and padding, 2w), the recurrence (w, 2w); labels from both states."""

    langs: list[str]
    tables: list[np.ndarray]
    loops: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.loops, self.out, self.bias]


def _gate(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def run_direction(codes: np.ndarray, table: np.ndarray, loop: np.ndarray) -> np.ndarray:
    """States (steps, texts, w) of a minimal gated unit; ``codes`` is (steps, texts).

    z = 1/2 + gate/2, h' = h + z (candidate - h), where gate and candidate come from the byte and the state before.
    """
    steps, texts = codes.shape
    w = loop.shape[0]
    states = np.empty((steps, texts, w), np.float32)
    h = np.zeros((texts, w), np.float32)
    for t in range(steps):
        a = np.take(table, codes[t], axis=0)
        a += h @ loop
        a /= 1 + np.abs(a)
        z = a[:, :w]
        z *= 0.5
        z += 0.5
        c = a[:, w:]
        c -= h
        c *= z
        h = np.add(h, c, out=states[t])
    return states


def position_labels(net: Network, codes: np.ndarray) -> np.ndarray:
    """Log probability of each language at each position, (steps, texts, languages)."""
    ahead = run_direction(codes, net.tables[0], net.loops[0])
    back = run_direction(codes[::-1], net.tables[1], net.loops[1])[::-1]
    w = net.loops[0].shape[0]
    x = ahead @ net.out[:w]
    x += back @ net.out[w:]
    x += net.bias
    x -= np.log(np.exp(x).sum(-1, keepdims=True))  # states lie in (-1, 1), so the exponential can't overflow
    return x


def _step_back(codes, table, loop, states, grad):
    """Gradients of the byte table and the recurrence, given those of the states."""
    steps, texts = codes.shape
    w = loop.shape[0]
    g_table, g_loop = np.zeros_like(table), np.zeros_like(loop)
    g_h = np.zeros((texts, w), np.float32)
    for t in range(steps - 1, -1, -1):
        h = states[t - 1] if t else np.zeros((texts, w), np.float32)
        a = table[codes[t]] + h @ loop
        s = 1 / (1 + np.abs(a))
        a *= s
        z, c = 0.5 + 0.5 * a[:, :w], a[:, w:]
        g = grad[t] + g_h
        g_a = np.concatenate([g * (c - h) * 0.5, g * z], 1) * (s * s)
        np.add.at(g_table, codes[t], g_a)
        g_loop += h.T @ g_a
        g_h = g * (1 - z) + g_a @ loop.T
    return g_table, g_loop


def fit(samples: list[tuple[bytes, str]], width: int = WIDTH, steps: int = STEPS, seed: int = 7) -> Network | None:
    """Train on stretches of labelled texts."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    pieces, labels = [], []
    for text, lang in samples:
        if len(text) >= STRETCH:
            for at in rng.integers(0, len(text) - STRETCH + 1, min(SAMPLE_STRETCHES, len(text) // STRETCH)):
                pieces.append(np.frombuffer(text, np.uint8, STRETCH, at))
                labels.append(langs.index(lang))
    if not pieces:  # short texts only: repeated up to the length of a stretch
        for text, lang in samples:
            if text:
                pieces.append(np.resize(np.frombuffer(text, np.uint8), STRETCH))
                labels.append(langs.index(lang))
    if not pieces:
        return None
    codes, target = np.array(pieces), np.array(labels)
    shape = lambda *n: (rng.standard_normal(n) * 0.3).astype(np.float32)
    net = Network(langs, [shape(PADDING + 1, 2 * width) for _ in "fb"], [shape(width, 2 * width) for _ in "fb"],
                  shape(2 * width, len(langs)), np.zeros(len(langs), np.float32))
    # Languages weigh alike, however many texts each has.
    weight = (len(target) / np.maximum(np.bincount(target, minlength=len(langs)), 1) / len(langs)).astype(np.float32)
    means = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(codes), 192)
        x, y = codes[pick].T, target[pick]
        ahead = run_direction(x, net.tables[0], net.loops[0])
        back = run_direction(x[::-1], net.tables[1], net.loops[1])
        both = np.concatenate([ahead, back[::-1]], 2)
        logits = both @ net.out + net.bias
        e = np.exp(logits - logits.max(-1, keepdims=True))
        e /= e.sum(-1, keepdims=True)
        e[:, np.arange(len(y)), y] -= 1
        e *= (weight[y] / e.shape[0] / len(y))[:, None]
        g_both = e @ net.out.T
        forward = _step_back(x, net.tables[0], net.loops[0], ahead, g_both[:, :, :width])
        backward = _step_back(x[::-1], net.tables[1], net.loops[1], back, g_both[::-1, :, width:])
        grads = [forward[0], backward[0], forward[1], backward[1],
                 np.einsum("tbw,tbl->wl", both, e), e.sum((0, 1))]
        rate = 0.03 * min(1, 4 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), grads, means, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    for table in net.tables:
        table[PADDING, :width], table[PADDING, width:] = -1e9, 0  # the update gate is shut
    return net


def predict(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean log probability of each language over the positions of each text."""
    sums = np.zeros((len(texts), len(net.langs)))
    sizes = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[owner] + number * STRETCH
    length = np.minimum(sizes[owner] - number * STRETCH, STRETCH)
    # Stretches of one step batch have about one length; the rest of the shorter ones is padding, which moves no state.
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), AT_ONCE):
        own = order[k : k + AT_ONCE]
        steps = np.arange(length[own[0]])[:, None]
        inside = steps < length[own]
        codes = np.where(inside, joined[np.minimum(start[own] + steps, len(joined) - 1)], PADDING)
        labels = position_labels(net, codes)
        if not inside[-1].all():
            labels *= inside[:, :, None]
        np.add.at(sums, owner[own], labels.sum(0))
    return sums / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, learnable: Column, size: int = SAMPLE) -> list[tuple[bytes, str]]:
    """At most ``size`` labelled texts, and of a long one 16 KB from its middle."""
    rows = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = hashed_sample(rows, size)
    middle = F.greatest(F.lit(1), (F.length("text") / 2 - 8192).cast("int"))
    return [(r[0].encode(), r[1]) for r in chosen.select(F.substring("text", middle, F.lit(16384)), "lang").collect()]


SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document the language and its probability; the mean over positions, so 1 means certain at each."""

    def label(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, 2 << 20):
            has = np.array(batch.column("letters").to_pylist(), bool)
            lang, score = np.full(len(has), UNDECIDED, object), np.zeros(len(has))
            if net is not None and has.any():
                means = predict(net, [t for t, h in zip(raw_texts(batch), has, strict=True) if h])
                best = means.argmax(1)
                p = np.exp(means - means.max(1, keepdims=True))
                lang[has] = np.array(net.langs, object)[best]
                score[has] = 1 / p.sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", letters).mapInArrow(label, SCHEMA)


def with_language(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The rows of ``docs`` that have a language of at least the probability ``least``, unchanged."""

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, 2 << 20):
            kept = np.zeros(batch.num_rows, bool)
            if net is not None:
                means = predict(net, raw_texts(batch))
                p = np.exp(means - means.max(1, keepdims=True))
                kept = 1 / p.sum(1) >= least
            yield batch.filter(pa.array(kept))

    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    return lettered.mapInArrow(keep, docs.schema)
