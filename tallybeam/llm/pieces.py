"""Encoding with a published sentence-piece BPE model that keeps the place of every piece in the original bytes.

Normalisation walks the text with the model's compiled character map, a double-array trie: at each place the longest rule
that matches is applied, else one character is copied, and every normalised byte remembers the original byte it came from.
Merging pairs of pieces by their scores gives the pieces; each is projected through that alignment to a span of original
bytes. A model whose map is empty copies every character.

Two neighbouring characters that stand side by side in no piece are never merged across, so a text falls apart there
into stretches that are merged one by one; stretches seen lately are remembered. No piece has a space mark after another
character, so each word is such a stretch or several. A model for which this doesn't hold is refused.

Null text is empty text: only the begin and end ids. Repeated rows are encoded each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybeam.llm.shared import batches_of, text_or_empty

# Fixed values of the model format: field numbers, piece types and the mark that stands for a space.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
MARK_BYTES = MARK.encode()
UNKNOWN_TEXT = " ⁇ "
NO_PAIR = -float("inf")
LONG = 48  # characters beyond which a stretch is merged with a heap and not remembered


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = varint() if size is None else size
            yield key >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: trie size, double-array trie, zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.targets = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed and their replacement by the longest rule that matches at ``at``."""
        units, found, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.targets.index(0, found[1])
        return found[0], self.targets[found[1] : end]


class Remembered(dict):
    """Results of a function for the keys seen lately, long keys excepted."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep = make, keep

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < LONG:
            if len(self) >= self.keep:
                self.clear()
            self[key] = value
        return value


class PieceModel:
    """Pieces, scores and normalisation of one model file."""

    def __init__(self, path: str, keep: int = 500_000):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for number, value in fields if number == 1]
        trainer = dict(_fields(next(value for number, value in fields if number == 2)))
        rules = dict(_fields(next((value for number, value in fields if number == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not a BPE model")
        self.names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        self.scores = {
            name: struct.unpack("<f", p[2])[0] if 2 in p else 0.0
            for name, p, kind in zip(self.names, pieces, kinds, strict=True)
            if kind == NORMAL
        }
        if any(kind in (USER, UNUSED) for kind in kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {name: k for k, name in enumerate(self.names)}
        self.unknown = kinds.index(UNKNOWN)
        self.begin, self.end = self.ids["<s>"], self.ids["</s>"]
        self.byte_ids = [self.ids[f"<0x{b:02X}>"] for b in range(256)]
        self.bytes_of = {k: int(self.names[k][3:5], 16) for k, kind in enumerate(kinds) if kind == BYTE}
        self.silent = {k for k, kind in enumerate(kinds) if kind == CONTROL}
        if any(MARK in name.lstrip(MARK) for name in self.scores):
            raise ValueError("pieces with a space mark inside are not supported")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        if not self.escape:
            raise ValueError("models that do not escape spaces are not supported")
        self.pairs = {name[k : k + 2] for name in self.scores for k in range(len(name) - 1)}
        self.words, self.stretches = Remembered(self._word_ids, keep), Remembered(self._stretch_ids, keep)
        self.width_of = np.array([1 if k in self.bytes_of else len(name.encode()) for k, name in enumerate(self.names)])
        self.is_byte = np.array([k in self.bytes_of for k in range(len(self.names))])
        self.text_of = [
            bytes([self.bytes_of[k]]) if k in self.bytes_of
            else b"" if k in self.silent
            else UNKNOWN_TEXT.encode() if k == self.unknown
            else name.replace(MARK, " ").encode()
            for k, name in enumerate(self.names)
        ]

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """Normalised text and, for each of its bytes and its end, the original byte; None where all bytes stay."""
        if not self.map.units and not self.squeeze:
            return text, None
        out, source, at = bytearray(), [], 0
        while at < len(text):
            rule = self.map.longest(text, at) if self.map.units else None
            if rule is None:
                width = 1 + sum(text[at] >= low for low in (0xC0, 0xE0, 0xF0))
                rule = width, text[at : at + width]
            used, replacement = rule
            if self.squeeze and replacement.startswith(b" ") and (not out or out.endswith(b" ")):
                replacement = replacement.lstrip(b" ")
            out += replacement
            source += [at] * len(replacement)
            at += used
        if self.squeeze:
            while out.endswith(b" "):
                out.pop()
                at = source.pop()
        return bytes(out), np.array([*source, at])

    def _word_ids(self, word: str) -> bytes:
        """Packed ids of one word."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        return b"".join([self.stretches[word[i:j]] for i, j in zip([0, *cuts], [*cuts, len(word)], strict=True)])

    def _stretch_ids(self, stretch: str) -> bytes:
        ids: list[int] = []
        for piece in self.merged(stretch) if len(stretch) < LONG else self._merged_long(stretch):
            if piece in self.scores:
                ids.append(self.ids[piece])
            else:
                ids += [self.byte_ids[b] for b in piece.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def merged(self, stretch: str) -> list[str]:
        """The pair whose union scores best, the leftmost of equals, is joined until none is left."""
        parts, get = list(stretch), self.scores.get
        scores = [get(a + b, NO_PAIR) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > NO_PAIR:
            where = scores.index(best)
            joined = parts[where] + parts.pop(where + 1)
            parts[where] = joined
            del scores[where]
            if where:
                scores[where - 1] = get(parts[where - 1] + joined, NO_PAIR)
            if where < len(scores):
                scores[where] = get(joined + parts[where + 1], NO_PAIR)
        return parts

    def _merged_long(self, stretch: str) -> list[str]:
        """The same for long stretches, with a heap of pairs."""
        n, scores = len(stretch), self.scores
        parts, before, after = list(stretch), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                union = parts[left] + parts[right]
                if (score := scores.get(union)) is not None:
                    heapq.heappush(heap, (-score, left, right, union))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, left, right, union = heapq.heappop(heap)
            if after[left] != right or not parts[left] or parts[left] + parts[right] != union:
                continue
            parts[left], parts[right] = union, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _words(self, clean: bytes) -> list[str]:
        """Normalised text with space marks, cut where a mark follows another character."""
        marked = clean.decode().replace(" ", MARK)
        return WORD.findall(MARK + marked if self.prefix else marked) if marked else []

    def encode(self, text: bytes) -> np.ndarray:
        """All ids, with begin and end."""
        return self._encoded(self.normalised(text)[0])

    def _encoded(self, clean: bytes) -> np.ndarray:
        ends = [struct.pack("<I", k) for k in (self.begin, self.end)]
        return np.frombuffer(b"".join([ends[0], *map(self.words.__getitem__, self._words(clean)), ends[1]]), "<u4")

    def encode_aligned(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, with begin and end, and for each the first and last-plus-one byte of the original that it stands for.

        Begin and end stand for the empty stretches before and after the text.
        """
        clean, source = self.normalised(text)
        ids = self._encoded(clean)
        # Pieces lie end to end in the marked text, where a space is as long as a mark and the added mark has no source.
        high = np.cumsum(self.width_of[ids[1:-1]])
        low = high - self.width_of[ids[1:-1]]
        raw = np.frombuffer(clean, np.uint8)
        wide = np.where(raw == 32, len(MARK_BYTES), 1)
        added = len(MARK_BYTES) * (self.prefix and len(raw) > 0)
        if len(self.bytes_of) and (parts := self.is_byte[ids[1:-1]]).any():
            # The bytes of a character without a piece all stand for that character.
            first = np.cumsum(wide) - wide + added
            begins = np.concatenate([[0], first[(raw & 0xC0) != 0x80], first[-1:] + wide[-1:]])
            at = np.searchsorted(begins, low[parts], "right")
            low[parts], high[parts] = begins[at - 1], begins[at]
        if source is None:
            source = np.arange(len(raw) + 1)
        place = np.concatenate([np.repeat(source[:1], added), np.repeat(source[:-1], wide), source[-1:]])
        starts, ends = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        starts[1:-1], ends[1:-1] = place[low], place[high]
        starts[-1] = ends[-1] = len(text)
        return ids, starts, ends

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """Id, first and last-plus-one original byte of every piece, without begin and end."""
        return list(zip(*(x[1:-1].tolist() for x in self.encode_aligned(text)), strict=True))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, control ids are silent."""
        numbers = ids.tolist()
        first = next((k for k in numbers if k not in self.silent), self.unknown)
        try:
            text = b"".join(map(self.text_of.__getitem__, numbers)).decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)
        return text[1:] if self.prefix and self.names[first].startswith(MARK) else text

    def _decode_runs(self, ids: np.ndarray) -> str:
        """The same where some run of byte ids is no UTF-8."""
        out, raw, first = [], bytearray(), True
        for k in ids.tolist():
            if k in self.bytes_of:
                raw.append(self.bytes_of[k])
                continue
            if raw:
                out.append(_lenient(bytes(raw)))
                raw.clear()
                first = False
            if k in self.silent:
                continue
            name = UNKNOWN_TEXT if k == self.unknown else self.names[k].replace(MARK, " ")
            out.append(name[1:] if first and self.prefix and self.names[k].startswith(MARK) else name)
            first = False
        if raw:
            out.append(_lenient(bytes(raw)))
        return "".join(out)


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out = []
    while raw:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as error:
            out += [raw[: error.start].decode(), "�"]
            raw = raw[error.start + 1 :]
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a file that every worker has, loaded once in a worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digests of the ids, of the text decoded from them, and of their spans.

    ``spans_sha256`` is of ids, first and last-plus-one original bytes, one piece after another, in the form of the ids.
    """

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches_of(rows):
            counts, ids_digests, text_digests, span_digests = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids, *places = m.encode_aligned(text.encode())
                counts.append(len(ids))
                span_digests.append(hashlib.sha256(np.stack([ids, *places], 1).astype("<u4").tobytes()).hexdigest())
                ids_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_digests.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), *map(pa.array, (ids_digests, text_digests, span_digests))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, SCHEMA)


SPANS = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode_spans(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ids without begin and end, and the original bytes that each stands for."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches_of(rows):
            found = [m.spans(text.encode()) for text in batch.column("text").to_pylist()]
            lists = [pa.array([[s[k] for s in spans] for spans in found], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encode, SPANS)
