"""Byte-pair encoding and decoding by a public vocabulary file.

A piece of text starts as one symbol per byte in a doubly linked list. A heap holds the mergeable neighbours by merge
rank; the lowest rank is merged first, leftmost first. An entry whose symbols have changed since is stale and skipped.
Decoding concatenates vocabulary strings (this vocabulary has no decoder, so that they are joined by spaces).

Texts: null counts as empty; empty text gives no ids and the empty decoded text. Special tokens written in a text are
recognised before anything else. Work is per row: repeated rows, ties and hot sources need no care, and no rows move.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from panelforge.llm.common import slices

# The white space and the split pattern of the vocabulary file, with its white space spelled out.
_WHITE = r"\t-\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{_WHITE}]+")
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")

#: White space to ``str.split`` but not to the vocabulary file.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")

#: Words and pieces kept ready per worker and the longest kept; both bound memory only, everything is encoded.
CACHED_ENTRIES = 300_000
CACHED_LENGTH = 48

#: Ids as little-endian unsigned 32-bit integers, the decoded strings joined by spaces, and the number of ids.
Entry = tuple[bytes, str, int]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class _Unassigned(Exception):
    """A piece holds a code point without a category, which the pattern library can take for a letter."""


class BytePairs:
    """Vocabulary and merges of a tokenizer file, with caches of encoded words and pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        parts = spec["model"]
        self.vocab: dict[str, int] = parts["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        suffix = parts.get("end_of_word_suffix") or ""
        signs = byte_symbols()
        self.inner = [self.vocab[s] for s in signs]
        self.last = [self.vocab[s + suffix] for s in signs]
        #: Rank of a pair of ids (first << 32 | second), and the id that each rank gives.
        self.ranks: dict[int, int] = {}
        self.gives: list[int] = []
        for rank, merge in enumerate(parts["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(self.vocab[a] << 32 | self.vocab[b], rank)
            self.gives.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.strings.update({i: s for s, i in self.special.items()})
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.words: dict[str, Entry] = {}
        self.pieces: dict[str, Entry] = {}

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece."""
        raw = piece.encode("utf-8")
        n = len(raw)
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        if n == 1:
            return ids
        find = self.ranks.get
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if j < 0 or ids[i] < 0 or find(ids[i] << 32 | ids[j]) != rank:
                continue  # stale: one of the two symbols is gone or has grown
            ids[i] = new = self.gives[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := find(new << 32 | ids[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := find(ids[h] << 32 | new)) is not None:
                heappush(heap, r * n + h)
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> Entry:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            raise _Unassigned
        ids = self.merged(piece)
        entry = (struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]), len(ids))
        return _keep(self.pieces, piece, entry)

    def _word(self, word: str) -> Entry:
        """Entry of a text without white space."""
        plain = word if word.isascii() else unicodedata.normalize("NFC", word)
        # Lower-cased character by character: without the rule for a sigma at the end of a word.
        plain = plain.replace("\u03a3", "\u03c3").lower()
        get, make = self.pieces.get, self._piece
        try:
            entry = _joined([get(piece) or make(piece) for piece in _PIECES.findall(plain)])
        except _Unassigned:
            shown = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in plain)
            spans = [m.span() for m in _PIECES.finditer(shown)]
            entry = _joined([_packed(self, plain[a:b]) for a, b in spans])
        return _keep(self.words, word, entry)

    def _plain(self, text: str) -> list[Entry]:
        words = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        get, make = self.words.get, self._word
        return [get(word) or make(word) for word in words if word]

    def encode(self, text: str | None) -> Entry:
        """Packed ids, decoded text and number of ids of a whole text."""
        if not text:
            return _joined([])
        if "<|" not in text or not self.special_pattern:
            return _joined(self._plain(text))
        entries: list[Entry] = []
        at = 0
        for found in self.special_pattern.finditer(text):
            entries += self._plain(text[at : found.start()])
            entries.append((struct.pack("<I", self.special[found[0]]), found[0], 1))
            at = found.end()
        return _joined(entries + self._plain(text[at:]))

    def forget(self) -> None:
        """Drop what is known of words; the worker keeps the vocabulary alone for its next task."""
        self.words.clear()
        self.pieces.clear()

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of ids, joined by spaces; unknown ids are left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def _packed(pairs: BytePairs, piece: str) -> Entry:
    ids = pairs.merged(piece)
    return struct.pack(f"<{len(ids)}I", *ids), " ".join([pairs.strings[i] for i in ids]), len(ids)


def _joined(entries: list[Entry]) -> Entry:
    if len(entries) == 1:
        return entries[0]
    return b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[2]]), sum([e[2] for e in entries])


def _keep(cache: dict[str, Entry], key: str, entry: Entry) -> Entry:
    if len(key) <= CACHED_LENGTH:
        if len(cache) >= CACHED_ENTRIES:
            cache.clear()
        cache[key] = entry
    return entry


@lru_cache(maxsize=4)
def model(path: str) -> BytePairs:
    """One model per worker and file."""
    return BytePairs(path)


def encode_texts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per row of ``df``: the key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and ``ids`` if asked for.

    ``path`` must be readable on every executor. Other columns are not read.
    """
    key_type = df.schema[key].dataType
    fields = [
        T.StructField(key, key_type),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model(path)
        try:
            for batch in slices(batches, "__text"):
                counts, digests, decoded, ids = [], [], [], []
                for value in batch.column("__text").to_pylist():
                    packed, strings, n = pairs.encode(value)
                    counts.append(n)
                    digests.append(sha256(packed).hexdigest())
                    decoded.append(sha256(strings.encode("utf-8")).hexdigest())
                    ids.append(packed)
                columns = [batch.column("__key"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    offsets = pa.array([0, *_running(counts)], pa.int32())
                    values = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(ids))])
                    columns.append(pa.ListArray.from_arrays(offsets, values))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        finally:
            pairs.forget()

    slim = df.select(df[key].alias("__key"), df[text].alias("__text"))
    return slim.mapInArrow(run, T.StructType(fields))


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total


def decode_ids(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``text``, the decoded ids; null ids give the empty text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model(path)
        for batch in batches:
            texts = [pairs.decode(row or []) for row in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(df[key].alias("__key"), df[ids].alias("__ids")).mapInArrow(run, schema)
