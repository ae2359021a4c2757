"""Quality of text by supervised subword embeddings.

Words and their character n-grams are hashed to slots; each slot has a learned vector. A text's vector is the average
over all its features, a softmax layer over it gives the probability of label 1. Vectors and layer are trained together
by stochastic gradient descent. For scoring, a word's part of the layer's input is a sum over its slots, so that each
distinct word is computed once per worker.

At most ``SAMPLE`` labels train, chosen by hash of the id, with at most ``2 * SAMPLE`` rows of their documents, chosen by hash
of id and text where ids repeat. Of a text of more than ``LONGEST`` characters a piece of that length trains, at a place that
the hash of the id gives; every text is scored whole. Null and empty texts have no features; their score is the share of label 1. Without any label,
every score is 0.5. Only the text is read for a score. Rows are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.llm.common import piece, sampled, slices
from panelforge.llm.words import WordTable

SAMPLE = 6_000
LONGEST = 20_000
SLOTS = 1 << 17
WIDTH = 8
SIZES = (3, 4)
#: Slots of two features that hold for any word: written in capitals; the same word as the one before.
CAPITALS, AGAIN = 0, 1
#: Batches of training at the least, so that few documents are seen often enough.
LEAST_STEPS = 1_200
SLICE = 1 << 22


def features(word: str) -> list[int]:
    """Slots of a word and its character n-grams, and of a word in capitals."""
    raw = f"<{word}>".encode()
    slots = [crc32(raw) % SLOTS]
    for n in SIZES:
        slots += [crc32(raw[i : i + n], n) % SLOTS for i in range(len(raw) - n + 1)]
    if word.isupper() and len(word) > 1:
        slots.append(CAPITALS)
    return slots


class Scorer:
    """Slot vectors and softmax layer."""

    def __init__(self, rng: np.random.Generator):
        self.vectors = (rng.random((SLOTS, WIDTH), dtype=np.float32) - 0.5) / WIDTH
        self.layer = np.zeros((WIDTH, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        #: Log odds of label 1 for a text without features.
        self.prior = 0.0
        self._slot: np.ndarray | None = None
        self._words: WordTable | None = None

    def frozen(self) -> Scorer:
        """Keeps for each slot only what scoring needs: its part of the difference of the two outputs."""
        self._slot = self.vectors @ (self.layer[:, 1] - self.layer[:, 0])
        self.vectors = self.vectors[:0]
        return self

    def parts(self, words: list[str]) -> np.ndarray:
        """A row per word: sum of its slots' parts, and their number."""
        slots = [features(w) for w in words]
        sizes = np.array([len(s) for s in slots])
        flat = self._slot[np.concatenate(slots)]
        return np.column_stack([np.add.reduceat(flat, np.cumsum(sizes) - sizes), sizes])

    def words(self) -> WordTable:
        if self._words is None:
            self._words = WordTable(self.parts, 2)
        return self._words


def train(texts: list[str], labels: list[int], rounds: int = 6, rate: float = 1.0, batch: int = 32, seed: int = 9) -> Scorer:
    """Stochastic gradient descent over batches of texts, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    scorer = Scorer(rng)
    y = np.array(labels, dtype=np.int64)
    if not len(y):
        return scorer.frozen()
    ones = (y.sum() + 0.5) / (len(y) + 1)
    scorer.prior = float(np.log(ones / (1 - ones)))
    known: dict[str, np.ndarray] = {}
    docs = []
    for text in texts:
        spans = []
        words = text.split()
        for word in words:
            if word not in known:
                known[word] = np.array(features(word), dtype=np.int32)
            spans.append(known[word])
        spans.append(np.full(sum(a == b for a, b in zip(words, words[1:])), AGAIN, dtype=np.int32))
        slots, counts = np.unique(np.concatenate(spans), return_counts=True) if words else (np.empty(0, np.int32), np.empty(0))
        docs.append((slots, (counts / max(counts.sum(), 1)).astype(np.float32)))
    rounds = max(rounds, -(-LEAST_STEPS // -(-len(docs) // batch)))
    steps, done = rounds * -(-len(docs) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            group = order[at : at + batch]
            means = np.stack([share @ scorer.vectors[slots] if len(slots) else np.zeros(WIDTH, np.float32) for slots, share in (docs[g] for g in group)])
            logits = means @ scorer.layer + scorer.bias
            chance = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            error = chance - np.eye(2, dtype=np.float32)[y[group]]
            now = np.float32(rate * (1 - done / steps))
            back = error @ scorer.layer.T
            scorer.layer -= now * (means.T @ error) / len(group)
            scorer.bias -= now * error.mean(axis=0)
            for (slots, share), b in zip((docs[g] for g in group), back):
                if len(slots):
                    # A text's step is spread over its slots; the rate undoes the averaging.
                    scorer.vectors[slots] -= now * 4 * np.sqrt(share)[:, None] * b
            done += 1
    return scorer.frozen()


def fit(df: DataFrame, labels: DataFrame, learns: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Scorer:
    """A scorer from at most ``sample`` labels that ``learns`` names; repeated labels count as often."""
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    marked = marked.where(learns)
    found = sampled(marked, sample)
    if not found:
        return train([], [])
    chosen = df.sparkSession.createDataFrame(found, marked.schema)
    short = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), piece(F.col(text), F.col(key), longest).alias("text"))
    # Broadcast: at most ``sample`` rows.
    joined = short.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id", "text"), "id", "text", "y").limit(2 * sample)
    rows = sorted(joined.collect(), key=lambda r: (r.id, r.text))
    return train([r.text for r in rows], [r.y for r in rows])


def score(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``df`` without ``text`` but with ``score``, the probability of label 1."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scorer.words()
        lean = float(scorer.bias[1] - scorer.bias[0])
        for batch in slices(batches, text, SLICE):
            table.begin()
            odds = np.full(batch.num_rows, scorer.prior)
            for i, value in enumerate(batch.column(text).to_pylist()):
                words = (value or "").split()
                if words:
                    odds[i] = average(scorer, table, words) + lean
            chance = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(chance)], names=schema.names)

    return df.mapInArrow(run, schema)


def average(scorer: Scorer, table: WordTable, words: list[str]) -> float:
    """Mean part of a text's features."""
    numbers = table.look(words, len(words))
    total, count = table.rows[numbers].sum(axis=0, dtype=np.float64)
    again = int((numbers[1:] == numbers[:-1]).sum())
    return float((total + again * scorer._slot[AGAIN]) / (count + again))
