"""Quality rules: base rules over document statistics, then gradient-boosted trees over the same statistics.

One pass counts each text whole; nothing is shuffled. A text fails the base rules with fewer than ``LEAST_WORDS`` words or
with more than half of them in repeated three-word windows. The trees learn from labelled documents, with the score never
rising in symbols, repeated lines, repeated words and capitals; a text that passes the base rules is kept if its
probability of label 1 is at least ``KEEP``.

At most ``SAMPLE`` labelled documents train, those with the smallest hashes of id and text; every text is judged. Words
are runs without white space, lines end at line feeds. Null and empty texts have no words and fail the base rules. Without
any label the trees are silent: what passes the base rules is kept with score 0.5. Rows are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.llm import trees
from panelforge.llm.common import WHITE, slices, utf8
from panelforge.llm.words import _Numbered

SAMPLE = 6_000
LEAST_WORDS = 50
KEEP = 0.5

#: Features in order, with the direction in which the score may move with each (0: either).
FEATURES = {
    "word_length": 0,
    "symbols_per_word": -1,
    "symbols_per_character": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "capitals": -1,
    "digits": 0,
    "punctuation": 0,
    "words_per_line": 0,
    "short_lines": -1,
    "ends_of_sentence": 0,
    "distinct_words": 0,
    "words": 0,
}
SIGNS = np.array(list(FEATURES.values()))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines of at most so many words are short.
SHORT = 3

_KINDS = np.zeros((256, 7), dtype=np.int64)
#: Columns of the table: code points, code points in words, symbols, capitals, digits, punctuation, line feeds.
_KINDS[:, 0] = (np.arange(256) & 0xC0) != 0x80
_KINDS[:, 1] = _KINDS[:, 0]
_KINDS[list(WHITE), 1] = 0
_KINDS[list(b"#*$%&|<>"), 2] = 1
_KINDS[65:91, 3] = 1
_KINDS[48:58, 4] = 1
_KINDS[list(b".,;:!?'\"()-"), 5] = 1
_KINDS[10, 6] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[97:123] = 1
_LETTER[65:91] = 1
_ENDS = tuple(b".!?:"[i : i + 1] for i in range(4))
_LINE = re.compile(rb"[^\n]+")


def repeated(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text, the words in three-word windows that the text holds twice or more; ``words`` are numbers, texts end to end."""
    total = np.zeros(len(lengths), dtype=np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    if len(words) < 3:
        return total
    starts = np.flatnonzero(owner[2:] == owner[:-2])
    size = int(words.max()) + 1
    _, pair = np.unique(words[starts] * size + words[starts + 1], return_inverse=True)
    _, three = np.unique(pair * size + words[starts + 2], return_inverse=True)
    _, inverse, often = np.unique(three * len(lengths) + owner[starts], return_inverse=True, return_counts=True)
    twice = starts[often[inverse] > 1]
    covered = np.zeros(len(words), dtype=bool)
    for n in range(3):
        covered[twice + n] = True
    return np.bincount(owner[covered], minlength=len(lengths))


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The counts (as in ``COUNTS``) and the features (as in ``FEATURES``) of every text."""
    n = len(texts)
    numbers = _Numbered()
    words, lengths, distinct = [], np.zeros(n, dtype=np.int64), np.zeros(n)
    lines, again, short, ended = (np.zeros(n, dtype=np.int64) for _ in range(4))
    for i, text in enumerate(texts):
        own = np.fromiter(map(numbers.__getitem__, split := text.split()), np.int64, len(split))
        words.append(own)
        lengths[i] = len(own)
        filled = [line for line in _LINE.findall(text) if not line.isspace()]
        lines[i], again[i] = len(filled), len(filled) - len(set(filled))
        for line in filled:
            ended[i] += line.rstrip().endswith(_ENDS)
            short[i] += len(line) < 200 and len(line.split()) <= SHORT
    flat = np.concatenate(words) if n else np.empty(0, np.int64)
    begins = np.cumsum(lengths) - lengths
    if len(flat):
        owner = np.repeat(np.arange(n), lengths)
        pairs = np.unique(owner * len(numbers) + flat)
        distinct = np.bincount(pairs // len(numbers), minlength=n).astype(float)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    kinds, letters = np.zeros((n, 7), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i, text in enumerate(texts):
        if sizes[i]:
            often = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
            kinds[i], letters[i] = often @ _KINDS, often @ _LETTER
    repeats = repeated(flat, lengths)
    counts = np.column_stack([lengths, kinds[:, 1], kinds[:, 2], again, repeats])
    per = lambda a, b: a / np.maximum(b, 1)
    features = np.column_stack(
        [
            per(kinds[:, 1], lengths), per(kinds[:, 2], lengths), per(kinds[:, 2], kinds[:, 0]), per(again, lines), per(repeats, lengths), per(kinds[:, 3], letters),
            per(kinds[:, 4], kinds[:, 0]), per(kinds[:, 5], kinds[:, 0]), per(lengths, lines), per(short, lines), per(ended, lines), per(distinct, lengths), np.log1p(lengths),
        ]
    )
    return counts, features


def fails(counts: np.ndarray) -> np.ndarray:
    """The base rules."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> trees.Forest:
    """Trees from at most ``sample`` labelled documents; repeated labels and rows count as often as they occur."""
    marked = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    chosen = marked.orderBy(F.xxhash64("id", F.lit(13)), "id", "y").limit(sample)
    place = F.xxhash64("id", F.coalesce("text", F.lit("")), F.lit(17)).alias("place")
    # Broadcast: at most ``sample`` ids.
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select(place, "text", "y")
    schema = "place BIGINT, y INT, x ARRAY<DOUBLE>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, features = statistics(utf8(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("y"), pa.array(list(features), pa.list_(pa.float64()))], names=["place", "y", "x"])

    # Texts stay where they are; rows under repeated ids are bounded again, in an order of their own.
    found = rows.mapInArrow(run, schema).orderBy("place", "y", "x").limit(sample).collect()
    if not found:
        return trees.train(np.empty((0, len(FEATURES))), np.empty(0), SIGNS)
    return trees.train(np.array([r.x for r in found]), np.array([r.y for r in found], dtype=float), SIGNS)


def judge(df: DataFrame, forest: trees.Forest, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``df`` without ``text`` but with the counts, ``base_failed``, ``score`` and ``kept``.

    Columns of these names in ``df`` are an error of the caller; select or rename them first.
    """
    kept = [c for c in df.columns if c != text]
    new = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    schema = T.StructType([*df.select(*kept).schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts, features = statistics(utf8(batch, text))
            failed = fails(counts)
            score = 1 / (1 + np.exp(-forest.score(features)))
            columns = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=schema.names)

    return df.mapInArrow(run, schema)
