"""Text to vectors with an encoder of the user's choice."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.hashing import DEFAULT_DIM

# Executors need not have this package installed: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
BATCH_ROWS = 8
MAX_TOKENS = 512
# Models that a Python worker keeps.
MODELS_KEPT = 2
# Tokens whose slots a worker keeps; frequent ones come back at once after a new start.
SLOTS_KEPT = 1 << 16
# Characters and rows of an Arrow batch whose vectors are held at a time.
PIECE_CHARS = 1 << 22
PIECE_ROWS = 2_000
# What the JVM regex engine calls white space.
_TOKEN = r"[^ \t\n\x0b\f\r]+"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text)


def token_slot(dim: int) -> Callable[[str], int]:
    """Slot of a token, the Python twin of ``token_slots``."""
    slots: dict[str, int] = {}

    def slot(token: str) -> int:
        if token not in slots:
            if len(slots) >= SLOTS_KEPT:  # bounds the memo, not the vocabulary
                slots.clear()
            slots[token] = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim
        return slots[token]

    return slot


def hash_encoder(dim: int = DEFAULT_DIM) -> Callable[[], Encoder]:
    """Factory of the built-in encoder, the Python twin of ``hash_embed``."""

    def load() -> Encoder:
        slot = token_slot(dim)

        def encode(texts: Sequence[str]) -> list[np.ndarray]:
            vectors = []
            for text in texts:
                places = [slot(t) for t in tokens(text)]
                counts = np.bincount(places, minlength=dim).astype(float) if places else np.zeros(dim)
                norm = np.sqrt((counts * counts).sum())
                vectors.append(counts / norm if norm else counts)
            return vectors

        return encode

    return load


def kept_by_worker(key: str, build: Callable[[], object]):
    """What ``build`` gives, made once per Python worker process; the last few are kept."""
    # On a module that every worker has, because this one travels with each query anew.
    kept = sys.__dict__.setdefault("_panelforge_models", {})
    if key not in kept:
        while len(kept) >= MODELS_KEPT:
            kept.pop(next(iter(kept)))
        kept[key] = build()
    return kept[key]


def mapped_array(path: str) -> np.ndarray:
    """A stored numpy array as read-only pages of its file, which all workers of a machine share."""
    return np.load(path, mmap_mode="r")


def shipped(spark: SparkSession, path: str, build: Callable[[str], Encoder]) -> Callable[[], Encoder]:
    """Factory of an encoder that is built from a model file, folder or archive.

    An archive (``.zip``, ``.tar.gz``, ``.tgz``, ``.jar``) in a store that all machines read is fetched from there and
    unpacked once by each executor. Any other ``path`` must be mounted on all machines and is opened in place. ``build``
    gets the path; a Python worker builds the encoder at its first batch and keeps it for its later tasks. Arrays that
    ``build`` maps into memory (``mapped_array``) exist once per machine. Models of equal names do not collide.
    """
    name = f"model-{crc32(path.encode()):08x}"
    archive = path.endswith((".zip", ".tar.gz", ".tgz", ".jar"))
    if archive:
        spark.sparkContext.addArchive(f"{path}#{name}")
    # One model, one builder: the worker keeps what they gave under both names.
    key = f"{path}#{crc32(cloudpickle.dumps(build)):08x}"

    def load() -> Encoder:
        return kept_by_worker(key, lambda: build(SparkFiles.get(name) if archive else path))

    return load


def spread(df: DataFrame, n_partitions: int | None) -> DataFrame:
    """Partitions of equal row counts, whoever wrote the posts; encoders are slow per row, not per byte."""
    return df if n_partitions is None else df.repartition(n_partitions)


def word_count(text: str) -> int:
    return len(tokens(text))


def budget_batches(sizes: Sequence[int], budget: int, batch_rows: int) -> Iterator[np.ndarray]:
    """Places of texts by falling size, in batches of at most ``batch_rows`` whose padded size keeps to ``budget``.

    An encoder pads the texts of a batch to the longest one; texts of like sizes waste little. A text beyond the budget
    makes a batch of its own.
    """
    sizes = np.maximum(np.asarray(sizes, dtype=np.int64), 1)
    order = np.argsort(-sizes, kind="stable")
    start = 0
    while start < len(order):
        n = min(batch_rows, max(1, int(budget // sizes[order[start]])))
        yield order[start : start + n]
        start += n


def pieces(values: list[str]) -> Iterator[slice]:
    """The texts of a batch in pieces of at most ``PIECE_ROWS`` rows and about ``PIECE_CHARS`` characters."""
    start = chars = 0
    for i, value in enumerate(values):
        if i > start and (chars + len(value) > PIECE_CHARS or i - start >= PIECE_ROWS):
            yield slice(start, i)
            start, chars = i, 0
        chars += len(value)
    if values:
        yield slice(start, len(values))


def embed(
    df: DataFrame,
    text: str,
    load_encoder: Callable[[], Encoder],
    batch_rows: int = BATCH_ROWS,
    n_partitions: int | None = None,
    output: str = "embed",
    drop_text: bool = True,
    token_budget: int | None = None,
    count_tokens: Callable[[str], int] = word_count,
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Add one vector per row.

    ``load_encoder`` runs once per task on the executor, so send a path to the model (``addFile``,
    ``spark.archives``) rather than the model. The encoder gets at most ``batch_rows`` whole texts at a time
    and must give each text a vector that does not depend on the other texts. Missing text counts as empty. A worker holds
    the vectors of one piece of an Arrow batch, however many rows the session puts into a batch.

    With ``token_budget`` the texts of a piece go to the encoder by falling size, so many at a time that the padded
    batch has at most so many tokens; rows keep their order. ``count_tokens`` gives a text's size, of which the encoder
    reads at most ``max_tokens``. Give a large ``batch_rows`` then.
    """

    def batches_of(values: list[str]) -> Iterator[Sequence[int]]:
        if token_budget is None:
            return (range(start, min(start + batch_rows, len(values))) for start in range(0, len(values), batch_rows))
        return budget_batches([min(count_tokens(v), max_tokens) for v in values], token_budget, batch_rows)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            everything = texts.fillna("").tolist()
            for part in pieces(everything):
                values = everything[part]
                vectors: list = [None] * len(values)
                for places in batches_of(values):
                    for place, vector in zip(places, encoder([values[i] for i in places])):
                        vectors[place] = vector
                yield pd.Series(vectors, index=texts.index[part], dtype=object)

    embedded = spread(df, n_partitions).withColumn(output, encode(F.col(text)))
    return embedded.drop(text) if drop_text else embedded
