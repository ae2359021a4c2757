"""Helpers shared by the operators: tables, scratch tables, slices of Arrow batches, word hashes in numpy."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from panelforge.session import run_folder

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
WHITE = (0x20, *range(0x09, 0x0E))
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, safe against lost executors.

    ``tidy`` has the shuffle files of finished steps dropped now and not at the driver's next garbage collection.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    if tidy:
        # Without references left, Spark's cleaner drops the shuffle files that led to this table.
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str = "doc_id", parts: int = 5) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def sampled(rows: DataFrame, most: int) -> list[Row]:
    """At most ``most`` rows of a table with column ``id``, those with the smallest hashes of the id; alike on every run."""
    place = F.xxhash64("id", F.lit(11))
    bound = rows.select(place.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    # Ordered, so that the limit cuts alike where an id stands on very many rows.
    return sorted(rows.where(place <= bound).orderBy(place, *rows.columns).limit(most).collect(), key=repr)


def piece(text: Column, key: Column, longest: int) -> Column:
    """A text of at most ``longest`` characters whole, of a longer one a piece of that length at a place given by the key's hash."""
    places = F.greatest(F.length(text) - longest + 1, F.lit(1))
    start = F.pmod(F.xxhash64(key, F.lit(5)), places).cast("int") + 1
    return F.when(F.length(text) > longest, F.substring(text, start, F.lit(longest))).otherwise(text)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``limit`` bytes of ``column``, or by a column of sizes; a longer value makes a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.fill_null(values if pa.types.is_integer(values.type) else pc.binary_length(values), 0)
        piece = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)
    # Workers live on after their task; what Arrow holds free would count against the executor until they end.
    pa.default_memory_pool().release_unused()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts as bytes, null as empty."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


# Word hashes: polynomials modulo 2**64 over random byte values, each word scrambled afterwards.

_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def scramble(h: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    base = _BASES[which] | 1
    inverse = pow(base, -1, 1 << 64)

    def grow(factor: int) -> np.ndarray:
        out = np.full(size + 1, factor, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return grow(base), grow(inverse)


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(which, 1 << max(16, int(size).bit_length()))


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if lower:
        values[65:91] += np.uint64(32)
    return scramble(values + np.uint64(0x51ED270B))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of a byte array."""
    white = np.ones(len(data) + 2, dtype=np.int8)
    white[1:-1] = _IS_WHITE[data]
    edges = np.flatnonzero(np.diff(white))
    return edges[0::2], edges[1::2]


def hashed_words(data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word; ``lower`` makes A-Z count as a-z.

    Works in pieces cut at white space, so that the memory beside the words stays small for a very long text.
    """
    starts, ends = word_spans(data)
    hashes = np.empty(len(starts), dtype=np.uint64)
    values = _byte_values(lower)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        low, high = int(starts[first]), int(ends[last - 1])
        up, down = powers(0, high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=total[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        first = last
    return starts, ends, scramble(hashes)


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` words, by its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(which, len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((words if which == 0 else scramble(words + np.uint64(which))) * up[: len(words)], out=total[1:])
    return scramble((total[size:] - total[:n]) * down[:n])


def sequence_hash(words: np.ndarray, which: int = 0) -> int:
    """Signed 64-bit hash of a whole word sequence."""
    if not len(words):
        return 0
    up, _ = powers(which, len(words))
    total = ((words if which == 0 else scramble(words + np.uint64(which))) * up[: len(words)]).sum(dtype=np.uint64)
    return int(scramble(np.array([total + np.uint64(len(words))], dtype=np.uint64)).view(np.int64)[0])
