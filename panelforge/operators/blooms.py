"""Bloom filters of id lists, built and asked inside the JVM.

The filter is one array of 64-bit words. Its bits come from an aggregation (one row per word that has any bit), the array
from a scalar subquery that Spark sends to every task once. A row asks for a few bits by array position, so that rows that
cannot match end in the stage that scans them. There are no false negatives; the join that follows decides the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Largest filter that is sent to every task: 16 MB hold 14 million ids at one false match in a hundred.
MAX_BYTES = 16 << 20
FALSE_MATCHES = 0.01


def shape(n: int, false_matches: float = FALSE_MATCHES) -> tuple[int, int]:
    """Number of words and of bits asked per id, for ``n`` ids."""
    bits = max(64, math.ceil(-n * math.log(false_matches) / math.log(2) ** 2))
    words = -(-bits // 64)
    return words, max(1, round(words * 64 / max(n, 1) * math.log(2))) if n else 1


def _positions(key: Column, words: int, asked: int) -> list[Column]:
    """Bit positions of an id: a first hash plus multiples of a second one."""
    low, step = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    # Two halves of 31 bits, so that sums stay within 64 bits.
    low, step = (F.shiftrightunsigned(h, 33) for h in (low, step))
    return [F.pmod(low + step * i, F.lit(words * 64).cast("bigint")) for i in range(asked)]


def built(ids: DataFrame, words: int, asked: int) -> DataFrame:
    """One row with the filter's words as array ``words``, from a one-column list."""
    (key,) = ids.columns
    bits = ids.filter(F.col(key).isNotNull()).select(F.explode(F.array(*_positions(F.col(key), words, asked))).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))
    held = bits.select(word, bit.alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    every = ids.sparkSession.range(words).select(F.col("id").cast("int").alias("at"))
    # A row per word in one task: ``words`` is bounded by the caller.
    return every.join(held, "at", "left").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("b", F.lit(0)).alias("b")))).alias("all")).select(
        F.col("all.b").alias("words")
    )


def passes(key: Column, filter_words: Column, words: int, asked: int) -> Column:
    """Whether an id may be in the list; a null id is not."""
    found = F.lit(True)
    for position in _positions(key, words, asked):
        word = F.get(filter_words, F.shiftright(position, 6).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(63).cast("int"))
        found = found & (word.bitwiseAND(bit) != 0)
    return key.isNotNull() & found


def may_match(df: DataFrame, key: str, ids: DataFrame, max_bytes: int = MAX_BYTES, false_matches: float = FALSE_MATCHES) -> DataFrame:
    """The rows of ``df`` whose key may be in a stored one-column list; all rows if the filter would be too large."""
    words, asked = shape(ids.count(), false_matches)
    if words * 8 > max_bytes:
        return df
    return df.filter(passes(F.col(key), built(ids, words, asked).scalar(), words, asked))
