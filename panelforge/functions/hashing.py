"""The built-in text encoder as column expressions, and the seeded shuffle key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_DIM = 32


def token_slots(text: Column, dim: int) -> Column:
    """Slot of each token: the first 8 hex digits of its MD5, modulo ``dim``."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.transform(
        tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row however often the body names it.

    A helper column would not do: the optimizer may inline it, also into a lambda that runs once per vector slot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_vector(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Unit-length counts of token slots, computed inside the JVM; no tokens give all zeros."""

    def ends(ordered: Column) -> Column:
        """Where the run of each value ends in a sorted array."""
        n = F.size(ordered)
        return F.filter(F.sequence(F.lit(1), n), lambda j: (j == n) | (F.get(ordered, j) != F.get(ordered, j - 1)))

    def lengths(run_ends: Column) -> Column:
        return F.transform(
            run_ends, lambda end, i: (end - F.when(i == 0, 0).otherwise(F.get(run_ends, i - 1)) - 1).cast("double")
        )

    def counts(slots: Column) -> Column:
        # With every slot once more each has a run, so that one sort counts all of them, however many there are.
        every = F.concat(slots, F.sequence(F.lit(0), F.lit(dim - 1)))
        return _let(F.sort_array(every), lambda ordered: _let(ends(ordered), lengths))

    def unit(numbers: Column) -> Column:
        norm = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda total, n: total + n * n))
        return _let(norm, lambda length: F.transform(numbers, lambda n: F.when(length == 0, 0.0).otherwise(n / length)))

    return _let(token_slots(text, dim), lambda slots: _let(counts(slots), unit))


def hash_embed(df: DataFrame, text: str, dim: int = DEFAULT_DIM, output: str = "embed") -> DataFrame:
    return df.withColumn(output, hash_vector(F.col(text), dim))


def shuffle_key(*columns: str, seed: int = 0) -> Column:
    """Random-looking sort key that repeats for equal rows and equal seeds, unlike ``rand``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def spreading_salt(salts: int, *columns: str) -> Column:
    """Salt 0..salts-1 from the row's content and its input partition.

    Content alone would give all copies of a row one salt. Unlike ``rand``, a task that runs again after a lost
    executor assigns the same salts.
    """
    content = F.pmod(F.xxhash64(*columns), F.lit(salts))
    return F.pmod(content + F.spark_partition_id(), F.lit(salts)).cast("int")
