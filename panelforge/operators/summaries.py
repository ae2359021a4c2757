"""Counts, value counts, contingency tables and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def total(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def counts_by(df: DataFrame, *columns: str, where: Column | str | None = None) -> DataFrame:
    """Rows per group, optionally of a filtered subset."""
    kept = df if where is None else df.filter(where)
    return kept.groupBy(*columns).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts in descending order."""
    return counts_by(df, column).orderBy(F.desc("n"), column)


def contingency(df: DataFrame, rows: str, columns: str, pivot_values: list[str] | None = None) -> DataFrame:
    """Counts per pair of values, or a cross table when the column values are named."""
    if pivot_values is None:
        return counts_by(df, rows, columns)
    return df.groupBy(rows).pivot(columns, pivot_values).agg(F.count(F.lit(1))).na.fill(0)


def first_by(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order, for display."""
    return df.orderBy(order).limit(n)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name, duplicates kept."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
