"""Line breaks inside the fields of delimited files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# A backslash in escaped text always starts one of these pairs, so that they can be undone one after the other.
PAIRS = (("\n", "\\n"), ("\r", "\\r"), ("\\", "\\b"))


def escaped(text: Column) -> Column:
    for plain, pair in reversed(PAIRS):
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescaped(text: Column) -> Column:
    for plain, pair in PAIRS:
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def in_strings(df: DataFrame, change, but: tuple[str, ...] = ()) -> DataFrame:
    """``change`` applied to every text column that is not named in ``but``."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in but]
    return df.select(*[change(F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns])
