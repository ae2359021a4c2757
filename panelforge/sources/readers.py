"""Readers. Every one takes a root folder and a stored schema, so that partition columns keep their types.

With ``tagged=True`` a reader keeps lines that it cannot read, and rows without a value in a column of ``required``, as
``rejects.tag`` describes; otherwise their fields are missing values.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge import schemas
from panelforge.functions import breaks as line_breaks
from panelforge.sources import rejects


def read_json(spark: SparkSession, path: str, schema: str, tagged: bool = False, required: Sequence[str] = ()) -> DataFrame:
    df = rejects.opened(spark, schema, tagged).json(path)
    return rejects.tag(df, required) if tagged else df


def read_posts(
    spark: SparkSession, root: str, schema: str = schemas.STREAM_POSTS, tagged: bool = False, required: Sequence[str] = ("id",)
) -> DataFrame:
    """Day-partitioned JSON posts. Give a narrower schema to parse fewer fields: JSON has no column pruning below
    the top level."""
    return read_json(spark, root, schema, tagged, required)


def between_days(df: DataFrame, after: str, upto: str, day: str = "ds") -> DataFrame:
    """Days after the first bound, up to and including the second.

    Days are text, compared as text, so a bound like ``2020-11-31`` works; one like ``2020-8-1`` is refused.
    """
    for bound in (after, upto):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", bound):
            raise ValueError(f"{bound!r} is not of the form yyyy-MM-dd")
    return df.filter((F.col(day) > after) & (F.col(day) <= upto))


def on_day(df: DataFrame, which: str, day: str = "ds") -> DataFrame:
    """One day, which must exist in the calendar; any other text would silently select nothing."""
    datetime.date.fromisoformat(which)
    return df.filter(F.col(day) == which)


def flat_posts(posts: DataFrame, text: str = "text", *more: str) -> DataFrame:
    """Post id, author id, text, and further columns."""
    return posts.select("id", F.col("user.id").alias("user_id"), text, *more)


def read_panel_posts(
    spark: SparkSession,
    root: str,
    created_at_bucket: str | None = None,
    user_id_bucket: int | None = None,
    schema: str = schemas.PANEL_POSTS,
    tagged: bool = False,
    required: Sequence[str] = ("id",),
) -> DataFrame:
    """Posts partitioned by half-month and user bucket, optionally one partition of them.

    The root is read and filtered, which lists and opens the wanted folder only and keeps both partition columns;
    a reader pointed at that folder would lose them.
    """
    posts = read_json(spark, root, schema, tagged, required)
    if created_at_bucket is not None:
        posts = posts.filter(F.col("created_at_bucket") == created_at_bucket)
    if user_id_bucket is not None:
        posts = posts.filter(F.col("user_id_bucket") == user_id_bucket)
    return posts


def read_table(
    spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True, breaks: str = "quoted", line_end: str = "\n",
    tagged: bool = False, required: Sequence[str] = (),
) -> DataFrame:
    """TSV by default; ``sep=','`` for CSV, ``header=False`` for files that start with data.

    ``breaks`` says where fields may hold line breaks: ``"quoted"`` in quotes, which keeps a file in one task;
    ``"escaped"`` as ``export_table`` escapes them and ``"none"`` nowhere, both of which let files be split.
    An empty field is a missing value.
    """
    df = _delimited(rejects.opened(spark, schema, tagged), path, sep, header, breaks, line_end)
    return _data_unescaped(rejects.tag(df, required) if tagged else df, breaks)


def _delimited(reader, path: str, sep: str, header: bool, breaks: str, line_end: str) -> DataFrame:
    if breaks not in ("quoted", "escaped", "none"):
        raise ValueError(f"breaks={breaks!r}")
    return reader.csv(path, sep=sep, header=header, escape='"', multiLine=breaks == "quoted", lineSep=line_end)


def _data_unescaped(df: DataFrame, breaks: str) -> DataFrame:
    return line_breaks.in_strings(df, line_breaks.unescaped, rejects.TAGS) if breaks == "escaped" else df


_RAW_NAME = r"\.(json|csv)(\.bz2|\.gz)?$"


def read_raw_posts(
    spark: SparkSession, path: str, breaks: str = "quoted", line_end: str = "\n", tagged: bool = False, required: Sequence[str] = ("id",)
) -> DataFrame:
    """All posts of a file or folder: ``.json`` holds JSON lines, ``.csv`` headerless tab-separated rows; both may be
    compressed. ``breaks`` and ``line_end`` are those of ``read_table``."""
    # One listing; names only, and one row per kind.
    kind = F.regexp_extract("path", _RAW_NAME, 1).alias("kind")
    kinds = {r.kind for r in spark.read.format("binaryFile").load(path).select(kind).distinct().collect()}
    if "" in kinds:
        raise ValueError(f"{path}: only .json and .csv files can be read")
    if not kinds:
        raise ValueError(f"{path}: no .json or .csv file")

    def reader(kind: str):
        return rejects.opened(spark, schemas.RAW_POSTS, tagged).option("pathGlobFilter", f"*.{{{kind},{kind}.bz2,{kind}.gz}}")

    def tag(df: DataFrame) -> DataFrame:
        return rejects.tag(df, required) if tagged else df

    parts = []
    if "json" in kinds:
        parts.append(tag(reader("json").json(path)))
    if "csv" in kinds:
        parts.append(_data_unescaped(tag(_delimited(reader("csv"), path, "\t", False, breaks, line_end)), breaks))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_id_lines(spark: SparkSession, path: str, column: str = "user_id") -> DataFrame:
    """One id per line, with its place (file, block, row) so that file order can be restored.

    Blank lines and lines that hold no number are left out here; ``rejected_id_lines`` returns the latter.
    """
    lines = spark.read.text(path).select(
        F.trim(F.col("value"), F.lit(" \t\r\n")).try_cast("bigint").alias(column),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.filter(F.col(column).isNotNull())


def rejected_id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id list that are neither blank nor a number, with their file."""
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), text.alias("text"), F.col("_metadata.file_path").alias("file"))
    return lines.filter((F.col("text") != "") & F.col("text").try_cast("bigint").isNull()).select("line", "file")


FILE_ORDER = ("file", "block", "row")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``id, user_id, [a, b, ...]`` rows back as vectors."""
    rows = spark.read.schema("id BIGINT, user_id BIGINT, embed STRING").csv(path, escape='"')
    return rows.withColumn("embed", F.from_json("embed", "array<double>"))


def register(df: DataFrame, name: str) -> DataFrame:
    """Name the frame for SQL text."""
    df.createOrReplaceTempView(name)
    return df
