"""Lines that cannot be read, kept beside the data and accounted for.

A tagged frame has the data columns and three more: ``_line`` (the line as it came, where it could not be read whole),
``_file`` and ``_reason`` (NULL for good rows). ``land`` writes both kinds in one scan, into two folders of one table;
``data_of`` and ``rejects_of`` read either without touching the other, and ``account`` compares both with the lines of the
source. Tag and land whole records: a scan that is asked for a few columns of JSON does not look at the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

LINE, FILE, REASON, REJECTED = "_line", "_file", "_reason", "_rejected"
TAGS = (LINE, FILE, REASON)
UNREADABLE = "unreadable"


def opened(spark: SparkSession, schema: str, tagged: bool) -> DataFrameReader:
    """A reader with a stored schema; a tagged one keeps lines that do not fit it."""
    if not tagged:
        return spark.read.schema(schema)
    return spark.read.schema(f"{schema}, {LINE} STRING").option("columnNameOfCorruptRecord", LINE)


def tag(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Adds file and reason to rows of an ``opened(..., tagged=True)`` reader.

    ``required`` names columns that must have a value. A row that lacks one was read, so that its record stands as JSON in
    the place of its line.
    """
    data = [c for c in df.columns if c != LINE]
    reason = F.when(F.col(LINE).isNotNull(), UNREADABLE)
    for column in required:
        reason = reason.when(F.col(column).isNull(), f"no {column}")
    tagged = df.select(*data, LINE, F.col("_metadata.file_path").alias(FILE), reason.alias(REASON))
    record = F.when(F.col(REASON).isNotNull(), F.to_json(F.struct(*data)))
    return tagged.withColumn(LINE, F.coalesce(LINE, record)) if required else tagged


def is_good() -> Column:
    return F.col(REASON).isNull()


def land(tagged: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write good rows and rejects in one scan; returns what now lies there, with the column ``_rejected``."""
    spark = tagged.sparkSession
    tagged.withColumn(REJECTED, ~is_good()).write.mode(mode).partitionBy(REJECTED).parquet(path)
    return landed(spark, path, tagged.schema)


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A landed table; ``schema`` is that of the tagged frame, so that a folder without any row can be read too."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(REJECTED, T.BooleanType())])).parquet(path)


def data_of(table: DataFrame) -> DataFrame:
    """The good rows; only their folder is scanned."""
    return table.filter(~F.col(REJECTED)).drop(*TAGS, REJECTED)


def rejects_of(table: DataFrame) -> DataFrame:
    """Line, file and reason of the others."""
    return table.filter(REJECTED).select(*TAGS)


def account(table: DataFrame, source: str, header: bool = False) -> DataFrame:
    """Per source file: lines that are not blank, rows and rejects landed, and whether they add up.

    For formats with one record per line. A file of which nothing has landed shows with zero rows.
    """
    spark = table.sparkSession
    text = spark.read.text(source).select("value", F.col("_metadata.file_path").alias(FILE))
    filled = F.count(F.when(F.trim("value", F.lit(" \t\r\n")) != "", 1))
    lines = text.groupBy(FILE).agg((filled - F.lit(int(header))).alias("n_lines"))
    counts = table.groupBy(FILE).agg(
        F.count(F.when(~F.col(REJECTED), 1)).alias("n_rows"), F.count(F.when(F.col(REJECTED), 1)).alias("n_rejects")
    )
    both = lines.join(counts, FILE, "full").na.fill(0, ["n_lines", "n_rows", "n_rejects"])
    return both.withColumn("adds_up", F.col("n_lines") == F.col("n_rows") + F.col("n_rejects"))
