"""Writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions import breaks as line_breaks


def write_json(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = (), compression="bzip2"):
    """JSON lines; bzip2 files can still be split by a later scan."""
    df.write.partitionBy(*partition_by).mode(mode).json(path, compression=compression)


def write_parquet(df: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()):
    df.write.partitionBy(*partition_by).mode(mode).parquet(path, compression="gzip")


def replace_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...], fmt: str = "parquet"):
    """Replace the partitions that ``df`` has rows for and leave the others: a rerun adds nothing."""
    (
        df.write.partitionBy(*partition_by)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip" if fmt == "parquet" else "bzip2")
        .format(fmt)
        .save(path)
    )


def _folders_in(df: DataFrame, path: str, partition_by: tuple[str, ...], inside: Column) -> dict[str, str]:
    """One file of every partition folder for which ``inside`` holds; names are listed, contents are not read."""
    try:
        files = df.sparkSession.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    if not set(partition_by) <= set(files.columns):
        return {}
    typed = files.select("path", *[F.col(c).cast(df.schema[c].dataType).alias(c) for c in partition_by]).filter(inside)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return {r.folder: r.file for r in typed.groupBy(folder.alias("folder")).agg(F.min("path").alias("file")).collect()}


def replace_range(df: DataFrame, path: str, partition_by: tuple[str, ...], inside: Column, fmt: str = "parquet"):
    """Replace all partitions for which ``inside`` holds, also those that ``df`` has no rows for any more.

    New partitions are committed first; then the folders go whose old files are still there. A crash in between leaves
    old folders, which the next run removes.
    """
    spark = df.sparkSession
    old = _folders_in(df, path, partition_by, inside)
    replace_partitions(df.filter(inside), path, partition_by, fmt)
    for folder, file in old.items():
        names = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name) for name in (file, folder)]
        store = names[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if store.exists(names[0]):
            store.delete(names[1], True)


def export_table(
    df: DataFrame, path: str, sep: str = "\t", mode: str = "errorifexists", single_file: bool = False, header: bool = True,
    compression: str | None = "gzip", breaks: str = "quoted",
):
    """Delimited text. Sorted frames give files in that order.

    ``breaks="quoted"`` leaves line breaks in quoted fields, as other programs expect; ``"escaped"`` writes them as
    backslash pairs, so that ``read_table`` can split the files. ``single_file`` has one task write everything into one
    file: for exports that one reader takes whole.
    """
    if breaks == "escaped":
        df = line_breaks.in_strings(df, line_breaks.escaped)
    if single_file:
        df = df.coalesce(1)
    df.write.mode(mode).csv(
        path, sep=sep, header=header, compression=compression, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def export_vectors(df: DataFrame, path: str, mode: str = "append"):
    """Headerless ``id, user_id, [a, b, ...]`` rows."""
    df.select("id", "user_id", F.to_json("embed").alias("embed")).write.mode(mode).csv(path, escape='"')


def write_id_lines(df: DataFrame, path: str, column: str, mode: str = "errorifexists"):
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)
