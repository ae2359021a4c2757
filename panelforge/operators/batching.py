"""Batches of a fixed size in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelforge.session import cut_lineage

REQUEST_SIZE = 100
_WITHIN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add ``position`` 0, 1, 2, ... in the given order without one task seeing all rows.

    The rows are range-sorted over many partitions and stored once with the place each got, then every partition's
    start is added. Ties are broken by input place, so that rows of one repeated key still spread.
    """
    placed = (
        df.withColumn("__place", F.monotonically_increasing_id())
        .orderBy(*order, "__place")
        .select(
            *df.columns,
            F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN_PARTITION)).alias("__offset"),
        )
    )
    stored = cut_lineage(placed)
    # One row per partition: small enough for one window and for a broadcast, whatever the data.
    starts = (
        stored.groupBy("__part")
        .agg(F.count("*").alias("__size"))
        .select(
            "__part",
            (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"),
        )
    )
    return stored.join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__start") + F.col("__offset")).alias("position")
    )


def id_batches(ids: DataFrame, key: str, *order: str, size: int = REQUEST_SIZE) -> DataFrame:
    """Comma-joined batches of ``size`` ids, the last one shorter; a batch never holds more than ``size`` rows."""
    placed = numbered(ids, *(order or (key,)))
    batches = placed.groupBy((F.floor(F.col("position") / size)).cast("bigint").alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(key).alias("id")))).alias("members")
    )
    return batches.select(
        "batch_no",
        F.size("members").cast("bigint").alias("n_ids"),
        F.concat_ws(",", F.transform("members", lambda m: m["id"].cast("string"))).alias("ids"),
    )
