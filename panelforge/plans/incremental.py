"""Embed posts once: by day and user bucket, or by post id."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.functions.demographics import user_bucket
from panelforge.functions.hashing import spreading_salt
from panelforge.operators.joins import MAX_BROADCAST_IDS, not_done
from panelforge.rules import USER_BUCKETS
from panelforge.session import parked
from panelforge.sources import snapshots


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from ``first`` to ``last`` as text."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    )
    return days.select(F.col("day").cast("string").alias("ds"))


def work_units(spark: SparkSession, first: str, last: str, buckets: int = USER_BUCKETS) -> DataFrame:
    """Every (day, user bucket) of a calendar."""
    return calendar(spark, first, last).withColumn(
        "user_id_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    )


def missing_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Work units without a single result row. Results shrink to units inside the map tasks."""
    return units.join(done.select(*units.columns).distinct(), units.columns, "left_anti")


def clustered(df: DataFrame, n_partitions: int, by: str, row_id: str = "id", folders: int = 1) -> DataFrame:
    """Even partitions for an encoder and a write with ``partitionBy(by)`` into about ``folders`` folders.

    A folder's rows get four keys for each partition that is its share. A single folder therefore keeps nearly all
    partitions busy, and many folders have few files each; one shuffle serves both.
    """
    keys = 4 * -(-n_partitions // max(1, folders))
    salted = df.withColumn("__salt", spreading_salt(keys, row_id))
    return salted.repartition(n_partitions, by, "__salt").drop("__salt")


UNIT = ("ds", "user_id_bucket")


def _mark(ds: str, bucket: int) -> str:
    """A finished unit among the marks of a sink, also one without any row."""
    return f"unit {ds} {bucket}"


def finished_units(state: snapshots.Manifest) -> set[tuple[str, int]]:
    marks = [mark.split() for mark in state.marks if mark.startswith("unit ")]
    return {(ds, int(bucket)) for _, ds, bucket in marks}


def open_units(spark: SparkSession, sink: str, first: str, last: str, buckets: tuple[int, int]) -> list[tuple[str, int]]:
    """The (day, user bucket) cells asked for that no earlier run has finished."""
    done = finished_units(snapshots.current(spark, sink))
    cells = work_units(spark, first, last).filter(F.col("user_id_bucket").between(*buckets)).collect()
    return [(r.ds, r.user_id_bucket) for r in cells if (r.ds, r.user_id_bucket) not in done]


def of_units(posts: DataFrame, cells: Iterable[tuple[str, int]], user_id: str = "user_id") -> DataFrame:
    """The posts of some units, with their bucket. The days become a literal list, so that the scan prunes to them."""
    cells = sorted(cells)
    days = sorted({ds for ds, _ in cells})
    units = posts.sparkSession.createDataFrame(cells, "ds STRING, user_id_bucket INT")
    placed = posts.filter(F.col("ds").isin(days)).withColumn("user_id_bucket", user_bucket(F.col(user_id)))
    # Broadcast: calendar cells, a few dozen per day.
    return placed.join(F.broadcast(units), list(UNIT), "left_semi")


def embed_days(
    posts: DataFrame,
    sink: str,
    first: str,
    last: str,
    encode: Callable[[DataFrame], DataFrame],
    buckets: tuple[int, int] = (0, USER_BUCKETS - 1),
    user_id: str = "user_id",
    marks: Iterable[str] = (),
) -> list[str]:
    """Embed the (day, user bucket) units that no earlier run has finished, in one job; returns their days.

    The sink is a snapshot table partitioned by both. ``encode`` keeps ``ds`` and ``user_id_bucket``. Vectors and the
    units' marks become visible in one step: a crashed job leaves neither, a unit without posts is not scanned again.
    """
    spark = posts.sparkSession
    cells = open_units(spark, sink, first, last, buckets)
    if not cells:
        return []
    done = [*marks, *(_mark(*cell) for cell in cells)]
    snapshots.replace_units(encode(of_units(posts, cells, user_id)), sink, UNIT, cells, marks=done)
    return sorted({ds for ds, _ in cells})


def embed_new_ids(
    posts: DataFrame,
    sink: str,
    encode: Callable[[DataFrame], DataFrame],
    max_broadcast: int = MAX_BROADCAST_IDS,
    partition_by: tuple[str, ...] = ("ds",),
    marks: Iterable[str] = (),
) -> None:
    """Embed the posts whose id the sink lacks and append them; a second run appends nothing.

    An id that the input holds more than once is embedded once. Posts without an id are left to ``without_id``.
    """
    spark = posts.sparkSession
    named = posts.filter(F.col("id").isNotNull())
    if snapshots.exists(spark, sink):
        named = not_done(named, "id", snapshots.read(spark, sink).select("id"), max_broadcast)
    snapshots.append(encode(named.dropDuplicates(["id"])), sink, partition_by, marks=marks)


def listed_ids(sink: str) -> str:
    """Where a job keeps the id lists that its sink covers."""
    return sink.rstrip("/") + "_listed"


def late_ids(spark: SparkSession, sink: str, ids: DataFrame) -> tuple[DataFrame, str] | None:
    """Ids that the finished units of a sink do not cover yet, and the mark to publish with their rows.

    None if the list is the one that the newest mark names: then no post need be looked at. The list itself is kept as a
    snapshot table; its number in the mark makes list and rows agree also after a crash between the two.
    """
    (key,) = ids.columns
    listed = parked(ids.select(F.col(key).alias("user_id")).filter(F.col(key).isNotNull()).distinct(), "listed")
    n, total = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("user_id").cast("decimal(20,0)")), F.lit(0))).first()
    digest = f"{n}:{total}"
    old = [mark.split() for mark in snapshots.current(spark, sink).marks if mark.startswith("listed ")]
    _, number, before = old[-1] if old else (None, 0, None)
    if before == digest:
        return None
    new = listed if not old else not_done(listed, "user_id", snapshots.read(spark, listed_ids(sink), int(number)))
    mark = f"listed {snapshots.overwrite(listed, listed_ids(sink)).number} {digest}"
    return parked(new, "late"), mark


def without_id(posts: DataFrame) -> DataFrame:
    """Posts that cannot be embedded once, because they have no id."""
    return posts.filter(F.col("id").isNull())
