"""Restrict tables to id lists, and leave out what is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.functions.demographics import user_bucket
from panelforge.functions.hashing import spreading_salt
from panelforge.operators import blooms
from panelforge.session import parked

# 4 million 8-byte ids make a hash table of about 100 MB on each executor.
MAX_BROADCAST_IDS = 4_000_000
# The same in bytes of the values alone: longer keys fit fewer rows.
MAX_BROADCAST_BYTES = 32 << 20
# A list from files of at most this size, compressed, is broadcast without being counted.
SURELY_SMALL = 4 << 20
SALTS = 16
# A key with more than one in so many rows is spread over the salts, if it has more rows than any task has no trouble with.
HEAVY = 1_000
HEAVY_ROWS = 10_000


# Nodes of a plan that give at most the rows of what they read, so that the size of the files bounds the distinct values.
_SHRINKING = {"Project", "Filter", "LocalRelation", "Range", "Aggregate", "Distinct", "SubqueryAlias"}


def surely_small(df: DataFrame) -> bool:
    """Whether files or local rows of at most ``SURELY_SMALL`` bytes are all that the plan reads, and nothing adds rows.

    The optimizer knows that without a job. For lists that are made distinct: a file may hold one value very often.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) > SURELY_SMALL:
        return False
    todo = [plan]
    while todo:
        node = todo.pop()
        if not (node.nodeName() in _SHRINKING or node.nodeName().startswith("Relation") or node.nodeName() == "LogicalRelation"):
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return True


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_IDS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` is small enough in rows and in bytes of values; two numbers reach the driver.

    Give the columns that are joined and no others: they are all that is measured and read.
    """
    width = sum((_value_bytes(df, c) for c in df.columns), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def _value_bytes(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 8
    return F.lit(8)


def heavy_keys(df: DataFrame, key: str, one_in: int = HEAVY, least: int = 0) -> list:
    """Keys that hold more than one in ``one_in`` of the rows and more than ``least`` rows: about ``one_in`` at most,
    however large the table is.

    One pass over the key column: every task keeps a sketch of frequent items, and the sketches are merged. A sketch may
    count an item too high by a small share of all rows, so that a key just below the bound can be among them; none above
    it is missed.
    """
    kept = 16 * one_in
    # The sketch of ``kept`` items is exact to 3.5 / (4 / 3 * kept) of the rows and may stay below by as much.
    slack = 3.5 / (4 / 3 * kept)
    named = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    top = named.agg(F.expr(f"approx_top_k(key, {2 * one_in}, {kept})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    bound = max(top.n * (1 / one_in - slack), least)
    return sorted(item["item"] for item in top.top or () if item["count"] > bound)


def _salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, salts: int) -> DataFrame:
    """Join in which the rows of busy left keys spread over salts; only their rows of ``right`` are repeated."""
    on = F.col(left_key) == F.col(right_key)
    heavy = heavy_keys(left, left_key, least=HEAVY_ROWS)
    if not heavy:
        return left.join(right, on, how)
    last = F.when(F.col(right_key).isin(heavy), salts - 1).otherwise(0)
    repeated = right.withColumn("__right_salt", F.explode(F.sequence(F.lit(0), last)))
    salt = F.when(F.col(left_key).isin(heavy), spreading_salt(salts, *left.columns)).otherwise(0)
    salted = left.withColumn("__salt", salt)
    return salted.join(repeated, on & (F.col("__salt") == F.col("__right_salt")), how).drop("__salt", "__right_salt")


def join_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str, max_broadcast: int, salts: int = SALTS) -> DataFrame:
    """Inner join on keys of different names. ``right`` is broadcast if its checked size allows, otherwise joined by key
    with busy keys salted. Project ``right`` first: all of its columns count and travel."""
    if fits_broadcast(right, max_broadcast):
        return left.join(F.broadcast(right), F.col(left_key) == F.col(right_key))
    return _salted_join(left, right, left_key, right_key, "inner", salts)


def match_ids(
    df: DataFrame, key: str, ids: DataFrame, how: str, max_broadcast: int = MAX_BROADCAST_IDS, salts: int = SALTS, max_filter_bytes: int = blooms.MAX_BYTES
) -> DataFrame:
    """Join ``df`` on ``key`` with a one-column id list: ``left_semi`` keeps listed rows, ``left_anti`` the others.

    A list of checked size is broadcast and ``df`` is not shuffled at all; a list read from small files is not counted
    for that. A longer list is written once and joined by key, with the rows of busy keys spread over salts. Before a semi join, a Bloom filter of the list drops nearly all rows
    that cannot match inside the scan stage, as long as the filter has at most ``max_filter_bytes``. Keys that are nearly
    unique, like post ids, have no busy ones: ``salts=1`` spares looking for them.
    """
    (id_column,) = ids.columns
    listed = ids.select(F.col(id_column).alias("__id")).filter(F.col("__id").isNotNull())
    if (max_broadcast >= MAX_BROADCAST_IDS and surely_small(listed)) or fits_broadcast(listed, max_broadcast):
        return df.join(F.broadcast(listed.distinct()), F.col(key) == F.col("__id"), how)
    listed = parked(listed.distinct(), "ids")
    if how == "left_semi":
        df = blooms.may_match(df, key, listed, max_filter_bytes)
    if salts == 1:
        return df.join(listed, F.col(key) == F.col("__id"), how)
    return _salted_join(df, listed, key, "__id", how, salts)


def in_buckets(ids: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Ids with their bucket number, restricted to a range of buckets."""
    return ids.withColumn("user_id_bucket", user_bucket(F.col(key))).filter(
        F.col("user_id_bucket").between(low, high)
    )


def posts_of_followees(
    posts: DataFrame, followees: DataFrame, low: int = 0, high: int = 39, max_broadcast: int = MAX_BROADCAST_IDS
) -> DataFrame:
    """Distinct posts by listed users whose bucket lies in the range, with the bucket.

    The bucket follows from the id, so the join itself needs no column of the list.
    """
    (key,) = followees.columns
    wanted = in_buckets(followees, key, low, high).select(key)
    kept = match_ids(posts, "user_id", wanted, "left_semi", max_broadcast)
    return distinct_posts(kept).withColumn("user_id_bucket", user_bucket(F.col("user_id")))


def distinct_posts(posts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct rows. They meet by their other columns and a digest of the text, so that no text is a key of the shuffle;
    texts of one digest are compared, and copies collapse inside each task first."""
    others = [c for c in posts.columns if c != text]
    digest = F.md5(F.col(text).cast("binary")).alias("__digest")
    groups = posts.select(*others, digest, text).groupBy(*others, "__digest").agg(F.collect_set(text).alias("__texts"))
    return groups.select(*others, F.explode_outer("__texts").alias(text)).select(posts.columns)


def without_busy_copies(posts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The rows, with the copies of posts that occur very often collapsed: what remains of an id fits one task."""
    busy = heavy_keys(posts, key, least=HEAVY_ROWS)
    if not busy:
        return posts
    return posts.filter(~F.coalesce(F.col(key).isin(busy), F.lit(False))).unionByName(distinct_posts(posts.filter(F.col(key).isin(busy)), text))


def posts_of_panel(posts: DataFrame, panel: DataFrame, max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Posts by panel members; a panel id listed twice does not repeat its posts."""
    return match_ids(posts, "user_id", panel, "left_semi", max_broadcast)


def not_done(todo: DataFrame, key: str, done: DataFrame, max_broadcast: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows of ``todo`` whose key has no finished result: how an interrupted job resumes."""
    return match_ids(todo, key, done, "left_anti", max_broadcast, salts=1)
