"""Units in few files and even tasks."""

import random
from collections import Counter

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from panelforge.functions.demographics import user_bucket
from panelforge.operators import encoding, joins, packing
from panelforge.plans import incremental, jobs, testdata as td
from panelforge.sources import readers, snapshots, writers

UNIT = ("ds", "user_id_bucket")


@pytest.mark.parametrize("n_tasks", [1, 7, 120])
def test_plans_are_even_and_keep_small_units_whole(n_tasks):
    rng = random.Random(n_tasks)
    sizes = {(d, b): int(rng.paretovariate(1.2) * 20) for d in range(122) for b in range(40)}
    sizes[0, 0] = sum(sizes.values()) // 2  # one unit holds a third of all rows
    plan = packing.planned(sizes, n_tasks)
    share = -(-sum(sizes.values()) // n_tasks)
    assert plan.keys() == sizes.keys() and all(len(t) == max(1, -(-sizes[u] // share)) for u, t in plan.items())
    loads = Counter()
    for unit, tasks in plan.items():
        for t in tasks:
            loads[t] += sizes[unit] / len(tasks)
    assert set(loads) == set(range(n_tasks)) and max(loads.values()) <= 1.34 * share
    assert packing.planned({}, 5) == {} and packing.planned({"u": 0}, 5) == {"u": [0]}


def test_four_months_write_about_one_file_a_unit(spark, tmp_path):
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.pmod(F.xxhash64("id"), F.lit(122))).cast("int")).cast("string")
    user = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    posts = spark.range(60_000).select("id", user.alias("user_id"), days.alias("ds")).withColumn("user_id_bucket", user_bucket(F.col("user_id"))).repartition(9)
    units = posts.select(*UNIT).distinct().count()
    assert units == 122 * 40
    packed = packing.packed(posts, UNIT, 24)
    busy = Counter(r.p for r in packed.select(F.spark_partition_id().alias("p")).collect())
    assert len(busy) == 24 and max(busy.values()) < 1.4 * 60_000 / 24
    snapshots.append(packed.drop(packing.TASK), str(tmp_path / "t"), UNIT)
    files = snapshots.read(spark, str(tmp_path / "t")).inputFiles()
    assert units <= len(files) <= 1.05 * units
    assert rows(snapshots.read(spark, str(tmp_path / "t")), "id") == rows(posts, "id")


def test_null_units_and_late_rows_have_a_task(spark):
    posts = spark.createDataFrame([(1, None, 3), (2, "a", None), (3, "a", 1), (None, "b", 1)], "id BIGINT, ds STRING, user_id_bucket INT")
    packed = packing.packed(posts, UNIT, 3, sizes={("a", 1): 1})
    assert rows(packed.drop(packing.TASK)) == rows(posts)
    assert rows(packing.packed(posts, UNIT, 3).drop(packing.TASK)) == rows(posts)


def test_copies_collapse_in_the_packed_tasks_without_another_shuffle(spark):
    posts = td.document_posts(spark, f"{TESTDATA}/sf0.001").withColumn("user_id_bucket", user_bucket(F.col("user_id")))
    odd = spark.createDataFrame([(1, 7, None, "2024-01-02", 7), (1, 7, "other", "2024-01-02", 7), (None, 7, "x", "2024-01-02", 7)], "id BIGINT, user_id BIGINT, text STRING, ds STRING, user_id_bucket INT")
    everything = td.repeated(posts).unionByName(odd).unionByName(odd)
    once = joins.distinct_posts(packing.packed(everything, UNIT, 5))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") - plan.count("ReusedExchange") == 1
    assert rows(once.drop(packing.TASK), *posts.columns) == rows(everything.distinct(), *posts.columns)


def test_texts_are_no_key_of_the_shuffle(spark):
    posts = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "")], "id BIGINT, text STRING")
    once = joins.distinct_posts(posts)
    plan = once._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "text" not in exchange and rows(once) == sorted([(1, "a"), (1, None), (2, "")], key=repr)


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(joins.F, "md5", lambda _: F.lit("same"))
    posts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a")], "id BIGINT, text STRING")
    assert rows(joins.distinct_posts(posts)) == [(1, "a"), (1, "b"), (2, "a")]


def test_busy_copies_collapse_before_they_meet(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 1000)
    copies = spark.range(9000).select(F.lit(5).cast("bigint").alias("id"), F.lit("same").alias("text"))
    others = spark.range(100, 5100).select("id", F.lit("t").alias("text"))
    kept = joins.without_busy_copies(copies.unionByName(others).unionByName(others.limit(1).withColumn("id", F.lit(None).cast("bigint"))))
    assert kept.filter("id = 5").count() == 1 and kept.count() == 5002


def test_the_job_covers_a_growing_and_shrinking_list(spark, tmp_path, monkeypatch):
    root, sink = str(tmp_path / "posts"), str(tmp_path / "sink")
    posts = td.repeated(td.stream_posts(spark, f"{TESTDATA}/sf0.001"))
    writers.write_json(posts, root, partition_by=("ds",), compression=None)
    flat = readers.flat_posts(posts, "text", "ds")
    users = sorted(r.user_id for r in flat.select("user_id").distinct().collect())

    def run(ids, first, last):
        listed = spark.createDataFrame([(i,) for i in [*ids, *ids[:1]]] + [(None,)], "uid BIGINT")
        jobs.embed_followee_posts(spark, root, listed, sink, first, last, encoding.hash_encoder(4), 4)

    def holds(spans):
        # A unit has the posts of every list that was given since it was asked for.
        expected = {(r.id, r.ds) for r in flat.collect() for days, ids in spans if days[0] <= r.ds <= days[1] and r.user_id in ids}
        got = [(r.id, str(r.ds)) for r in snapshots.read(spark, sink).select("id", "ds").collect()]
        assert len(got) == len(set(got)) and set(got) == expected

    a, b = users[::3], users[1::3]
    early, late = ("2024-01-01", "2024-01-08"), ("2024-01-09", "2024-01-31")
    run(a, *early)
    holds([(early, a)])
    run(b, *late)  # a is gone, b is new to the early days
    holds([(early, a + b), (late, b)])
    run(a + b, *early)  # a comes back: nothing twice, and the late days get it
    holds([(early, a + b), (late, a + b)])
    before = snapshots.current(spark, sink)
    scanned = []
    monkeypatch.setattr(jobs.incremental, "of_units", lambda *args: scanned.append(args))
    run(a + b, *early)  # nothing new: no post is looked at
    assert scanned == [] and snapshots.current(spark, sink) == before


def test_a_crash_between_list_and_vectors_is_made_good(spark, tmp_path, monkeypatch):
    root, sink = str(tmp_path / "posts"), str(tmp_path / "sink")
    posts = td.stream_posts(spark, f"{TESTDATA}/sf0.001")
    writers.write_json(posts, root, partition_by=("ds",), compression=None)
    followees = td.followee_uids(spark, f"{TESTDATA}/sf0.001")
    few = followees.filter("followee_uid % 2 = 0")

    def run(ids):
        return jobs.embed_followee_posts(spark, root, ids, sink, "2024-01-01", "2024-01-31", encoding.hash_encoder(4), 4)

    run(few)
    before = rows(snapshots.read(spark, sink), "id")
    with monkeypatch.context() as patch:
        patch.setattr(jobs.snapshots, "append", lambda *args, **kwargs: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(followees)
    assert rows(snapshots.read(spark, sink), "id") == before
    assert run(followees) == []
    expected = joins.posts_of_followees(readers.flat_posts(posts, "text", "ds"), followees)
    assert rows(snapshots.read(spark, sink), "id") == rows(expected, "id")
    assert incremental.finished_units(snapshots.current(spark, sink)) == {(f"2024-01-{d:02d}", b) for d in range(1, 32) for b in range(40)}
