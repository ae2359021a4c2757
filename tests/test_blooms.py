"""Bloom filters of long id lists, size checks in bytes, and sketches of busy keys."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelforge.operators import blooms, joins


@pytest.mark.parametrize("n", [0, 1, 50, 20_000])
def test_no_false_negative_and_few_false_matches(spark, n):
    ids = spark.range(n).select((F.col("id") * 7919 - 1_000_000).alias("uid"))
    words, asked = blooms.shape(n)
    array = blooms.built(ids, words, asked).scalar()
    passed = lambda df: df.filter(blooms.passes(F.col("uid"), array, words, asked)).count()
    assert passed(ids) == n
    others = spark.range(30_000).select((F.col("id") * 7919 - 1_000_001).alias("uid"))
    assert passed(others) <= (0.015 * 30_000 if n > 50 else 0.03 * 30_000)
    assert passed(spark.range(5).select(F.lit(None).cast("bigint").alias("uid"))) == 0


def test_the_array_holds_exactly_the_bits(spark):
    ids = spark.createDataFrame([(5,), (6,), (None,), (5,)], "uid BIGINT")
    words = blooms.built(ids, 9, 4).first().words
    bits = {w * 64 + b for w, v in enumerate(words) for b in range(64) if v >> b & 1}
    asked = ids.filter("uid is not null").select(F.explode(F.array(*blooms._positions(F.col("uid"), 9, 4))).alias("p"))
    assert len(words) == 9 and bits == {r.p for r in asked.collect()} and max(bits) < 9 * 64


def test_texts_as_ids(spark):
    ids = spark.createDataFrame([("ä",), ("b" * 5000,), ("",)], "uid STRING")
    df = spark.createDataFrame([("ä", 1), ("b" * 5000, 2), ("", 3), ("c", 4), (None, 5)], "key STRING, n INT")
    kept = {r.n for r in blooms.may_match(df, "key", ids).collect()}
    assert {1, 2, 3} <= kept and 5 not in kept


def shuffled_rows(plan):
    """Rows written by each exchange of an executed plan."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            metric = node.metrics().get("shuffleRecordsWritten")
            found.append(metric.get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_a_list_of_ten_million_ids_shuffles_little_but_matches(spark):
    """Of 400,000 posts one in fifty is listed: about as many rows of them are shuffled, not 400,000."""
    ids = spark.range(10_000_000).select((F.col("id") * 3).alias("uid"))
    posts = spark.range(400_000).select("id", F.when(F.col("id") % 50 == 0, F.col("id") * 3).otherwise(F.col("id") * 3 + 1).alias("user_id"))
    kept = joins.match_ids(posts, "user_id", ids, "left_semi", salts=1)
    found = kept.collect()
    assert {r.id for r in found} == set(range(0, 400_000, 50)) and len(found) == 8000
    written = shuffled_rows(kept._jdf.queryExecution().executedPlan())
    assert sorted(written)[0] < 8000 + 0.02 * 400_000


def test_paths_agree(spark, monkeypatch):
    monkeypatch.setattr(joins, "HEAVY_ROWS", 100)
    rng = np.random.default_rng(1)
    users = [int(u) for u in np.where(rng.random(3000) < 0.33, 7, rng.integers(0, 900, 3000))]
    posts = spark.createDataFrame([(i, None if i % 97 == 0 else u) for i, u in enumerate(users)], "id BIGINT, user_id BIGINT").repartition(5)
    ids = spark.createDataFrame([(u,) for u in [7, 7, *range(0, 900, 4)]] + [(None,)], "uid BIGINT")
    for how in ("left_semi", "left_anti"):
        results = [rows(joins.match_ids(posts, "user_id", ids, how, max_broadcast=limit, salts=salts, max_filter_bytes=size)) for limit, salts, size in ((10**7, 16, 0), (0, 16, 1 << 20), (0, 1, 1 << 20), (0, 16, 0))]
        assert all(r == results[0] for r in results) and results[0]


def test_size_is_checked_in_bytes_and_rows(spark):
    long = spark.range(1000).select(F.repeat(F.lit("x"), 10_000).alias("key"))
    assert not joins.fits_broadcast(long, max_bytes=1 << 20) and joins.fits_broadcast(long, max_bytes=1 << 24)
    assert not joins.fits_broadcast(spark.range(11), max_rows=10) and joins.fits_broadcast(spark.range(10), max_rows=10)
    nested = spark.range(10).select(F.array_repeat(F.lit("abc"), 1000).alias("a"), F.lit(None).cast("string").alias("s"))
    assert not joins.fits_broadcast(nested, max_bytes=30_000) and joins.fits_broadcast(nested, max_bytes=100_000)
    assert joins.fits_broadcast(spark.range(0).select(F.lit("x").alias("k")), max_rows=0)


def test_small_files_are_broadcast_without_a_job(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    posts = spark.range(5000).withColumnRenamed("id", "user_id")
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    kept = joins.match_ids(posts, "user_id", ids.filter("id > 5"), "left_semi")
    assert spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() == before and kept.count() == 994
    # A plan that grows its rows is not taken at its word, nor are large files or Python's rows.
    grown = ids.select(F.explode(F.sequence(F.lit(0), F.lit(9_999))).alias("id"))
    assert joins.surely_small(ids.distinct()) and not joins.surely_small(grown)
    assert not joins.surely_small(ids.mapInArrow(lambda batches: batches, "id BIGINT"))
    assert not joins.surely_small(ids.crossJoin(ids.select(F.col("id").alias("b"))))
    assert not joins.surely_small(spark.range(10_000_000))


def test_sketches_find_the_busy_keys_in_one_job(spark):
    n = 300_000
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 == 1, F.col("id") % 3 + 100).otherwise(F.col("id"))
    df = spark.range(0, n, 1, 13).select(F.when(F.col("id") % 1000 != 5, key).alias("k"))
    counts = {r.k: r["count"] for r in df.groupBy("k").count().collect() if r.k is not None}
    total = sum(counts.values())
    above = {k for k, c in counts.items() if c * joins.HEAVY > total}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("sketch", "")
    found = joins.heavy_keys(df, "k")
    jobs = len(tracker.getJobIdsForGroup("sketch"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert above <= set(found) and all(counts[k] * 1.5 * joins.HEAVY > total for k in found)
    assert jobs <= 2  # adaptive execution runs the two stages of one query as jobs
    assert joins.heavy_keys(df.filter("k < 0"), "k") == [] and joins.heavy_keys(df, "k", least=50_000) == [7]
    texts = df.select(F.concat(F.lit("u"), F.col("k").cast("string")).alias("t"))
    assert "u7" in joins.heavy_keys(texts, "t")
