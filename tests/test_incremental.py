from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from panelforge.functions.hashing import hash_embed
from panelforge.operators.labeling import label_bios, match_any, profile_of_author
from panelforge.plans import incremental, testdata as td
from panelforge.rules import INTENDED
from panelforge.sources import readers, snapshots, writers
from panelforge.streaming import labels as streaming


def _encode(df):
    return hash_embed(incremental.clustered(df, 4, "ds", folders=8), "text", 4).drop("text")


def _posts(spark):
    return td.document_posts(spark, f"{TESTDATA}/sf0.001")


def test_whole_days_once(spark, tmp_path):
    posts, sink = _posts(spark), str(tmp_path / "days")
    assert incremental.embed_days(posts, sink, "2024-01-01", "2024-01-03", _encode) == [
        "2024-01-01", "2024-01-02", "2024-01-03",
    ]
    assert len(incremental.embed_days(posts, sink, "2024-01-01", "2024-01-30", _encode)) == 27
    assert incremental.embed_days(posts, sink, "2024-01-01", "2024-01-30", _encode) == []
    done = snapshots.read(spark, sink)
    assert rows(done.select("id")) == rows(posts.select("id"))


def test_replacing_a_day_leaves_the_others(spark, tmp_path):
    sink = str(tmp_path / "r")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id BIGINT, ds STRING")
    writers.replace_partitions(df, sink, ("ds",))
    writers.replace_partitions(df.filter("id <> 2 AND ds = 'a'"), sink, ("ds",))
    assert rows(readers.read_parquet(spark, sink)) == [(1, "a"), (3, "b")]


def test_new_ids_once(spark, tmp_path):
    posts, sink = _posts(spark), str(tmp_path / "ids")
    incremental.embed_new_ids(posts.filter("id < 50"), sink, _encode)
    for limit in (100_000, 0):
        incremental.embed_new_ids(posts, sink, _encode, max_broadcast=limit)
        assert rows(snapshots.read(spark, sink).select("id")) == rows(posts.select("id"))


def test_clustered_bounds_files_per_folder(spark, tmp_path):
    posts = _posts(spark)
    writers.write_parquet(incremental.clustered(posts, 8, "ds", folders=30), str(tmp_path / "c"), partition_by=("ds",))
    for folder in (tmp_path / "c").glob("ds=*"):
        assert 1 <= len(list(folder.glob("part-*"))) <= 4


def test_one_day_keeps_the_encoder_partitions_busy(spark):
    day = spark.range(5000).withColumn("ds", F.lit("2024-01-01"))
    placed = incremental.clustered(day, 120, "ds").select(F.spark_partition_id().alias("p"))
    assert placed.distinct().count() > 100


def test_bucket_ranges_add_up_and_copies_count_once(spark, tmp_path):
    posts, sink = _posts(spark), str(tmp_path / "halves")
    for buckets, n in (((0, 19), 3), ((20, 39), 3), ((0, 39), 0)):
        assert len(incremental.embed_days(posts, sink, "2024-01-01", "2024-01-03", _encode, buckets)) == n
    assert rows(snapshots.read(spark, sink), "id") == rows(posts.filter("ds <= '2024-01-03'"), "id")
    copies = posts.unionByName(posts).unionByName(posts.withColumn("id", F.lit(None).cast("bigint")))
    ids = str(tmp_path / "ids")
    for _ in range(3):
        incremental.embed_new_ids(copies, ids, _encode)
    assert rows(snapshots.read(spark, ids), "id") == rows(posts, "id")
    assert incremental.without_id(copies).count() == posts.count()


def test_days_are_pruned_by_name(spark, tmp_path):
    writers.write_parquet(_posts(spark), str(tmp_path / "p"), partition_by=("ds",))
    stored = spark.read.schema("id BIGINT, user_id BIGINT, text STRING, ds STRING").parquet(str(tmp_path / "p"))
    plan = stored.filter(F.col("ds").isin(["2024-01-02", "2024-01-05"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [ds" in plan


def test_gap_report(spark):
    units = incremental.work_units(spark, "2024-02-28", "2024-03-01", buckets=2)
    assert units.count() == 6  # leap day
    done = spark.createDataFrame([("2024-02-29", 1, "x"), ("2024-02-29", 1, "y"), ("2024-03-01", 0, "z")],
                                 "ds STRING, user_id_bucket INT, v STRING")
    assert rows(incremental.missing_units(units, done)) == [
        ("2024-02-28", 0), ("2024-02-28", 1), ("2024-02-29", 0), ("2024-03-01", 1),
    ]


def test_stream_equals_batch_and_restarts_add_nothing(spark, tmp_path):
    posts = td.stream_posts(spark, f"{TESTDATA}/sf0.001")
    landing, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    expected = label_bios(match_any(profile_of_author(posts), "user_bio", INTENDED.first_stage()))

    def run():
        arriving = streaming.arriving_posts(spark, landing, files_per_batch=5)
        streaming.write_labels(streaming.label_stream(arriving), sink, checkpoint).awaitTermination()
        return readers.read_parquet(spark, sink).withColumn("ds", F.col("ds").cast("string"))

    early = posts.filter("ds <= '2024-01-10'")
    writers.write_json(early, landing, partition_by=("ds",), compression=None)
    columns = expected.columns
    assert rows(run(), *columns) == rows(expected.filter("ds <= '2024-01-10'"), *columns)
    writers.write_json(posts.filter("ds > '2024-01-10'"), landing, partition_by=("ds",), compression=None)
    assert rows(run(), *columns) == rows(expected, *columns)
    assert rows(run(), *columns) == rows(expected, *columns)


def test_stream_labels_every_profile_once(spark, tmp_path):
    posts = td.stream_posts(spark, f"{TESTDATA}/sf0.001")
    landing, sink, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    columns = ["user_bio", "user_id", "user_screen_name", "age_label", "gender_label"]

    def land(first, last, more=None):
        days = posts.filter(F.col("ds").between(first, last))
        writers.write_json(days if more is None else days.unionByName(more), landing, partition_by=("ds",), compression=None)
        once = streaming.distinct_bio_stream(streaming.arriving_posts(spark, landing, files_per_batch=7))
        streaming.write_labels(once, sink, checkpoint).awaitTermination()
        return rows(readers.read_parquet(spark, sink), *columns)

    def batch(upto):
        bios = match_any(profile_of_author(posts.filter(F.col("ds") <= upto)), "user_bio", INTENDED.first_stage())
        return rows(label_bios(bios.dropDuplicates(["user_bio", "user_id", "user_screen_name"]), INTENDED), *columns)

    assert land("2024-01-05", "2024-01-12") == rows(
        label_bios(match_any(profile_of_author(posts.filter(F.col("ds").between("2024-01-05", "2024-01-12"))), "user_bio", INTENDED.first_stage()).dropDuplicates(["user_bio", "user_id", "user_screen_name"]), INTENDED), *columns
    )
    assert land("2024-01-01", "2024-01-20") == batch("2024-01-20")  # days that were there, and older ones
    assert land("2024-01-15", "2024-01-31", posts.filter("ds = '2024-01-02'")) == batch("2024-01-31")
    streaming.write_labels(streaming.distinct_bio_stream(streaming.arriving_posts(spark, landing)), sink, checkpoint).awaitTermination()
    assert rows(readers.read_parquet(spark, sink), *columns) == batch("2024-01-31")
