"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge import schemas
from panelforge.functions.demographics import age_on, is_default_image, user_bucket
from panelforge.functions.hashing import DEFAULT_DIM, hash_embed, token_slots
from panelforge.functions.registry import register_functions
from panelforge.operators import batching, encoding, evaluation, inference, joins, labeling, responses, summaries
from panelforge.plans import incremental, jobs, testdata as td
from panelforge.rules import INTENDED, LITERAL, UNLABELED_GENDER, RuleSet
from panelforge.session import run_folder
from panelforge.sources import readers, rejects, snapshots, writers
from panelforge.streaming import labels as streaming_labels

Query = Callable[[SparkSession, str], DataFrame]

SEED = 42
AGE_TODAY = "2021-06-30"
ANNOTATED_ON = "2018-08-01"
CALENDAR = ("2023-12-28", "2024-02-03")


def _date(text: str) -> Column:
    return F.lit(text).cast("date")


# Stated ages and genders


def matched_bios(spark: SparkSession, sf_dir: str, rules: RuleSet = INTENDED) -> DataFrame:
    posts = readers.between_days(td.stream_posts(spark, sf_dir), "2023-12-31", "2024-01-31")
    return labeling.match_any(labeling.profile_of_author(posts), "user_bio", rules.first_stage())


def labeled_bios(spark: SparkSession, sf_dir: str, rules: RuleSet = INTENDED) -> DataFrame:
    return labeling.label_bios(labeling.distinct_bios(matched_bios(spark, sf_dir, rules)), rules)


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_ages(labeling.distinct_bios(matched_bios(spark, sf_dir)))


def genders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labeling.label_genders(labeling.distinct_bios(matched_bios(spark, sf_dir)))


def posts_day_range(spark, sf_dir):
    posts = readers.between_days(td.stream_posts(spark, sf_dir, ("2024-01-10", "2024-01-31")), "2024-01-09", "2024-01-31")
    return summaries.counts_by(posts, "ds")


def posts_on_day(spark, sf_dir):
    posts = readers.on_day(td.stream_posts(spark, sf_dir, ("2024-01-16", "2024-01-16")), "2024-01-16")
    return readers.flat_posts(posts, "text", "ds")


def bio_distinct(spark, sf_dir):
    return labeling.distinct_bios(matched_bios(spark, sf_dir))


def bio_distinct_counts(spark, sf_dir):
    bios = matched_bios(spark, sf_dir)
    # Copies are counted per distinct row, so one aggregation gives both numbers.
    per_bio = bios.groupBy("user_bio", "user_id", "user_screen_name").agg(F.count("*").alias("copies"))
    return per_bio.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count("*").alias("distinct_rows"),
    )


def bio_labels_literal(spark, sf_dir):
    return labeled_bios(spark, sf_dir, LITERAL)


def gender_pattern_counts_female(spark, sf_dir):
    return summaries.counts_by(genders(spark, sf_dir), "gender_pattern", where="gender_label = 'FEMALE'")


def gender_pattern_counts_male(spark, sf_dir):
    return summaries.counts_by(genders(spark, sf_dir), "gender_pattern", where="gender_label = 'MALE'")


def female_pattern_7_bios(spark, sf_dir):
    kept = genders(spark, sf_dir).filter("gender_label = 'FEMALE' AND gender_pattern = 'gender_pattern_7'")
    return kept.select("user_id", "user_bio")


def age_pattern_counts(spark, sf_dir):
    return summaries.counts_by(ages(spark, sf_dir), "age_pattern")


def age_label_counts_sorted(spark, sf_dir):
    return summaries.counts_by(ages(spark, sf_dir), "age_label").orderBy("age_label")


def age_label_preview(spark, sf_dir):
    """The first five labels in order, with their place."""
    first = summaries.first_by(summaries.counts_by(ages(spark, sf_dir), "age_label"), "age_label", 5)
    return first.withColumn("place", F.row_number().over(Window.orderBy("age_label")).cast("bigint"))


def age_groups(spark, sf_dir):
    return labeling.with_age_group(labeled_bios(spark, sf_dir))


def age_groups_sql(spark, sf_dir):
    register_functions(spark)
    readers.register(ages(spark, sf_dir), "labeled_set")
    return spark.sql(
        """
        SELECT user_id, age_label, validate_and_group_age(age_label) AS age_group FROM labeled_set
        WHERE validate_and_group_age(age_label) <> 'unlabeled_age'
        """
    )


def age_group_counts(spark, sf_dir):
    return summaries.counts_by(labeling.with_age_group(ages(spark, sf_dir)), "age_group")


def age_gender_overlap(spark, sf_dir):
    return summaries.contingency(age_groups(spark, sf_dir), "age_pattern", "gender_pattern")


def age_gender_cross_table(spark, sf_dir):
    grouped = age_groups(spark, sf_dir)
    return summaries.contingency(grouped, "age_pattern", "gender_label", ["MALE", "FEMALE", UNLABELED_GENDER])


def validation_age_export(spark, sf_dir):
    path = run_folder(spark, "validation-age")
    writers.export_table(labeling.validation_age(ages(spark, sf_dir), seed=SEED), path, mode="overwrite")
    return readers.read_table(spark, path, schemas.VALIDATION_AGE)


def validation_gender_export(spark, sf_dir):
    path = run_folder(spark, "validation-gender")
    writers.export_table(labeling.validation_gender(genders(spark, sf_dir), seed=SEED), path)
    return readers.read_table(spark, path, schemas.VALIDATION_GENDER)


# Post vectors


def id_bucket_filter(spark, sf_dir):
    ids = td.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("uid"))
    return joins.in_buckets(ids, "uid", 0, 19)


def posts_for_followees(spark, sf_dir):
    posts = td.repeated(readers.flat_posts(td.stream_posts(spark, sf_dir)))
    return joins.posts_of_followees(posts, td.followee_uids(spark, sf_dir))


def posts_for_panel(spark, sf_dir):
    posts = readers.flat_posts(td.panel_posts(spark, sf_dir), "full_text", "user_id_bucket")
    return joins.posts_of_panel(posts, td.panel_uids(spark, sf_dir))


def _long_form(embedded: DataFrame, *keys: str) -> DataFrame:
    return embedded.select(*keys, F.posexplode_outer("embed").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


def post_embeddings(spark, sf_dir):
    posts = td.document_posts(spark, sf_dir).drop("ds")
    kept = joins.posts_of_followees(posts, td.followee_uids(spark, sf_dir))
    return _long_form(hash_embed(kept, "text"), "id", "user_id", "user_id_bucket")


def panel_embeddings(spark, sf_dir):
    posts = readers.flat_posts(td.panel_posts(spark, sf_dir), "full_text", "user_id_bucket")
    kept = joins.posts_of_panel(posts, td.panel_uids(spark, sf_dir))
    path = run_folder(spark, "panel-embeddings")
    placed = incremental.clustered(kept, spark.sparkContext.defaultParallelism, "user_id_bucket", folders=40)
    writers.write_parquet(hash_embed(placed, "full_text"), path, "append", ("user_id_bucket",))
    return _long_form(readers.read_parquet(spark, path), "id", "user_id", "full_text", "user_id_bucket")


def embed_batches_udf(spark, sf_dir):
    posts = td.document_posts(spark, sf_dir).select("id", "text")
    n = spark.sparkContext.defaultParallelism
    return _long_form(encoding.embed(posts, "text", encoding.hash_encoder(), n_partitions=n), "id")


def embed_token_budget(spark, sf_dir):
    """The vectors of ``embed_batches_udf`` from batches by size."""
    posts = td.document_posts(spark, sf_dir).select("id", "text")
    n = spark.sparkContext.defaultParallelism
    return _long_form(encoding.embed(posts, "text", encoding.hash_encoder(), 64, n, token_budget=4096), "id")


def _slot_weights(spark, sf_dir) -> str:
    """A model archive in the shared folder: for each token slot the number of documents that have it."""
    slots = td.table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(token_slots(F.col("text"), DEFAULT_DIM))).alias("slot"))
    counts = dict(slots.groupBy("slot").count().collect())
    path = run_folder(spark, "model") + ".zip"
    with tempfile.TemporaryDirectory() as folder:
        np.save(f"{folder}/weights.npy", np.array([counts.get(i, 0) for i in range(DEFAULT_DIM)], dtype=np.float64))
        with zipfile.ZipFile(f"{folder}/model.zip", "w") as archive:
            archive.write(f"{folder}/weights.npy", "weights.npy")
        local, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (f"file://{folder}/model.zip", path))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(local, target)
    return path


def weighted_encoder() -> Callable[[str], encoding.Encoder]:
    """Mean weight of a text's tokens, and their number; the weights are shared pages of the model's file."""

    def build(path: str) -> encoding.Encoder:
        weights = encoding.mapped_array(f"{path}/weights.npy")
        slot = encoding.token_slot(len(weights))

        def encode(texts):
            places = [[slot(t) for t in encoding.tokens(text)] for text in texts]
            return [[float(weights[p].mean()) if p else 0.0, float(len(p))] for p in places]

        return encode

    return build


def embed_shipped_model(spark, sf_dir):
    """Vectors of a model that travels as an archive."""
    load = encoding.shipped(spark, _slot_weights(spark, sf_dir), weighted_encoder())
    posts = td.document_posts(spark, sf_dir).select("id", "text")
    vectors = encoding.embed(posts, "text", load, 64, spark.sparkContext.defaultParallelism)
    return vectors.select("id", F.round(F.get("embed", F.lit(0)), 6).alias("mean_weight"), F.get("embed", F.lit(1)).cast("bigint").alias("n_tokens"))


def _encode_by_day(df: DataFrame) -> DataFrame:
    n = df.sparkSession.sparkContext.defaultParallelism
    return hash_embed(incremental.clustered(df, n, "ds", folders=30), "text").drop("text")


def embed_increment(spark, sf_dir):
    """Two runs over overlapping calendars; the second does the rest."""
    posts, sink = td.document_posts(spark, sf_dir), run_folder(spark, "embed-by-day")
    incremental.embed_days(posts, sink, "2024-01-01", "2024-01-12", _encode_by_day)
    incremental.embed_days(posts, sink, "2024-01-01", "2024-01-31", _encode_by_day)
    done = snapshots.read(spark, sink)
    return _day_sums(done)


def embed_increment_by_id(spark, sf_dir):
    """A first run over the posts of a few days, a second over all posts."""
    posts, sink = td.document_posts(spark, sf_dir), run_folder(spark, "embed-by-id")
    incremental.embed_new_ids(readers.between_days(posts, "2024-01-05", "2024-01-20"), sink, _encode_by_day)
    unnamed = posts.withColumn("id", F.lit(None).cast("bigint"))
    for _ in range(2):  # repeated ids and missing ones add nothing, nor does a third run
        incremental.embed_new_ids(posts.unionByName(posts).unionByName(unnamed), sink, _encode_by_day)
    return _day_sums(snapshots.read(spark, sink))


def embed_bucket_halves(spark, sf_dir):
    """Two halves of the user buckets into one sink; a third run over all of them adds nothing."""
    posts, sink = td.document_posts(spark, sf_dir), run_folder(spark, "embed-halves")
    for buckets in ((0, 19), (20, 39), (0, 39)):
        incremental.embed_days(posts, sink, "2024-01-01", "2024-01-31", _encode_by_day, buckets)
    return _day_sums(snapshots.read(spark, sink))


def embed_grown_id_list(spark, sf_dir):
    """A list of a few users, then all of them: units that are done take the new users' posts by id."""
    posts, sink = td.document_posts(spark, sf_dir), run_folder(spark, "embed-grown")
    incremental.embed_days(posts.filter("user_id % 7 = 0"), sink, "2024-01-01", "2024-01-31", _encode_by_day)
    for _ in range(2):
        placed = posts.withColumn("user_id_bucket", user_bucket(F.col("user_id")))
        incremental.embed_new_ids(placed, sink, _encode_by_day, partition_by=("ds", "user_id_bucket"))
    return _day_sums(snapshots.read(spark, sink))


def embed_followee_job(spark, sf_dir):
    """The job over landed JSON posts, some of them twice: a short list for some days, then the whole list for all days."""
    root, sink = run_folder(spark, "posts"), run_folder(spark, "followee-vectors")
    writers.write_json(td.repeated(td.stream_posts(spark, sf_dir)), root, partition_by=("ds",), compression=None)
    followees = td.followee_uids(spark, sf_dir)
    n = spark.sparkContext.defaultParallelism
    for ids, last in ((followees.filter("followee_uid % 7 < 3"), "2024-01-09"), (followees, "2024-01-31"), (followees, "2024-01-31")):
        jobs.embed_followee_posts(spark, root, ids, sink, "2024-01-01", last, encoding.hash_encoder(4), n)
    done = snapshots.read(spark, sink)
    return done.groupBy(F.col("ds").cast("string").alias("ds"), "user_id_bucket").agg(F.count("*").alias("n_posts"), F.sum("id").alias("id_sum"))


class Crashed(Exception):
    """Stands for a writer that dies."""


def snapshot_crash(spark, sf_dir):
    """Sums by day as readers see them: before a correction, after it died with all its rows written, and after its rerun."""
    table = run_folder(spark, "snapshots")
    posts = readers.flat_posts(td.stream_posts(spark, sf_dir), "text", "ds")
    moved = posts.withColumn("id", F.col("id") + 1_000_000).filter("ds <> '2024-01-12'")
    in_range = F.col("ds").between("2024-01-10", "2024-01-19")

    def seen(moment: str) -> DataFrame:
        sums = snapshots.read(spark, table).groupBy("ds").agg(F.count("*").alias("n_posts"), F.sum("id").alias("id_sum"))
        return sums.withColumn("moment", F.lit(moment))

    def die(_):
        raise Crashed

    snapshots.append(posts, table, ("ds",))
    before = seen("before")
    try:
        snapshots.stage(moved.filter(in_range), table, ("ds",))
        snapshots.publish(spark, table, die)
    except Crashed:
        pass
    crashed = seen("crashed")
    snapshots.replace_where(moved, table, ("ds",), in_range)
    return summaries.union_all(summaries.union_all(before, crashed), seen("rerun"))


def _day_sums(done: DataFrame) -> DataFrame:
    return done.groupBy(F.col("ds").cast("string").alias("ds")).agg(
        F.count("*").alias("n_posts"),
        F.sum("id").alias("id_sum"),
        F.round(F.sum(F.element_at("embed", 1)), 4).alias("first_value_sum"),
    )


def work_calendar_gaps(spark, sf_dir):
    done = td.table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").cast("string").alias("ds"), user_bucket(F.col("user_id")).alias("user_id_bucket")
    )
    return incremental.missing_units(incremental.work_units(spark, *CALENDAR), done)


# Predictions


def decode_predictions(spark, sf_dir):
    decoded = evaluation.decode_predictions(td.predictions(spark, sf_dir))
    return decoded.select("id", "pred_gender", "pred_age_range", "min_age", "max_age")


def exact_age(spark, sf_dir):
    panel = td.panel_sample(spark, sf_dir)
    return panel.select("user_id", age_on(F.col("birth_date"), _date(AGE_TODAY)).alias("real_age"))


def _sample_with_age(spark, sf_dir) -> DataFrame:
    return evaluation.with_real_age(td.panel_sample(spark, sf_dir), _date(AGE_TODAY))


def _decoded(spark, sf_dir) -> DataFrame:
    return evaluation.decode_predictions(td.predictions(spark, sf_dir))


def panel_with_predictions(spark, sf_dir):
    joined = evaluation.join_predictions(_sample_with_age(spark, sf_dir), "user_id", _decoded(spark, sf_dir))
    return joined.select("user_id", "sex", "real_age", "pred_gender", "pred_age_range", "min_age", "max_age")


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumns({c: F.round(c, 6) for c in scores.columns if c.endswith("_accuracy")})


def panel_accuracy(spark, sf_dir):
    panel = _sample_with_age(spark, sf_dir)
    return _rounded(evaluation.score_panel(panel, "user_id", "sex", "real_age", _decoded(spark, sf_dir)))


def panel5k_accuracy(spark, sf_dir):
    panel = td.panel_5k(spark, sf_dir)
    return _rounded(evaluation.score_panel(panel, "panel_uid", "gender", "age", _decoded(spark, sf_dir)))


def annotation_filter(spark, sf_dir):
    return evaluation.annotated(td.annotations(spark, sf_dir))


def _agreement(spark, sf_dir, null_bin=None) -> DataFrame:
    return evaluation.annotation_agreement(
        td.annotations(spark, sf_dir), td.panel_sample(spark, sf_dir), _date(ANNOTATED_ON), null_bin,
        decoded=_decoded(spark, sf_dir),
    )


def annotation_agreement(spark, sf_dir):
    return _agreement(spark, sf_dir).select("user_id", "age_1", "age_2", "annot_goodness")


def annotation_agreement_old_bin(spark, sf_dir):
    return _agreement(spark, sf_dir, "age_>=40").select("user_id", "age_1", "age_2", "annot_goodness")


def agreement_counts(spark, sf_dir):
    return summaries.value_counts(_agreement(spark, sf_dir), "annot_goodness")


def agreed_accuracy(spark, sf_dir):
    return _rounded(
        evaluation.score_agreed(
            td.annotations(spark, sf_dir),
            _sample_with_age(spark, sf_dir),
            _decoded(spark, sf_dir),
            _date(ANNOTATED_ON),
        )
    )


def default_image_flag(spark, sf_dir):
    profiles = td.user_profiles(spark, sf_dir)
    return profiles.select("uid", is_default_image(F.col("profile_image_url_https")).alias("default_profile_image"))


def toy_model():
    """A stand-in for a demographic model: scores from the id and the lengths of name and description."""

    def load():
        def infer(users: pd.DataFrame) -> pd.DataFrame:
            uid = users["id_str"].astype("int64")
            name = users["name"].fillna("").str.len()
            text = users["description"].fillna("").str.len()
            image = users["default_profile_image"].astype("int64")
            male = ((uid * 13 + name) % 101).astype("float64")
            return pd.DataFrame(
                {
                    "id": users["id_str"],
                    "age_<=18": ((uid * 7 + text) % 11).astype("float64"),
                    "age_19-29": ((uid * 5 + name) % 13).astype("float64"),
                    "age_30-39": ((uid * 3 + image) % 17).astype("float64"),
                    "age_>=40": ((uid * 2) % 19).astype("float64"),
                    "gender_male": male,
                    "gender_female": 100.0 - male,
                }
            )

        return infer

    return load


def _predicted(spark, sf_dir) -> DataFrame:
    users = inference.model_input(td.user_profiles(spark, sf_dir))
    n = spark.sparkContext.defaultParallelism
    return inference.predict(users, toy_model(), schemas.PREDICTIONS, batch_rows=1000, n_partitions=n)


def predict_table(spark, sf_dir):
    return evaluation.decode_predictions(_predicted(spark, sf_dir))


def union_results(spark, sf_dir):
    """Results of two runs over overlapping people, one below the other."""
    panel = _decoded(spark, sf_dir).join(
        td.panel_5k(spark, sf_dir).select(F.col("panel_uid").alias("id")), "id", "left_semi"
    )
    sample = _decoded(spark, sf_dir).join(
        td.panel_sample(spark, sf_dir).select(F.col("user_id").alias("id")), "id", "left_semi"
    )
    return summaries.union_all(panel, sample).select("id", "pred_gender", "pred_age_range")


# Stored API responses


def api_outcomes(spark, sf_dir):
    return responses.response_outcomes(td.follow_responses(spark, sf_dir))


def api_outcome_counts(spark, sf_dir):
    return summaries.counts_by(api_outcomes(spark, sf_dir), "outcome")


def api_errors_first(spark, sf_dir):
    return responses.first_errors(td.follow_responses(spark, sf_dir))


def api_errors_all(spark, sf_dir):
    return responses.all_errors(td.user_responses(spark, sf_dir))


def api_users(spark, sf_dir):
    users = responses.users_from_responses(td.user_responses(spark, sf_dir))
    return users.select(
        "id",
        "username",
        "name",
        "description",
        "created_at",
        "location",
        "protected",
        "verified",
        "public_metrics.followers_count",
        "public_metrics.following_count",
        "public_metrics.tweet_count",
        "public_metrics.listed_count",
        "profile_image_url",
        "url",
        F.array_join("withheld.country_codes", ",").alias("withheld_in"),
        F.col("withheld.scope").alias("withheld_scope"),
    )


def follow_edges(spark, sf_dir):
    return responses.follow_edges(td.follow_responses(spark, sf_dir))


def api_next_tokens(spark, sf_dir):
    return responses.next_tokens(td.follow_responses(spark, sf_dir))


def api_pages_edges(spark, sf_dir):
    return responses.edges_over_pages(td.paged_responses(spark, sf_dir))


def api_pages_complete(spark, sf_dir):
    return responses.page_status(td.paged_responses(spark, sf_dir))


def api_page_chains(spark, sf_dir):
    return responses.page_chains(td.chained_responses(spark, sf_dir))


def api_posts(spark, sf_dir):
    posts = responses.posts_from_responses(td.post_responses(spark, sf_dir))
    return posts.select(
        "user_id",
        "id",
        "text",
        "created_at",
        "conversation_id",
        "in_reply_to_user_id",
        "lang",
        "public_metrics.reply_count",
        "public_metrics.like_count",
        "public_metrics.retweet_count",
        "public_metrics.quote_count",
    )


def routed_outcomes(spark, sf_dir):
    path = run_folder(spark, "routed")
    writers.write_json(responses.routed(td.follow_responses(spark, sf_dir)), path, partition_by=("outcome",))
    return spark.read.schema("outcome STRING, user_id BIGINT, followee_id BIGINT, detail STRING").json(path)


def _id_file(spark, sf_dir) -> DataFrame:
    path = run_folder(spark, "ids")
    writers.write_id_lines(td.table(spark, sf_dir, "customer"), path, "c_custkey")
    return readers.read_id_lines(spark, path)


def rejected_id_lines(spark, sf_dir):
    """Lines of an id list that hold no number."""
    path = run_folder(spark, "bad-ids")
    c = F.col("c_custkey")
    line = F.when(c % 50 == 0, F.concat(F.lit("n/a "), c)).when(c % 50 == 1, "").otherwise(c.cast("string"))
    writers.write_id_lines(td.table(spark, sf_dir, "customer").select(line.alias("line")), path, "line")
    return readers.rejected_id_lines(spark, path).select("line")


def resume_ids(spark, sf_dir):
    """Listed customers without a finished order yet."""
    done = td.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey")
    return joins.not_done(_id_file(spark, sf_dir), "user_id", done).select("user_id")


def id_batches_100(spark, sf_dir):
    ids = td.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return batching.id_batches(ids, "user_id")


# Files


def json_by_day_round_trip(spark, sf_dir):
    path = run_folder(spark, "matched")
    writers.write_json(matched_bios(spark, sf_dir), path, partition_by=("ds",))
    return readers.read_json(spark, path, schemas.MATCHED_BIOS)


def labels_json_round_trip(spark, sf_dir):
    path = run_folder(spark, "labeled")
    writers.write_json(labeled_bios(spark, sf_dir), path)
    return readers.read_json(spark, path, schemas.LABELED_BIOS)


def posts_json_scan(spark, sf_dir):
    path = run_folder(spark, "posts")
    writers.write_json(td.stream_posts(spark, sf_dir), path, partition_by=("ds",), compression=None)
    return readers.flat_posts(readers.between_days(readers.read_posts(spark, path), "2023-12-31", "2024-01-31"), "text", "ds")


def panel_partition_scan(spark, sf_dir):
    """Every partition of the panel posts, and one of them read on its own."""
    path = run_folder(spark, "panel-posts")
    writers.write_json(td.panel_posts(spark, sf_dir), path, partition_by=("created_at_bucket", "user_id_bucket"), compression=None)
    everything = readers.read_panel_posts(spark, path)
    one = readers.read_panel_posts(spark, path, "2024-01-16", 7)
    columns = ["created_at_bucket", "user_id_bucket"]
    return summaries.union_all(
        summaries.counts_by(everything, *columns).withColumn("scan", F.lit("all")),
        summaries.counts_by(one, *columns).withColumn("scan", F.lit("one")),
    )


def raw_posts_any_format(spark, sf_dir):
    """Documents of the first days as JSON lines, the others as headerless TSV, all read from one folder."""
    path = run_folder(spark, "raw-posts")
    posts = td.document_posts(spark, sf_dir)
    writers.write_json(posts.filter("ds <= '2024-01-15'").drop("ds"), path, compression=None)
    late = posts.filter("ds > '2024-01-15'").drop("ds")
    writers.export_table(late, path, mode="append", header=False, compression=None)
    return readers.read_raw_posts(spark, path)


def _landed_lines(spark, sf_dir, kind: str) -> tuple[str, DataFrame]:
    """Source folder and landed table of lines of which some are broken."""
    source = run_folder(spark, f"lines-{kind}")
    td.broken_lines(spark, sf_dir, kind).write.text(source)
    if kind == "json":
        tagged = readers.read_json(spark, source, schemas.RAW_POSTS, tagged=True, required=("id",))
    else:
        tagged = readers.read_table(spark, source, schemas.RAW_POSTS, header=False, breaks="escaped", tagged=True, required=("id",))
    return source, rejects.land(tagged, run_folder(spark, f"landed-{kind}"))


def _data_and_rejects(spark, sf_dir, kind: str) -> DataFrame:
    _, landed = _landed_lines(spark, sf_dir, kind)
    lines = rejects.rejects_of(landed).select(F.col("_reason").alias("reason"), F.col("_line").alias("text"))
    return rejects.data_of(landed).unionByName(lines, allowMissingColumns=True)


def json_rejects(spark, sf_dir):
    """Good and broken JSON lines: the posts, and below them each reject with its reason."""
    return _data_and_rejects(spark, sf_dir, "json")


def tsv_rejects(spark, sf_dir):
    return _data_and_rejects(spark, sf_dir, "tsv")


def reject_accounts(spark, sf_dir):
    """Lines in, rows and rejects out, for both formats."""

    def totals(kind: str) -> DataFrame:
        source, landed = _landed_lines(spark, sf_dir, kind)
        sums = [F.sum(c).alias(c) for c in ("n_lines", "n_rows", "n_rejects")]
        return rejects.account(landed, source).agg(*sums, F.bool_and("adds_up").alias("adds_up")).withColumn("format", F.lit(kind))

    return summaries.union_all(totals("json"), totals("tsv"))


def bios_tsv_round_trip(spark, sf_dir):
    """Profile texts with tabs, quotes, line breaks and backslashes through TSV, with breaks in quotes and escaped."""
    bio = F.concat(F.coalesce("description", F.lit("none")), F.lit('\t"'), F.col("uid"), F.lit('"\r\n\\n '))
    profiles = td.user_profiles(spark, sf_dir).select("uid", bio.alias("description"))

    def back(breaks: str) -> DataFrame:
        path = run_folder(spark, f"bios-{breaks}")
        writers.export_table(profiles, path, compression=None, breaks=breaks)
        return readers.read_table(spark, path, "uid STRING, description STRING", breaks=breaks).withColumn("breaks", F.lit(breaks))

    return summaries.union_all(back("quoted"), back("escaped"))


def replaced_days(spark, sf_dir):
    """The matching job over all days, and again over ten days after a correction that emptied all profile texts of two."""
    first, second, matched = (run_folder(spark, name) for name in ("landed", "corrected", "matched"))
    posts = td.stream_posts(spark, sf_dir)
    emptied = F.when(~F.col("ds").isin("2024-01-12", "2024-01-16"), F.col("user.description"))
    writers.write_json(posts, first, partition_by=("ds",), compression=None)
    writers.write_json(posts.withColumn("user", F.col("user").withField("description", emptied)), second, partition_by=("ds",), compression=None)
    jobs.match_bios(spark, first, matched, "2023-12-31", "2024-01-31")
    jobs.match_bios(spark, second, matched, "2024-01-09", "2024-01-19")
    return snapshots.read(spark, matched)


def embedding_csv_export(spark, sf_dir):
    path = run_folder(spark, "vectors")
    posts = encoding.spread(td.document_posts(spark, sf_dir), spark.sparkContext.defaultParallelism)
    vectors = hash_embed(posts, "text").select("id", "user_id", "embed")
    writers.export_vectors(vectors, path)
    return _long_form(readers.read_vectors(spark, path), "id", "user_id")


def predictions_csv_round_trip(spark, sf_dir):
    path = run_folder(spark, "predictions")
    writers.export_table(td.predictions(spark, sf_dir), path, sep=",", compression=None)
    return readers.read_table(spark, path, schemas.PREDICTIONS, sep=",")


def profiles_to_json_lines(spark, sf_dir):
    """User profiles as TSV with a header, turned into the model's JSON lines."""
    tsv, lines = run_folder(spark, "profiles"), run_folder(spark, "model-input")
    writers.export_table(td.user_profiles(spark, sf_dir), tsv, compression=None)
    users = inference.model_input(readers.read_table(spark, tsv, schemas.USER_PROFILES))
    writers.write_json(users, lines, compression=None)
    return readers.read_json(spark, lines, schemas.MODEL_INPUT)


def stream_bio_labels(spark, sf_dir):
    """Posts land as JSON files and the stream labels them."""
    landing, sink = run_folder(spark, "landing"), run_folder(spark, "stream-labels")
    writers.write_json(td.stream_posts(spark, sf_dir), landing, partition_by=("ds",), compression=None)
    labels = streaming_labels.label_stream(streaming_labels.arriving_posts(spark, landing))
    streaming_labels.write_labels(labels, sink, run_folder(spark, "stream-checkpoint")).awaitTermination()
    return readers.read_parquet(spark, sink).withColumn("ds", F.col("ds").cast("string"))


def stream_distinct_bios(spark, sf_dir):
    """Posts land three times, each time with days that were there before; every profile is labelled once."""
    landing, sink, checkpoint = (run_folder(spark, name) for name in ("landing", "stream-distinct", "stream-checkpoint"))
    posts = td.stream_posts(spark, sf_dir)
    for first, last in (("2024-01-01", "2024-01-12"), ("2024-01-08", "2024-01-20"), ("2024-01-15", "2024-01-31")):
        writers.write_json(posts.filter(F.col("ds").between(first, last)), landing, partition_by=("ds",), compression=None)
        once = streaming_labels.distinct_bio_stream(streaming_labels.arriving_posts(spark, landing))
        streaming_labels.write_labels(once, sink, checkpoint).awaitTermination()
    return readers.read_parquet(spark, sink).drop("ds")


QUERIES: dict[str, Query] = {
    "bio_match_any": matched_bios,
    "posts_day_range": posts_day_range,
    "posts_on_day": posts_on_day,
    "bio_distinct": bio_distinct,
    "bio_distinct_counts": bio_distinct_counts,
    "bio_labels_intended": labeled_bios,
    "bio_labels_literal": bio_labels_literal,
    "gender_pattern_counts_female": gender_pattern_counts_female,
    "gender_pattern_counts_male": gender_pattern_counts_male,
    "female_pattern_7_bios": female_pattern_7_bios,
    "age_pattern_counts": age_pattern_counts,
    "age_label_counts_sorted": age_label_counts_sorted,
    "age_label_preview": age_label_preview,
    "age_groups": age_groups,
    "age_groups_sql": age_groups_sql,
    "age_group_counts": age_group_counts,
    "age_gender_overlap": age_gender_overlap,
    "age_gender_cross_table": age_gender_cross_table,
    "validation_age_export": validation_age_export,
    "validation_gender_export": validation_gender_export,
    "id_bucket_filter": id_bucket_filter,
    "posts_for_followees": posts_for_followees,
    "posts_for_panel": posts_for_panel,
    "post_embeddings": post_embeddings,
    "panel_embeddings": panel_embeddings,
    "embed_batches_udf": embed_batches_udf,
    "embed_increment": embed_increment,
    "embed_increment_by_id": embed_increment_by_id,
    "work_calendar_gaps": work_calendar_gaps,
    "decode_predictions": decode_predictions,
    "exact_age": exact_age,
    "panel_with_predictions": panel_with_predictions,
    "panel_accuracy": panel_accuracy,
    "panel5k_accuracy": panel5k_accuracy,
    "annotation_filter": annotation_filter,
    "embed_bucket_halves": embed_bucket_halves,
    "embed_grown_id_list": embed_grown_id_list,
    "rejected_id_lines": rejected_id_lines,
    "embed_followee_job": embed_followee_job,
    "snapshot_crash": snapshot_crash,
    "annotation_agreement": annotation_agreement,
    "annotation_agreement_old_bin": annotation_agreement_old_bin,
    "agreement_counts": agreement_counts,
    "agreed_accuracy": agreed_accuracy,
    "default_image_flag": default_image_flag,
    "predict_table": predict_table,
    "union_results": union_results,
    "api_outcomes": api_outcomes,
    "api_outcome_counts": api_outcome_counts,
    "api_errors_first": api_errors_first,
    "api_errors_all": api_errors_all,
    "api_users": api_users,
    "follow_edges": follow_edges,
    "api_next_tokens": api_next_tokens,
    "api_pages_edges": api_pages_edges,
    "api_pages_complete": api_pages_complete,
    "api_posts": api_posts,
    "routed_outcomes": routed_outcomes,
    "resume_ids": resume_ids,
    "id_batches_100": id_batches_100,
    "json_by_day_round_trip": json_by_day_round_trip,
    "labels_json_round_trip": labels_json_round_trip,
    "posts_json_scan": posts_json_scan,
    "panel_partition_scan": panel_partition_scan,
    "raw_posts_any_format": raw_posts_any_format,
    "json_rejects": json_rejects,
    "tsv_rejects": tsv_rejects,
    "reject_accounts": reject_accounts,
    "bios_tsv_round_trip": bios_tsv_round_trip,
    "replaced_days": replaced_days,
    "embedding_csv_export": embedding_csv_export,
    "predictions_csv_round_trip": predictions_csv_round_trip,
    "profiles_to_json_lines": profiles_to_json_lines,
    "stream_bio_labels": stream_bio_labels,
    "stream_distinct_bios": stream_distinct_bios,
    "embed_token_budget": embed_token_budget,
    "embed_shipped_model": embed_shipped_model,
    "api_page_chains": api_page_chains,
}
