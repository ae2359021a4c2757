"""Whole jobs from files to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelforge import schemas
from panelforge.functions.demographics import user_bucket
from panelforge.operators import encoding, evaluation, inference, joins, labeling, packing, responses
from panelforge.plans import incremental
from panelforge.rules import INTENDED, RuleSet
from panelforge.session import parked
from panelforge.sources import readers, snapshots, writers

EncoderFactory = Callable[[], encoding.Encoder]


def match_bios(
    spark: SparkSession, posts_root: str, matched: str, after: str, upto: str, rules: RuleSet = INTENDED
) -> None:
    """Authors of posts in a range of days whose profile text matches a rule, as day-partitioned JSON.

    ``matched`` is a snapshot table. The days of the range are replaced in one step, so that a rerun does not double them;
    a day without matches any more goes.
    """
    posts = readers.between_days(readers.read_posts(spark, posts_root), after, upto)
    bios = labeling.match_any(labeling.profile_of_author(posts), "user_bio", rules.first_stage())
    in_range = (F.col("ds") > after) & (F.col("ds") <= upto)
    snapshots.replace_where(bios, matched, ("ds",), in_range, "json")


def label_matched(spark: SparkSession, matched: str, labeled: str, rules: RuleSet = INTENDED, mode: str = "overwrite"):
    """Distinct matched profile texts with their labels, as JSON."""
    bios = labeling.distinct_bios(snapshots.read(spark, matched))
    writers.write_json(labeling.label_bios(bios, rules), labeled, mode)


def export_validation_sets(
    spark: SparkSession, labeled: str, age_out: str, gender_out: str, seed: int = 0, single_file: bool = False
) -> None:
    """Age and gender validation sets in random order, as TSV with a header."""
    labels = readers.read_json(spark, labeled, schemas.LABELED_BIOS)
    writers.export_table(labeling.validation_age(labels, seed=seed), age_out, mode="overwrite", single_file=single_file)
    writers.export_table(labeling.validation_gender(labels, seed=seed), gender_out, single_file=single_file)


def embed_followee_posts(
    spark: SparkSession,
    posts_root: str,
    followees: DataFrame,
    sink: str,
    first: str,
    last: str,
    load_encoder: EncoderFactory,
    n_partitions: int = 120,
    buckets: tuple[int, int] = (0, 39),
    batch_rows: int = encoding.BATCH_ROWS,
) -> list[str]:
    """Vectors of the listed users' posts for the days and buckets not yet done; returns those days.

    The sink is a snapshot table by day and bucket. Posts of users who joined the list later are added to the units that
    are finished, also outside the range; this looks at posts only if the list has changed. Kept posts are written once,
    counted by unit and packed into even tasks, in which copies collapse without another shuffle.
    """
    posts = readers.read_posts(spark, posts_root)
    (key,) = followees.columns

    def flat(of_units: DataFrame) -> DataFrame:
        return readers.flat_posts(of_units, "text", *incremental.UNIT)

    def embedded(kept: DataFrame) -> DataFrame:
        return _packed_vectors(joins.without_busy_copies(parked(kept, "kept-posts")), "text", incremental.UNIT, n_partitions, load_encoder, batch_rows)

    done = incremental.finished_units(snapshots.current(spark, sink))
    late = incremental.late_ids(spark, sink, followees)
    marks = [late[1]] if late else []
    if late and done and not late[0].isEmpty():
        kept = joins.match_ids(flat(incremental.of_units(posts, done, "user.id")), "user_id", late[0], "left_semi")
        there = joins.match_ids(snapshots.read(spark, sink), "user_id", late[0], "left_semi").select("id")
        snapshots.append(embedded(joins.not_done(kept, "id", there)), sink, incremental.UNIT, marks=marks)
        marks = []

    def encode(of_units: DataFrame) -> DataFrame:
        return embedded(joins.match_ids(flat(of_units), "user_id", followees.select(key), "left_semi"))

    days = incremental.embed_days(posts, sink, first, last, encode, buckets, "user.id", marks)
    if marks and not days:
        snapshots.add_marks(spark, sink, marks)
    return days


def _packed_vectors(kept: DataFrame, text: str, units: tuple[str, ...], n_partitions: int, load_encoder: EncoderFactory, batch_rows: int) -> DataFrame:
    """Vectors of stored posts from even tasks that hold whole units, or even pieces of large ones; copies count once."""
    once = joins.distinct_posts(packing.packed(kept, units, n_partitions), text).drop(packing.TASK)
    return encoding.embed(once, text, load_encoder, batch_rows)


def embed_panel_posts(
    spark: SparkSession,
    posts_root: str,
    panel: DataFrame,
    sink: str,
    created_at_bucket: str,
    load_encoder: EncoderFactory,
    n_partitions: int = 60,
    batch_rows: int = encoding.BATCH_ROWS,
) -> None:
    """Vectors of the panel's posts of one half-month, all user buckets in one job, text kept.

    The sink is a snapshot table by half-month and user bucket, and the half-month's partitions are replaced in one step,
    also those of buckets without posts any more.
    """
    posts = readers.read_panel_posts(spark, posts_root, created_at_bucket)
    flat = readers.flat_posts(posts, "full_text", "created_at_bucket", "user_id_bucket")
    kept = parked(joins.posts_of_panel(flat, panel), "panel-posts")
    placed = packing.packed(kept, ("user_id_bucket",), n_partitions).drop(packing.TASK)
    vectors = encoding.embed(placed, "full_text", load_encoder, batch_rows, drop_text=False)
    in_half = F.col("created_at_bucket") == created_at_bucket
    snapshots.replace_where(vectors, sink, ("created_at_bucket", "user_id_bucket"), in_half)


def embed_files(spark: SparkSession, posts: str, out: str, load_encoder: EncoderFactory, n_partitions: int | None = None):
    """Vectors of every post in a file or folder, as headerless ``id, user_id, [a, b, ...]`` rows."""
    vectors = encoding.embed(readers.read_raw_posts(spark, posts), "text", load_encoder, 32, n_partitions)
    writers.export_vectors(vectors, out, mode="overwrite")


def predict_profiles(
    spark: SparkSession,
    profiles_tsv: str,
    out: str,
    load_model: Callable[[], inference.Model],
    batch_rows: int = inference.BATCH_ROWS,
    n_partitions: int | None = None,
) -> None:
    """Model predictions for a TSV of user profiles, as CSV with a header."""
    users = inference.model_input(readers.read_table(spark, profiles_tsv, schemas.USER_PROFILES))
    predictions = inference.predict(users, load_model, schemas.PREDICTIONS, batch_rows, n_partitions)
    writers.export_table(predictions, out, sep=",", mode="overwrite", compression=None)


def evaluate_panel(
    spark: SparkSession, panel_csv: str, annotations_tsv: str, predictions_csv: str, today: Column, annotated_on: Column
) -> DataFrame:
    """Scores of all panel members, and of those on whom the annotators and the truth agree, one row each."""
    panel = readers.read_table(spark, panel_csv, schemas.PANEL_SAMPLE, sep=",")
    panel = evaluation.with_real_age(panel, today)
    annotations = readers.read_table(spark, annotations_tsv, schemas.ANNOTATIONS)
    decoded = evaluation.decode_predictions(readers.read_table(spark, predictions_csv, schemas.PREDICTIONS, sep=","))
    everyone = evaluation.score_panel(panel, "user_id", "sex", "real_age", decoded)
    agreed = evaluation.score_agreed(annotations, panel, decoded, annotated_on)
    all_people = F.lit("all").alias("people")
    return everyone.select(all_people, F.col("joined_rows").alias("n"), "gender_accuracy", "age_accuracy").unionByName(
        agreed.select(F.lit("agreed").alias("people"), F.col("agreed_rows").alias("n"), "age_accuracy"),
        allowMissingColumns=True,
    )


def collect_follow_responses(stored: DataFrame, out: str) -> None:
    """Edges, errors, empty and unknown responses, each in its own folder."""
    writers.write_json(responses.routed(stored), out, "overwrite", ("outcome",), None)


def collect_user_responses(stored: DataFrame, users_out: str, errors_out: str) -> None:
    """User records as JSON lines, and every listed error."""
    writers.write_json(responses.users_from_responses(stored), users_out, "overwrite", compression=None)
    writers.export_table(
        responses.all_errors(stored), errors_out, sep=",", mode="overwrite", header=False, compression=None
    )


def missing_work(spark: SparkSession, sink: str, first: str, last: str) -> DataFrame:
    """Calendar cells (day, user bucket) without any stored vector."""
    done = snapshots.read(spark, sink).select(
        F.col("ds").cast("string").alias("ds"), user_bucket(F.col("user_id")).alias("user_id_bucket")
    )
    return incremental.missing_units(incremental.work_units(spark, first, last), done)
