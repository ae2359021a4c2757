"""The labelling job on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge import schemas
from panelforge.operators.labeling import label_bios, match_any, profile_of_author
from panelforge.rules import INTENDED, RuleSet


def arriving_posts(
    spark: SparkSession, root: str, schema: str = schemas.STREAM_POSTS, files_per_batch: int = 10_000
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(root)


def label_stream(posts: DataFrame, rules: RuleSet = INTENDED) -> DataFrame:
    """Matching authors of each post with their labels. Row by row, so no state and no watermark."""
    return label_bios(match_any(profile_of_author(posts), "user_bio", rules.first_stage()), rules)


def distinct_bio_stream(posts: DataFrame, horizon: str = "60 days", rules: RuleSet = INTENDED) -> DataFrame:
    """Matching authors with their labels, each profile text once, however many posts and micro-batches show it.

    The state holds the keys (text, user, name) seen within ``horizon`` of the newest day and forgets older ones, so that
    it grows with the profiles of that time and not with the posts. A profile that shows up again after that, or a post
    older than that, is outside the promise: choose the horizon as long as repeats matter. ``ds`` is a day on which the
    profile was first seen.
    """
    bios = match_any(profile_of_author(posts), "user_bio", rules.first_stage())
    timed = bios.withColumn("seen_at", F.to_timestamp("ds", "yyyy-MM-dd")).withWatermark("seen_at", horizon)
    once = timed.dropDuplicatesWithinWatermark(["user_bio", "user_id", "user_screen_name"])
    return label_bios(once.drop("seen_at"), rules)


def write_labels(labels: DataFrame, sink: str, checkpoint: str, keep_running: bool = False) -> StreamingQuery:
    """Append to a day-partitioned table; the checkpoint makes each input file count once across restarts."""
    writer = (
        labels.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .partitionBy("ds")
        .outputMode("append")
    )
    return (writer if keep_running else writer.trigger(availableNow=True)).start()
