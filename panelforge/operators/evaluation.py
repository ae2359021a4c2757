"""Decode predictions, join them to truth, and score them.

Scores never need the joined rows. Each side is first reduced to a few counters per user, inside the map tasks
where possible; the counters of a user are then multiplied. That equals scoring every joined pair, without making
the pairs, and a user with a third of all rows costs one counter row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.demographics import (
    age_bin,
    age_on,
    annotators_agree,
    best_age_range,
    likelier_gender,
    range_high,
    range_low,
)
from panelforge.operators.joins import MAX_BROADCAST_IDS, fits_broadcast, join_rows, match_ids
from panelforge.rules import AGE_SCORES, GENDER_SCORES

MAX_BROADCAST_PANEL = 1_000_000
RANGES = [label for _, label in AGE_SCORES]
GENDERS = [label for _, label in GENDER_SCORES]


def decode_predictions(predictions: DataFrame) -> DataFrame:
    """Add the predicted gender, age range and its ends; the id becomes a number."""
    return predictions.withColumns(
        {"id": F.col("id").cast("bigint"), "pred_gender": likelier_gender(), "pred_age_range": best_age_range()}
    ).withColumns({"min_age": range_low(F.col("pred_age_range")), "max_age": range_high(F.col("pred_age_range"))})


def with_real_age(panel: DataFrame, as_of: Column) -> DataFrame:
    return panel.withColumn("real_age", age_on(F.col("birth_date"), as_of))


def join_predictions(panel: DataFrame, key: str, decoded: DataFrame, max_broadcast: int = MAX_BROADCAST_PANEL):
    """Panel rows with their decoded prediction, for inspection."""
    return join_rows(decoded, panel, "id", key, max_broadcast)


def age_misses(age: Column, low: Column, high: Column) -> Column:
    """Outside the predicted range. A missing age is no miss."""
    return F.coalesce((low > age) | (high < age), F.lit(False))


def _range_ends(label: str) -> tuple[int, int]:
    low, high = label.split("-")
    return int(low), int(high)


def _in_range(age: Column, label: str) -> Column:
    low, high = _range_ends(label)
    return ~age_misses(age, F.lit(low), F.lit(high))


def _prediction_counters() -> list[Column]:
    return (
        [F.count("*").alias("m")]
        + [F.count_if(F.col("pred_gender") == g).alias(f"m_{g}") for g in GENDERS]
        + [F.count_if(F.col("pred_age_range") == r).alias(f"m_{r}") for r in RANGES]
    )


def _products(pairs: list[tuple[str, str]]) -> Column:
    first, *rest = [F.col(f"`{a}`") * F.col(f"`{b}`") for a, b in pairs]
    for product in rest:
        first = first + product
    return first


def _match_counters(truth: DataFrame, key: str, decoded: DataFrame, small: bool) -> DataFrame:
    """Counters of both sides side by side: per user, or per prediction if the truth is small.

    ``truth`` has at most one row per panel row, so the checked size of the panel bounds the broadcast.
    """
    if small:
        # The predictions stay where they are: each row is its own counter.
        per_row = decoded.select(
            "id",
            F.lit(1).cast("bigint").alias("m"),
            *[(F.col("pred_gender") == g).cast("bigint").alias(f"m_{g}") for g in GENDERS],
            *[(F.col("pred_age_range") == r).cast("bigint").alias(f"m_{r}") for r in RANGES],
        )
        return per_row.join(F.broadcast(truth), F.col("id") == F.col(key))
    per_user = decoded.groupBy("id").agg(*_prediction_counters())
    return per_user.join(truth, F.col("id") == F.col(key))


def score_panel(
    panel: DataFrame, key: str, gender: str, age: str, decoded: DataFrame, max_broadcast: int = MAX_BROADCAST_PANEL
) -> DataFrame:
    """One row: joined rows, gender accuracy (missing truth misses), age-range accuracy (missing age hits).

    An empty join gives NULL accuracies.
    """
    small = fits_broadcast(panel.select(key, gender, age), max_broadcast)
    truth = panel.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(gender) == g).alias(f"n_{g}") for g in GENDERS],
        *[F.count_if(_in_range(F.col(age), r)).alias(f"n_{r}") for r in RANGES],
    )
    matched = _match_counters(truth, "__key", decoded, small)
    rows = F.sum(_products([("n", "m")]))
    return matched.agg(
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("joined_rows"),
        (F.sum(_products([(f"n_{g}", f"m_{g}") for g in GENDERS])).cast("double") / rows).alias("gender_accuracy"),
        (F.sum(_products([(f"n_{r}", f"m_{r}") for r in RANGES])).cast("double") / rows).alias("age_accuracy"),
    )


def annotated(annotations: DataFrame) -> DataFrame:
    """Annotations in which at least one annotator named a gender."""
    return annotations.filter(F.coalesce("gender_1", "gender_2").isNotNull())


def annotation_agreement(
    annotations: DataFrame,
    panel: DataFrame,
    as_of: Column,
    null_bin: str | None = None,
    max_broadcast: int = MAX_BROADCAST_PANEL,
    decoded: DataFrame | None = None,
) -> DataFrame:
    """Annotated panel rows, of users in ``decoded`` predictions if given, with the flag that both annotators and the age at ``as_of`` share one bin.

    ``null_bin='age_>=40'`` counts a missing age as the oldest bin, which is how the rule was first run.
    """
    truth = panel.withColumnRenamed("user_id", "__panel_id")
    joined = join_rows(annotated(annotations), truth, "user_id", "__panel_id", max_broadcast)
    if decoded is not None:
        # Only ids of the predictions, and after the panel's size was checked on the panel alone.
        joined = match_ids(joined, "user_id", decoded.select("id"), "left_semi", max(max_broadcast, MAX_BROADCAST_IDS))
    true_age = age_on(F.col("birth_date"), as_of)
    flag = annotators_agree(F.col("age_1"), F.col("age_2"), true_age, null_bin)
    return joined.drop("__panel_id").withColumn("annot_goodness", flag)


def score_agreed(
    annotations: DataFrame,
    panel: DataFrame,
    decoded: DataFrame,
    agreed_on: Column,
    null_bin: str | None = None,
    max_broadcast: int = MAX_BROADCAST_PANEL,
) -> DataFrame:
    """One row: agreed rows of annotations x panel x predictions, and the age accuracy on them.

    ``panel`` carries ``real_age``; the agreement looks at the age on ``agreed_on``.
    """
    small = fits_broadcast(panel, max_broadcast)
    first, second = age_bin(F.col("age_1"), null_bin), age_bin(F.col("age_2"), null_bin)
    votes = (
        annotated(annotations)
        .filter(first == second)
        .groupBy("user_id", first.alias("bin"))
        .agg(F.count("*").alias("a"))
    )
    then = age_bin(age_on(F.col("birth_date"), agreed_on), null_bin)
    truth = panel.groupBy("user_id", then.alias("bin")).agg(
        F.count("*").alias("n"),
        *[F.count_if(_in_range(F.col("real_age"), r)).alias(f"n_{r}") for r in RANGES],
    )
    agreed = votes.join(truth, ["user_id", "bin"])
    matched = _match_counters(agreed, "user_id", decoded, small)
    rows = F.sum(F.col("a") * F.col("n") * F.col("m"))
    hits = F.sum(F.col("a") * _products([(f"n_{r}", f"m_{r}") for r in RANGES]))
    return matched.agg(
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("agreed_rows"),
        (hits.cast("double") / rows).alias("age_accuracy"),
    )
