"""Find, dedupe and label profile texts that state an age or a gender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.functions.disclosure import age_group, by_position, captured, first_match, matches_any
from panelforge.functions.hashing import shuffle_key
from panelforge.rules import DEFAULT_REF_YEAR, INTENDED, UNLABELED_AGE, UNLABELED_GENDER, Rule, RuleSet


def profile_of_author(posts: DataFrame) -> DataFrame:
    """The author's fields of each post, flattened; the post text is not read."""
    return posts.select(
        F.col("user.id").alias("user_id"),
        F.col("user.screen_name").alias("user_screen_name"),
        F.col("user.description").alias("user_bio"),
        "ds",
    )


def match_any(df: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """Rows whose text matches at least one rule."""
    return df.filter(matches_any(F.col(column), rules))


def distinct_bios(bios: DataFrame) -> DataFrame:
    """One row per (bio, id, name). A user with two bios stays twice.

    Copies collapse inside each map task, so a profile seen in a third of all posts shuffles one row per task.
    """
    return bios.select("user_bio", "user_id", "user_screen_name").distinct()


def _computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as one generated row. Filters on them stay above it; filters on plain columns would be moved
    below and run every regex again, once per mention."""
    row = F.struct(*[expression.alias(name) for name, expression in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def label_ages(bios: DataFrame, rules: RuleSet = INTENDED) -> DataFrame:
    """Add the age pattern and the stated age."""
    bio, at = F.col("user_bio"), F.col("__age_at")
    return _computed_once(
        bios.withColumn("__age_at", first_match(bio, rules.age)),
        age_pattern=by_position(at, UNLABELED_AGE, [r.name for r in rules.age]),
        age_label=captured(bio, at, UNLABELED_AGE, rules.age),
    ).drop("__age_at")


def label_genders(bios: DataFrame, rules: RuleSet = INTENDED) -> DataFrame:
    """Add the gender pattern and the gender; both come from one pass over the rules."""
    at = F.col("__gender_at")
    return _computed_once(
        bios.withColumn("__gender_at", first_match(F.col("user_bio"), rules.gender)),
        gender_pattern=by_position(at, UNLABELED_GENDER, [r.name for r in rules.gender]),
        gender_label=by_position(at, UNLABELED_GENDER, [r.label for r in rules.gender]),
    ).drop("__gender_at")


def label_bios(bios: DataFrame, rules: RuleSet = INTENDED) -> DataFrame:
    """Add age pattern, stated age, gender pattern and gender."""
    return label_genders(label_ages(bios, rules), rules)


def with_age_group(labeled: DataFrame, ref_year: int = DEFAULT_REF_YEAR) -> DataFrame:
    """Add the age group and keep the rows that have one."""
    grouped = labeled.withColumn("age_group", age_group(F.col("age_label"), ref_year))
    return grouped.filter("age_group IS NOT NULL AND age_group <> 'unlabeled_age'")


def with_gender(labeled: DataFrame) -> DataFrame:
    return labeled.filter(F.col("gender_pattern") != UNLABELED_GENDER)


def _shuffled(labeled: DataFrame, seed: int, *columns: str) -> DataFrame:
    """Columns in a random order that repeats for the same seed. The key covers the whole bio: rows that look alike
    in the exported columns neither stay together nor fall into one sort partition."""
    key = shuffle_key("user_id", "user_screen_name", "user_bio", seed=seed)
    return labeled.withColumn("__key", key).orderBy("__key").select(*columns)


def validation_age(labeled: DataFrame, ref_year: int = DEFAULT_REF_YEAR, seed: int = 0) -> DataFrame:
    """Age validation set in random order."""
    return _shuffled(with_age_group(labeled, ref_year), seed, "user_id", "age_group", "age_label", "age_pattern")


def validation_gender(labeled: DataFrame, seed: int = 0) -> DataFrame:
    """Gender validation set in random order."""
    return _shuffled(with_gender(labeled), seed, "user_id", "gender_pattern", "gender_label")
