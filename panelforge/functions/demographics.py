"""Column expressions that decode predictions, ages and annotations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelforge.rules import AGE_BINS, AGE_SCORES, DEFAULT_PROFILE_IMAGE, GENDER_SCORES, USER_BUCKETS


def best_age_range(scores: list[Column] | None = None) -> Column:
    """Age range with the highest score; the first one wins a tie."""
    scores = scores or [F.col(f"`{name}`") for name, _ in AGE_SCORES]
    top = F.greatest(*scores)
    chain = F.when(scores[0] == top, AGE_SCORES[0][1])
    for score, (_, label) in zip(scores[1:], AGE_SCORES[1:]):
        chain = chain.when(score == top, label)
    return chain


def likelier_gender(male: Column | None = None, female: Column | None = None) -> Column:
    """Male unless the female score is higher."""
    male = F.col(GENDER_SCORES[0][0]) if male is None else male
    female = F.col(GENDER_SCORES[1][0]) if female is None else female
    return F.when(male >= female, GENDER_SCORES[0][1]).otherwise(GENDER_SCORES[1][1])


def range_low(label: Column) -> Column:
    return F.split_part(label, F.lit("-"), F.lit(1)).cast("int")


def range_high(label: Column) -> Column:
    return F.split_part(label, F.lit("-"), F.lit(2)).cast("int")


def age_on(born: Column, as_of: Column) -> Column:
    """Completed years at ``as_of``: a birthday counts from its own month and day on.

    Someone born on 29 February turns a year older on 1 March of a common year.
    """
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(as_of) - F.year(born) - before_birthday.cast("int")


def age_bin(age: Column, null_bin: str | None = None) -> Column:
    """Four-way bin of an age. A missing age gives ``null_bin`` (NULL unless asked otherwise)."""
    chain = F.when(age.isNull(), F.lit(null_bin))
    for upper, name in AGE_BINS:
        chain = chain.otherwise(name) if upper is None else chain.when(age <= upper, name)
    return chain


def annotators_agree(age_1: Column, age_2: Column, true_age: Column, null_bin: str | None = None) -> Column:
    """Both annotators chose one bin and it is the bin of the true age; never NULL."""
    first = age_bin(age_1, null_bin)
    agree = (first == age_bin(age_2, null_bin)) & (first == age_bin(true_age, null_bin))
    return F.coalesce(agree, F.lit(False))


def is_default_image(url: Column) -> Column:
    return F.coalesce(url == DEFAULT_PROFILE_IMAGE, F.lit(False))


def user_bucket(user_id: Column, buckets: int = USER_BUCKETS) -> Column:
    """Bucket 0..buckets-1 of an id, negative ids included."""
    return F.pmod(user_id, F.lit(buckets)).cast("int")
