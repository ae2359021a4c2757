import datetime
import itertools
import random

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from panelforge.functions.demographics import age_bin, age_on, is_default_image, user_bucket
from panelforge.operators import evaluation
from panelforge.plans import testdata as td
from panelforge.rules import DEFAULT_PROFILE_IMAGE
from panelforge.schemas import PREDICTIONS

SMALL, LARGE = 1_000_000, 0  # broadcast limits that choose either way


def _python_age(born, at):
    return at.year - born.year - ((at.month, at.day) < (born.month, born.day))


def test_age_on_matches_the_calendar(spark):
    born = [datetime.date(2000, 2, 29), datetime.date(1999, 3, 1), datetime.date(2000, 12, 31), datetime.date(1960, 1, 1)]
    at = [datetime.date(2021, 2, 28), datetime.date(2021, 3, 1), datetime.date(2020, 2, 29), datetime.date(2018, 8, 1)]
    pairs = list(itertools.product(born, at))
    df = spark.createDataFrame(pairs, "b DATE, a DATE").select("b", "a", age_on(F.col("b"), F.col("a")).alias("age"))
    assert [(r.b, r.a, r.age) for r in df.collect()] == [(b, a, _python_age(b, a)) for b, a in pairs]


def test_decode_ties_take_the_first(spark):
    data = [
        ("1", 1.0, 1.0, 1.0, 1.0, 0.5, 0.5),
        ("2", 0.0, 0.4, 0.4, 0.2, 0.4, 0.6),
        ("3", 0.1, 0.2, 0.3, 0.3, 0.6, 0.4),
        ("4", 0.1, 0.2, 0.3, 0.9, 0.6, 0.4),
    ]
    decoded = evaluation.decode_predictions(spark.createDataFrame(data, PREDICTIONS))
    assert rows(decoded, "id", "pred_gender", "pred_age_range", "min_age", "max_age") == [
        (1, "Male", "0-18", 0, 18),
        (2, "Female", "19-29", 19, 29),
        (3, "Male", "30-39", 30, 39),
        (4, "Male", "40-999", 40, 999),
    ]


def test_age_bins_and_missing_ages(spark):
    df = spark.createDataFrame([(18.0,), (18.5,), (29.0,), (39.0,), (40.0,), (None,)], "age DOUBLE")
    strict = [r[0] for r in df.select(age_bin(F.col("age"))).collect()]
    assert strict == ["age_<=18", "age_19-29", "age_19-29", "age_30-39", "age_>=40", None]
    assert df.select(age_bin(F.col("age"), "age_>=40")).collect()[-1][0] == "age_>=40"


def test_bucket_of_negative_ids(spark):
    df = spark.createDataFrame([(-7,), (47,), (None,)], "id BIGINT")
    assert [r[0] for r in df.select(user_bucket(F.col("id"))).collect()] == [33, 7, None]


def test_default_image(spark):
    df = spark.createDataFrame([(DEFAULT_PROFILE_IMAGE,), ("x",), (None,)], "u STRING")
    assert [r[0] for r in df.select(is_default_image(F.col("u"))).collect()] == [True, False, False]


def _known_fixture(spark):
    """The inputs whose results at this scale are known beforehand."""
    sf = f"{TESTDATA}/sf0.01"
    c = F.col("c_custkey")
    customers = td.table(spark, sf, "customer")
    panel = customers.filter(c % 3 != 0).select(
        c.alias("user_id"),
        F.when(c % 10 == 0, None).when(c % 2 == 0, "Male").otherwise("Female").alias("sex"),
        F.when(c % 97 == 0, F.lit("2000-02-29").cast("date"))
        .when(c % 11 == 0, None)
        .otherwise(F.date_add(F.lit("1940-01-01").cast("date"), ((c * 37) % 27000).cast("int")))
        .alias("birth_date"),
    )
    guess = 10 + (c * 7) % 45
    annotations = customers.filter(c % 2 == 1).select(
        c.alias("user_id"),
        F.when(c % 5 == 0, None).otherwise("F").alias("gender_1"),
        F.when(c % 7 == 0, None).otherwise("M").alias("gender_2"),
        F.when(c % 13 == 0, None).otherwise(guess).cast("double").alias("age_1"),
        F.when(c % 17 == 0, None).otherwise(guess + c % 3 - 1).cast("double").alias("age_2"),
    )
    decoded = evaluation.decode_predictions(td.all_predictions(spark, sf))
    as_of, then = F.lit("2021-06-30").cast("date"), F.lit("2018-08-01").cast("date")
    return evaluation.with_real_age(panel, as_of), annotations, decoded, then


@pytest.mark.parametrize("limit", [SMALL, LARGE])
def test_known_results(spark, limit):
    panel, annotations, decoded, then = _known_fixture(spark)
    score = evaluation.score_panel(panel, "user_id", "sex", "real_age", decoded, limit).first()
    assert (score.joined_rows, score.gender_accuracy, score.age_accuracy) == (1000, 0.45, 0.376)
    flags = evaluation.annotation_agreement(annotations, panel, then, max_broadcast=limit)
    assert rows(flags.groupBy("annot_goodness").count()) == [(False, 367), (True, 119)]
    agreed = evaluation.score_agreed(annotations, panel, decoded, then, max_broadcast=limit).first()
    assert agreed.agreed_rows == 119 and round(agreed.age_accuracy, 6) == 0.386555


def _random_case(spark, seed):
    """Repeated ids on every side, one of them with a third of all rows, and missing values."""
    rng = random.Random(seed)

    def uid():
        return 1 if rng.random() < 1 / 3 else rng.randrange(1, 12)

    def maybe(value):
        return None if rng.random() < 0.15 else value

    def born():
        return datetime.date(1930, 1, 1) + datetime.timedelta(days=rng.randrange(32000))

    panel = [(uid(), maybe(rng.choice(["Male", "Female", "Other"])), maybe(born())) for _ in range(40)]
    annotations = [
        (uid(), maybe("F"), maybe("M"), maybe(float(rng.randrange(5, 60))), maybe(float(rng.randrange(5, 60))))
        for _ in range(60)
    ]
    predictions = [(str(uid()), *[float(rng.randrange(4)) for _ in range(6)]) for _ in range(50)]
    panel_df = spark.createDataFrame(panel, "user_id BIGINT, sex STRING, birth_date DATE")
    annotations_df = spark.createDataFrame(
        annotations, "user_id BIGINT, gender_1 STRING, gender_2 STRING, age_1 DOUBLE, age_2 DOUBLE"
    )
    return panel_df, annotations_df, spark.createDataFrame(predictions, PREDICTIONS)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [SMALL, LARGE])
@pytest.mark.parametrize("null_bin", [None, "age_>=40"])
def test_scores_equal_scoring_every_joined_row(spark, seed, limit, null_bin):
    panel, annotations, predictions = _random_case(spark, seed)
    as_of, then = F.lit("2021-06-30").cast("date"), F.lit("2018-08-01").cast("date")
    panel = evaluation.with_real_age(panel, as_of)
    decoded = evaluation.decode_predictions(predictions)

    joined = evaluation.join_predictions(panel, "user_id", decoded, limit).collect()
    hits = [1 if r.sex == r.pred_gender else 0 for r in joined]
    in_range = [0 if r.real_age is not None and (r.min_age > r.real_age or r.max_age < r.real_age) else 1 for r in joined]
    score = evaluation.score_panel(panel, "user_id", "sex", "real_age", decoded, limit).first()
    assert score.joined_rows == len(joined)
    assert score.gender_accuracy == pytest.approx(sum(hits) / len(joined))
    assert score.age_accuracy == pytest.approx(sum(in_range) / len(joined))

    flagged = evaluation.annotation_agreement(annotations, panel, then, null_bin, limit)
    good = flagged.filter("annot_goodness").join(decoded, F.col("id") == F.col("user_id")).collect()
    fits = [0 if r.real_age is not None and (r.min_age > r.real_age or r.max_age < r.real_age) else 1 for r in good]
    agreed = evaluation.score_agreed(annotations, panel, decoded, then, null_bin, limit).first()
    assert agreed.agreed_rows == len(good)
    assert agreed.age_accuracy == (pytest.approx(sum(fits) / len(good)) if good else None)


def test_empty_join_scores_null(spark):
    panel, _, predictions = _random_case(spark, 3)
    decoded = evaluation.decode_predictions(predictions).filter("id < 0")
    panel = evaluation.with_real_age(panel, F.lit("2021-06-30").cast("date"))
    score = evaluation.score_panel(panel, "user_id", "sex", "real_age", decoded).first()
    assert (score.joined_rows, score.gender_accuracy, score.age_accuracy) == (0, None, None)


def test_annotations_need_one_gender(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, "F", None), (3, None, "M")], "user_id BIGINT, gender_1 STRING, gender_2 STRING"
    )
    assert rows(evaluation.annotated(df), "user_id") == [(2,), (3,)]
