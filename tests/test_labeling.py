import random
import re

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from panelforge.functions.disclosure import age_group, matches_any, may_match_any
from panelforge.functions.registry import register_functions
from panelforge.operators import labeling
from panelforge.plans import catalog
from panelforge.plans.testdata import BIOS
from panelforge.rules import INTENDED, LITERAL, RULE_SETS

U = None  # unlabeled
# position in BIOS: (age pattern, stated age, age group, gender pattern, gender); missing = dropped by the first scan
INTENDED_TRUTH = {
    0: (U, U, U, 2, "FEMALE"),
    1: (U, U, U, 1, "MALE"),
    2: (U, U, U, 9, "FEMALE"),
    3: (U, U, U, 10, "MALE"),
    4: (U, U, U, 7, "FEMALE"),
    5: (U, U, U, 8, "MALE"),
    6: (1, "1990", "[30-40)", U, U),
    7: (1, "1901", None, U, U),
    8: (2, "25", "(18-30)", U, U),
    9: (2, "07", None, U, U),
    10: (3, "31", "[30-40)", 4, "MALE"),
    11: (3, "44", "[40-99)", 3, "FEMALE"),
    12: (U, U, U, 5, "FEMALE"),
    13: (U, U, U, 6, "MALE"),
    14: (U, U, U, 7, "FEMALE"),
    15: (2, "18", "<=18", 6, "MALE"),
    16: (1, "2003", "<=18", U, U),
    17: (2, "00", None, U, U),
    18: (1, "2013", "<=18", U, U),
    23: (U, U, U, 2, "FEMALE"),
    24: (U, U, U, 8, "MALE"),
    25: (U, U, U, 1, "MALE"),
    26: (3, "52", "[40-99)", 4, "MALE"),
}
LITERAL_TRUTH = {k: v for k, v in INTENDED_TRUTH.items() if k not in (1, 26)} | {25: (U, U, U, 9, "FEMALE")}


def _expected(truth):
    result = []
    for k, (age_at, stated, group, gender_at, gender) in truth.items():
        result.append(
            (
                k,
                f"age_pattern_{age_at}" if age_at else "unlabeled_age",
                stated or "unlabeled_age",
                group if age_at else "unlabeled_age",
                f"gender_pattern_{gender_at}" if gender_at else "unlabeled_gender",
                gender or "unlabeled_gender",
            )
        )
    return sorted(result, key=repr)


@pytest.fixture(scope="module")
def bios(spark):
    return spark.createDataFrame(list(enumerate(BIOS)), "k INT, user_bio STRING")


@pytest.mark.parametrize("name, truth", [("intended", INTENDED_TRUTH), ("literal", LITERAL_TRUTH)])
def test_truth_table(bios, name, truth):
    rules = RULE_SETS[name]
    matched = labeling.match_any(bios, "user_bio", rules.first_stage())
    labeled = labeling.label_bios(matched, rules).withColumn("age_group", age_group(F.col("age_label")))
    got = rows(labeled, "k", "age_pattern", "age_label", "age_group", "gender_pattern", "gender_label")
    assert got == _expected(truth)


def test_labels_of_all_bios_never_null(bios):
    labeled = labeling.label_bios(bios)
    assert labeled.count() == len(BIOS)
    assert labeled.filter("age_pattern IS NULL OR age_label IS NULL OR gender_label IS NULL").count() == 0
    marker = labeled.filter("k = 21").first()
    assert marker.age_label == "unlabeled_age" and marker.gender_label == "unlabeled_gender"


def test_bare_age_needs_the_option(bios):
    strict = labeling.match_any(bios, "user_bio", INTENDED.first_stage())
    wide = labeling.match_any(bios, "user_bio", INTENDED.first_stage(with_bare_age=True))
    assert rows(wide.exceptAll(strict)) == [(22, "29 yo and loving it")]


def test_literal_dead_pattern_matches_its_own_text(spark):
    text = "I am a guymanhusband\x0catherdude"
    df = spark.createDataFrame([(text,)], "user_bio STRING")
    assert labeling.label_genders(df, LITERAL).first().gender_pattern == "gender_pattern_1"


@pytest.mark.parametrize("rules", [INTENDED, LITERAL])
def test_anchors_never_hide_a_match(spark, rules):
    """Texts of every rule, in upper, lower and mixed case, pass the cheap scan if a regex matches."""
    pieces = ["i'm a guy", "im a man", "i am a wife", "wife of x", "husband of y", "mother to z", "father of w",
              "born in 1980", "33 years old", "33 yo man", "33 y/o lady", "33 y/o dude ", "mom, x", "a, dad, b",
              "wife, husband, c", "i am a guymanhusband\x0catherdude", "MOTHER, OF", "x, father,"]
    texts = [t for p in pieces for t in (p, p.upper(), p.title(), "é " + p, "K " + p.swapcase())]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    all_rules = rules.age + rules.gender
    regex_only = F.expr(" OR ".join(["false"]))
    for rule in all_rules:
        regex_only = regex_only | F.col("t").rlike(rule.regex)
    hidden = df.filter(regex_only & ~may_match_any(F.col("t"), all_rules))
    assert hidden.count() == 0
    assert df.filter(regex_only).count() == df.filter(matches_any(F.col("t"), all_rules)).count() > 40


FRAGMENTS = [
    "I'm a ", "Im a ", "I AM A ", "guy", "girl", "wife", "mother of ", "Father to ", "husband of ", "wife of ", "mom,",
    ", dad,", "born in ", "1985", "03", "41 years old", "23 yo ", "23 y/o ", "man", "lady", " and ", "coffee", ", ", "é",
]


@pytest.mark.parametrize("rules", [INTENDED, LITERAL])
def test_random_bios_equal_python_regexes(spark, rules):
    """Labels of random texts, against the rules applied one after the other in plain Python."""
    rng = random.Random(7)
    bios = ["".join(rng.choices(FRAGMENTS, k=rng.randrange(1, 7))) for _ in range(1500)]

    def first(candidates, text):
        return next(((r, m) for r in candidates if (m := re.search(r.regex, text))), (None, None))

    expected = []
    for k, text in enumerate(bios):
        age, stated = first(rules.age, text)
        gender, _ = first(rules.gender, text)
        kept = first(rules.first_stage(), text)[0] is not None
        expected.append(
            (
                k,
                kept,
                age.name if age else "unlabeled_age",
                stated.group(1) if age else "unlabeled_age",
                gender.name if gender else "unlabeled_gender",
                gender.label if gender else "unlabeled_gender",
            )
        )
    df = spark.createDataFrame(list(enumerate(bios)), "k INT, user_bio STRING")
    labeled = labeling.label_bios(df, rules).withColumn("kept", matches_any(F.col("user_bio"), rules.first_stage()))
    got = rows(labeled, "k", "kept", "age_pattern", "age_label", "gender_pattern", "gender_label")
    assert got == sorted(expected, key=repr)


AGE_CASES = [
    ("1923", "[40-99)"), ("1922", None), ("2014", None), ("2013", "<=18"), ("98", "[40-99)"), ("99", None),
    ("08", "<=18"), ("07", None), ("18", "<=18"), ("19", "(18-30)"), ("29", "(18-30)"), ("30", "[30-40)"),
    ("39", "[30-40)"), ("40", "[40-99)"), ("00", None), ("unlabeled_age", "unlabeled_age"), (None, None),
    ("abcd", None), ("", None),
]


def test_age_groups(spark):
    df = spark.createDataFrame(AGE_CASES, "label STRING, expected STRING")
    assert df.filter(~age_group(F.col("label")).eqNullSafe(F.col("expected"))).count() == 0


def test_age_groups_in_sql(spark):
    register_functions(spark)
    spark.createDataFrame(AGE_CASES, "label STRING, expected STRING").createOrReplaceTempView("age_cases")
    wrong = spark.sql("SELECT * FROM age_cases WHERE NOT validate_and_group_age(label) <=> expected")
    assert wrong.count() == 0


def test_reference_year_moves_ages(spark):
    df = spark.createDataFrame([("1990",)], "label STRING")
    assert df.select(age_group(F.col("label"), 2031)).first()[0] == "[40-99)"


def test_distinct_keeps_users_with_two_bios(spark):
    df = spark.createDataFrame(
        [(1, "n", "a", "d1"), (1, "n", "a", "d2"), (1, "n", "b", "d1"), (2, "n", "a", "d1")],
        "user_id BIGINT, user_screen_name STRING, user_bio STRING, ds STRING",
    )
    once = labeling.distinct_bios(df)
    assert once.count() == 3
    assert labeling.distinct_bios(once).count() == 3


def test_labels_at_sf001_match_the_known_totals(spark):
    directory = f"{TESTDATA}/sf0.01"
    assert catalog.labeled_bios(spark, directory).count() == 386
    assert catalog.bio_labels_literal(spark, directory).count() == 354


def test_overlap_sums_to_all_rows(spark):
    directory = f"{TESTDATA}/sf0.001"
    overlap = catalog.age_gender_overlap(spark, directory)
    assert overlap.agg(F.sum("n")).first()[0] == catalog.age_groups(spark, directory).count()


def test_regexes_run_once_per_row(spark):
    """Filters on labels stay above the labels."""
    df = spark.createDataFrame([(1, "x", "born in 1990")], "user_id BIGINT, user_screen_name STRING, user_bio STRING")
    grouped = labeling.with_age_group(labeling.label_ages(labeling.distinct_bios(df)))
    plan = grouped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("born in") == 2  # one test, one capture


def test_validation_sets_repeat_their_order(spark):
    labeled = catalog.labeled_bios(spark, f"{TESTDATA}/sf0.001")
    first, again = labeling.validation_age(labeled, seed=1).collect(), labeling.validation_age(labeled, seed=1).collect()
    other = labeling.validation_age(labeled, seed=2).collect()
    assert first == again != other
    assert sorted(first) == sorted(other)
    genders = labeling.validation_gender(labeled, seed=1)
    assert genders.columns == ["user_id", "gender_pattern", "gender_label"]
    assert genders.filter("gender_label = 'unlabeled_gender'").count() == 0
