"""Ordered pattern rules for ages and genders that people state in their profile text.

Two rule sets exist. ``literal`` keeps two escaping accidents of the published rules (a dead male pattern, and
``yo`` where ``y/o`` was meant); ``intended`` is what they were meant to say and is the default.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """One pattern. ``anchors`` are lower-case pieces; text that matches the pattern holds at least one of them."""

    name: str
    regex: str
    anchors: tuple[str, ...]
    label: str | None = None


@dataclass(frozen=True)
class RuleSet:
    name: str
    age: tuple[Rule, ...]
    gender: tuple[Rule, ...]

    def first_stage(self, with_bare_age: bool = False) -> tuple[Rule, ...]:
        """Rules of the cheap first scan: all gender rules and the ages that need no gender word.

        ``with_bare_age`` also lets through ``29 yo ...`` without a gender word, which the first scan leaves out.
        """
        ages = self.age if with_bare_age else self.age[:2]
        return self.gender + ages


UNLABELED_AGE = "unlabeled_age"
UNLABELED_GENDER = "unlabeled_gender"

# Names, order, patterns and labels of the rules. The first match wins.
INTENDED = RuleSet(
    "intended",
    age=(
        Rule("age_pattern_1", r"(?i)born in (\d{4})", ("born in ",)),
        Rule("age_pattern_2", r"(?i)(\d{2}) years old", (" years old",)),
        Rule("age_pattern_3", r"(?i)(\d{2}) y/?o ", ("yo ", "y/o ")),
    ),
    gender=(
        Rule("gender_pattern_1", r"(?i)(I'?m|I am) a (guy|man|husband|father|dude)", ("m a ",), "MALE"),
        Rule("gender_pattern_2", r"(?i)(I'?m|I am) a (girl|mother|wife|woman)", ("m a ",), "FEMALE"),
        Rule("gender_pattern_3", r"(?i)(\d{2}) y/?o (woman|lady|girl)", ("yo ", "y/o "), "FEMALE"),
        Rule("gender_pattern_4", r"(?i)(\d{2}) y/?o (man|dude|guy)", ("yo ", "y/o "), "MALE"),
        Rule("gender_pattern_5", r"(?i)(^|, )(mother|wife|mom),", ("mother,", "wife,", "mom,"), "FEMALE"),
        Rule("gender_pattern_6", r"(?i)(^|, )(father|dad|husband),", ("father,", "dad,", "husband,"), "MALE"),
        Rule("gender_pattern_7", r"(?i)mother (of|to) ", ("mother ",), "FEMALE"),
        Rule("gender_pattern_8", r"(?i)father (of|to) ", ("father ",), "MALE"),
        Rule("gender_pattern_9", r"(?i)wife of ", ("wife of ",), "FEMALE"),
        Rule("gender_pattern_10", r"(?i)husband of ", ("husband of ",), "MALE"),
    ),
)

# The three places where the literal rules differ.
_LITERAL_REGEX = {
    "age_pattern_3": r"(?i)(\d{2}) yo ",
    "gender_pattern_1": "(?i)(I'?m|I am) a (guymanhusband\x0catherdude)",
    "gender_pattern_3": r"(?i)(\d{2}) yo (woman|lady|girl)",
    "gender_pattern_4": r"(?i)(\d{2}) yo (man|dude|guy)",
}


def _literal(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    return tuple(Rule(r.name, _LITERAL_REGEX.get(r.name, r.regex), r.anchors, r.label) for r in rules)


LITERAL = RuleSet("literal", _literal(INTENDED.age), _literal(INTENDED.gender))
RULE_SETS = {s.name: s for s in (INTENDED, LITERAL)}

# Age limits and groups of a stated age. The reference year turns a birth year into an age.
DEFAULT_REF_YEAR = 2021
YOUNGEST_STATED_AGE, OLDEST_STATED_AGE = 8, 98
AGE_GROUPS = ((18, "<=18"), (29, "(18-30)"), (39, "[30-40)"), (OLDEST_STATED_AGE, "[40-99)"))

# Score columns of a prediction, the label each stands for, and the age bins of annotators.
AGE_SCORES = (
    ("age_<=18", "0-18"),
    ("age_19-29", "19-29"),
    ("age_30-39", "30-39"),
    ("age_>=40", "40-999"),
)
GENDER_SCORES = (("gender_male", "Male"), ("gender_female", "Female"))
AGE_BINS = ((18, "age_<=18"), (29, "age_19-29"), (39, "age_30-39"), (None, "age_>=40"))

# Fixed value: address of the picture of a profile without one.
DEFAULT_PROFILE_IMAGE = "https://abs.twimg.com/sticky/default_profile_images/default_profile_normal.png"

USER_BUCKETS = 40
