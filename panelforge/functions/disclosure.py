"""Column expressions for rules on profile text, and for the ages found there."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from panelforge.rules import (
    AGE_GROUPS,
    DEFAULT_REF_YEAR,
    OLDEST_STATED_AGE,
    UNLABELED_AGE,
    YOUNGEST_STATED_AGE,
    Rule,
)


def may_match_any(text: Column, rules: Sequence[Rule]) -> Column:
    """True for every text that can match a rule; cheap, and false for most other text.

    A dozen case-insensitive regexes cost far more per row than plain substring searches in lower-cased text.
    ``exists`` over a one-element array lower-cases the text once rather than once per search.
    """
    anchors = dict.fromkeys(a for rule in rules for a in rule.anchors)
    return F.exists(
        F.array(F.lower(text)),
        lambda lowered: reduce(or_, [F.contains(lowered, F.lit(a)) for a in anchors]),
    )


def matches_any(text: Column, rules: Sequence[Rule]) -> Column:
    """True if some rule matches; NULL or false otherwise, so that a filter drops NULL text."""
    return may_match_any(text, rules) & reduce(or_, [text.rlike(r.regex) for r in rules])


def first_match(text: Column, rules: Sequence[Rule]) -> Column:
    """1-based position of the first rule that matches, 0 if none does."""
    chain = F.when(text.rlike(rules[0].regex), 1)
    for position, rule in enumerate(rules[1:], start=2):
        chain = chain.when(text.rlike(rule.regex), position)
    return chain.otherwise(0)


def by_position(position: Column, marker: str, values: Sequence[str]) -> Column:
    """Look a ``first_match`` position up; 0 gives the marker."""
    return F.get(F.array(F.lit(marker), *[F.lit(v) for v in values]), position)


def captured(text: Column, position: Column, marker: str, rules: Sequence[Rule]) -> Column:
    """Group 1 of the rule at ``position``; only that rule's regex runs."""
    chain = F.when(position == 0, marker)
    for at, rule in enumerate(rules, start=1):
        chain = chain.when(position == at, F.regexp_extract(text, rule.regex, 1))
    return chain


def age_group(age_label: Column, ref_year: int = DEFAULT_REF_YEAR) -> Column:
    """Group of a stated age: four characters are a birth year, anything else an age.

    The marker passes through; ages outside 8..98 and labels that are not numbers give NULL.
    """
    number = age_label.try_cast("int")
    age = F.when(F.length(age_label) == 4, F.lit(ref_year) - number).otherwise(number)
    chain = F.when(age_label == UNLABELED_AGE, UNLABELED_AGE).when(
        ~age.between(YOUNGEST_STATED_AGE, OLDEST_STATED_AGE), None
    )
    for upper, name in AGE_GROUPS:
        chain = chain.when(age <= upper, name)
    return chain
