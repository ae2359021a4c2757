"""Functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from panelforge.rules import AGE_GROUPS, DEFAULT_REF_YEAR, OLDEST_STATED_AGE, UNLABELED_AGE, YOUNGEST_STATED_AGE


def register_functions(spark: SparkSession, ref_year: int = DEFAULT_REF_YEAR) -> None:
    """Make ``validate_and_group_age(label)`` callable from SQL as a SQL function.

    The optimizer inlines a SQL function, so it costs no Python round trip and may be named in WHERE and SELECT.
    """
    groups = " ".join(f"WHEN age <= {upper} THEN '{name}'" for upper, name in AGE_GROUPS)
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION validate_and_group_age(label STRING) RETURNS STRING
        RETURN SELECT CASE
            WHEN label = '{UNLABELED_AGE}' THEN label
            WHEN age NOT BETWEEN {YOUNGEST_STATED_AGE} AND {OLDEST_STATED_AGE} THEN NULL
            {groups} END
        FROM (SELECT CASE WHEN length(label) = 4 THEN {ref_year} - try_cast(label AS INT)
                          ELSE try_cast(label AS INT) END AS age)
        """
    )
