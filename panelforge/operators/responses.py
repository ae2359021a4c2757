"""Tables from stored API responses ``(user_id, body)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.schemas import EDGE_ITEM, POST_ITEM, USER_ITEM, response_schema


def parse_responses(responses: DataFrame, item: str) -> DataFrame:
    """Replace the body by the struct ``r``; a body that is no JSON object has only missing fields.

    The operators below keep rows by outer generators with conditions inside, and drop the empty ones afterwards.
    A filter on ``r``, or the one that the optimizer derives from a plain ``explode``, would move below the
    projection and parse every body a second time.
    """
    return responses.withColumn("r", F.from_json("body", response_schema(item))).drop("body")


def has_errors() -> Column:
    """An empty error list is no error."""
    return F.coalesce(F.size("r.errors") > 0, F.lit(False))


def outcome() -> Column:
    """What a response holds; an error outranks data, and what fits nothing is kept as unknown."""
    return (
        F.when(has_errors(), "error")
        .when(F.col("r.data").isNotNull(), "data")
        .when(F.col("r.meta.result_count") == 0, "empty")
        .otherwise("unknown")
    )


def error_text(detail: Column) -> Column:
    """The message up to the first bracket, where the repeated id begins."""
    return F.substring_index(detail, "[", 1)


def response_outcomes(responses: DataFrame) -> DataFrame:
    return parse_responses(responses, EDGE_ITEM).select("user_id", outcome().alias("outcome"))


def _items(parsed: DataFrame, items: Column, *keep: str) -> DataFrame:
    """One row per item, with the item as struct ``item``."""
    return parsed.select(*keep, F.explode_outer(items).alias("item")).filter(F.col("item").isNotNull())


def first_errors(responses: DataFrame) -> DataFrame:
    """One row per failed response: the first error, without the repeated id."""
    first = _items(parse_responses(responses, EDGE_ITEM), F.slice("r.errors", 1, 1), "user_id")
    return first.select("user_id", error_text(F.col("item.detail")).alias("detail"))


def all_errors(responses: DataFrame) -> DataFrame:
    """One row per listed error, text as it came."""
    errors = _items(parse_responses(responses, USER_ITEM), F.col("r.errors"))
    return errors.select(F.col("item.value").try_cast("bigint").alias("user_id"), F.col("item.detail").alias("detail"))


def users_from_responses(responses: DataFrame) -> DataFrame:
    """One row per user record, also of responses that list errors."""
    return _items(parse_responses(responses, USER_ITEM), F.col("r.data")).select("item.*")


def data_without_errors() -> Column:
    return F.when(~has_errors(), F.col("r.data"))


def follow_edges(responses: DataFrame) -> DataFrame:
    """(user, followee) pairs of responses without errors."""
    edges = _items(parse_responses(responses, EDGE_ITEM), data_without_errors(), "user_id")
    return edges.select("user_id", F.col("item.id").try_cast("bigint").alias("followee_id"))


def next_tokens(responses: DataFrame) -> DataFrame:
    """Token of the next page, NULL on the last page."""
    return parse_responses(responses, EDGE_ITEM).select("user_id", F.col("r.meta.next_token").alias("next_token"))


def edges_over_pages(responses: DataFrame) -> DataFrame:
    """One edge set per user from all of its pages; a pair seen on two pages counts once."""
    return follow_edges(responses).distinct()


def page_status(responses: DataFrame) -> DataFrame:
    """Per user: stored pages, and whether all are there.

    Complete means that no page failed (an error, no data, or a body that cannot be read) and that a page without a
    token for the next one is among them.
    """
    pages = parse_responses(responses, EDGE_ITEM).select(
        "user_id", F.col("r.meta.next_token").alias("next_token"), outcome().isin("data", "empty").alias("fine")
    )
    whole = F.bool_and("fine") & F.bool_or(F.col("fine") & F.col("next_token").isNull())
    return pages.groupBy("user_id").agg(F.count("*").alias("n_pages"), whole.alias("is_complete"))


def page_chains(responses: DataFrame) -> DataFrame:
    """Per user: stored pages, gaps, stray pages, and whether the pages are one whole chain.

    ``responses`` also has the ``token`` that each page was asked with, NULL for the first one. A page links to the page
    asked with its next token. A gap is a linked page, or a first page, that is missing or has failed; a stray page is one
    that no good page links to; a token that two pages link to is a fork or a loop. A page stored twice counts once, and as
    good if one of its copies is. Complete means a good first page, no gap, no stray page, no fork, and one page without a
    next token: then following the links from the first page passes all others and ends there.

    Pages and links meet by (user, token), so that a user with very many pages is spread over tasks.
    """
    first = F.lit("")
    pages = parse_responses(responses, EDGE_ITEM).select(
        "user_id", F.coalesce("token", first).alias("token"), outcome().isin("data", "empty").alias("good"), F.col("r.meta.next_token").alias("next_token")
    )
    page = F.struct(F.col("token").alias("at"), F.lit(True).alias("is_page"), "good", F.lit(None).cast("string").alias("linked_by"), (F.col("good") & F.col("next_token").isNull()).alias("ends"))
    link = F.struct(F.col("next_token").alias("at"), F.lit(False).alias("is_page"), F.lit(False).alias("good"), F.col("token").alias("linked_by"), F.lit(False).alias("ends"))
    both = pages.select("user_id", F.explode(F.array(page, F.when(F.col("good") & F.col("next_token").isNotNull(), link))).alias("p"))
    places = both.filter("p is not null").select("user_id", "p.*").groupBy("user_id", "at").agg(
        F.bool_or("is_page").alias("stored"), F.bool_or("good").alias("good"), F.bool_or("ends").alias("ends"), F.min("linked_by").alias("a"), F.max("linked_by").alias("b")
    )
    is_first, linked = F.col("at") == first, F.col("a").isNotNull()

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counted = places.groupBy("user_id").agg(
        count(F.col("stored")).alias("n_pages"),
        (count(~is_first & linked & ~F.col("good")) + 1 - count(is_first & F.col("good"))).alias("n_gaps"),
        count(~is_first & ~linked).alias("n_stray"),
        count((F.col("a") != F.col("b")) | (is_first & linked)).alias("n_forks"),
        count(F.col("ends")).alias("n_ends"),
    )
    whole = (F.col("n_gaps") == 0) & (F.col("n_stray") == 0) & (F.col("n_forks") == 0) & (F.col("n_ends") == 1)
    return counted.select("user_id", "n_pages", "n_gaps", "n_stray", whole.alias("is_complete"))


def posts_from_responses(responses: DataFrame) -> DataFrame:
    """One row per post of responses without errors, with typed ids."""
    posts = _items(parse_responses(responses, POST_ITEM), data_without_errors(), "user_id").select("user_id", "item.*")
    return posts.withColumns(
        {c: F.col(c).try_cast("bigint") for c in ("id", "conversation_id", "in_reply_to_user_id")}
    )


def routed(responses: DataFrame) -> DataFrame:
    """Rows of every outcome in one frame, so that one write can split them into folders.

    Data gives one row per followee, an error its message, the other outcomes the user alone. The input is scanned
    and each body parsed once for all outcomes.
    """
    classified = parse_responses(responses, EDGE_ITEM).withColumn("outcome", outcome())
    rows = classified.select(
        "outcome",
        "user_id",
        F.explode_outer(F.when(F.col("outcome") == "data", F.col("r.data"))).alias("item"),
        F.when(F.col("outcome") == "error", error_text(F.get("r.errors", F.lit(0))["detail"])).alias("detail"),
    )
    # An empty data list has no edge to write; every other response without data keeps its row.
    return rows.filter((F.col("outcome") != "data") | F.col("item").isNotNull()).select(
        "outcome", "user_id", F.col("item.id").try_cast("bigint").alias("followee_id"), "detail"
    )
