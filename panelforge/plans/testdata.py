"""Stand-ins for the job inputs, derived from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelforge.functions import breaks as line_breaks
from panelforge.functions.demographics import user_bucket
from panelforge.rules import DEFAULT_PROFILE_IMAGE

BIOS = (
    "I am a girl who codes",
    "I'm a guy from Ohio",
    "wife of a sailor",
    "proud husband of Ann",
    "mother of two",
    "father to three",
    "born in 1990",
    "born in 1901",
    "25 years old",
    "07 years old",
    "31 yo man",
    "44 yo lady",
    "mom, runner",
    "coffee, Dad, golf",
    "grandmother of 3",
    "18 years old, dad, coder",
    "Born In 2003",
    "100 years old oak",
    "born in 2013",
    "data person",
    "",
    None,
    "29 yo and loving it",
    "Im a woman",
    "godfather of jazz",
    "I am a father and a wife of none",
    "52 y/o guy",
)

# Posts of one third of all documents share this author, so that skew shows.
BUSY_AUTHOR = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bio(position: Column) -> Column:
    bios = F.expr(f"array({', '.join('NULL' if b is None else json.dumps(b) for b in BIOS)})")
    return F.get(bios, position.cast("int"))


def stream_posts(spark: SparkSession, sf_dir: str, days: tuple[str, str] | None = None) -> DataFrame:
    """One post per event, of all days or of a range of days; its author has up to three bios.

    ``ds`` is computed here, so that a filter on it would not reach the scan; the range does.
    """
    events = table(spark, sf_dir, "events")
    if days:
        kind = events.schema["ts"].dataType
        end = F.date_add(F.lit(days[1]).cast("date"), 1).cast(kind)
        events = events.filter((F.col("ts") >= F.lit(days[0]).cast("date").cast(kind)) & (F.col("ts") < end))
    position = (F.col("user_id") * 7 + F.col("event_id") % 3) % len(BIOS)
    return events.select(
        F.col("event_id").alias("id"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
        F.struct(
            F.col("user_id").alias("id"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("screen_name"),
            _bio(position).alias("description"),
        ).alias("user"),
        F.col("ts").cast("date").cast("string").alias("ds"),
    )


def repeated(posts: DataFrame) -> DataFrame:
    """The posts, one in three of them twice."""
    return posts.unionByName(posts.filter("id % 3 = 0"))


def panel_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same posts with the half-month and the user's bucket."""
    half = F.when(F.dayofmonth("ts") < 16, "01").otherwise("16")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.struct(F.col("user_id").alias("id")).alias("user"),
        F.concat_ws(" ", "event_type", "props").alias("full_text"),
        F.concat(F.date_format("ts", "yyyy-MM-"), half).alias("created_at_bucket"),
        user_bucket(F.col("user_id")).alias("user_id_bucket"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a post with its whole text, spread over the days of January 2024."""
    author = F.when(F.col("doc_id") % 3 == 0, BUSY_AUTHOR).otherwise(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        author.cast("bigint").alias("user_id"),
        "text",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("string").alias("ds"),
    )


def followee_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")
    return table(spark, sf_dir, "customer").filter(wanted).select(F.col("c_custkey").alias("followee_uid"))


def panel_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("c_mktsegment").isin("HOUSEHOLD", "AUTOMOBILE")
    return table(spark, sf_dir, "customer").filter(wanted).select(F.col("c_custkey").alias("panel_uid"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of which one in eight belongs to an unknown user, so that a customer lacks it."""
    c = F.col("id").cast("bigint")
    return all_predictions(spark, sf_dir).withColumn("id", F.when(c % 8 == 3, c + 10_000_000).otherwise(c).cast("string"))


def all_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer that need not add up to one; some tie."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.cast("string").alias("id"),
        ((c * 7) % 11).cast("double").alias("age_<=18"),
        ((c * 5) % 13).cast("double").alias("age_19-29"),
        ((c * 3) % 17).cast("double").alias("age_30-39"),
        ((c * 2) % 19).cast("double").alias("age_>=40"),
        ((c * 13) % 101).cast("double").alias("gender_male"),
        (100 - (c * 13) % 101).cast("double").alias("gender_female"),
    )


def panel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel members with sex and birth date; some are missing, some were born on 29 February."""
    c = F.col("c_custkey")
    panel = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY")
    return panel.select(
        c.alias("user_id"),
        F.when(c % 10 == 0, None).when(c % 2 == 0, "Male").otherwise("Female").alias("sex"),
        F.when(c % 97 == 0, F.lit("2000-02-29").cast("date"))
        .when(c % 11 == 0, None)
        .otherwise(F.date_add(F.lit("1940-01-01").cast("date"), ((c * 37) % 27000).cast("int")))
        .alias("birth_date"),
    )


def panel_5k(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0).select(
        c.alias("panel_uid"),
        F.when(c % 10 == 0, None).when(c % 4 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(c % 11 == 0, None).otherwise((c * 37) % 80).cast("int").alias("age"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two annotators per person; either may have left gender or age open."""
    c = F.col("c_custkey")
    guess = 10 + (c * 7) % 45
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "HOUSEHOLD").select(
        c.alias("user_id"),
        F.when(c % 5 == 0, None).otherwise("F").alias("gender_1"),
        F.when(c % 7 == 0, None).otherwise("M").alias("gender_2"),
        F.when(c % 13 == 0, None).otherwise(guess).cast("double").alias("age_1"),
        F.when(c % 17 == 0, None).otherwise(guess + c % 3 - 1).cast("double").alias("age_2"),
    )


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    uid = c.cast("string")
    return table(spark, sf_dir, "customer").select(
        uid.alias("uid"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user_"), uid).alias("screen_name"),
        _bio(c % len(BIOS)).alias("description"),
        F.when(c % 4 == 0, DEFAULT_PROFILE_IMAGE)
        .when(c % 9 == 0, None)
        .otherwise(F.concat(F.lit("https://img.example/"), uid, F.lit(".jpg")))
        .alias("profile_image_url_https"),
    )


def follow_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored page per customer, of six kinds."""
    c = F.col("c_custkey")

    def body(template: str) -> Column:
        return F.format_string(template, *[c + n for n in range(4)])

    return table(spark, sf_dir, "customer").select(
        c.alias("user_id"),
        F.when(
            c % 6 == 0,
            body('{"data":[{"id":"%2$d"},{"id":"%3$d"}],"meta":{"result_count":2,"next_token":"t%1$d"}}'),
        )
        .when(c % 6 == 1, '{"meta":{"result_count":0}}')
        .when(c % 6 == 2, body('{"errors":[{"value":"%1$d","detail":"Could not find user with id: [%1$d]."}]}'))
        .when(c % 6 == 3, body('{"data":[{"id":"%2$d"}],"errors":[{"value":"%1$d","detail":"Partly hidden"}]}'))
        .when(c % 6 == 4, '{"meta":{}}')
        .otherwise(body('{"data":[{"id":"%4$d"}],"meta":{"result_count":1}}'))
        .alias("body"),
    )


def paged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per order: orders of a customer are its pages, the supplier-like number its followee.

    Some pages are errors, some bodies are no JSON, some are missing.
    """
    followee, order = (F.col("o_orderkey") % 50).cast("string"), F.col("o_orderkey").cast("string")
    token = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(',"next_token":"t'), order, F.lit('"'))).otherwise("")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 97 == 0, '{"errors":[{"value":"1","detail":"Over capacity"}]}')
        .when(F.col("o_orderkey") % 97 == 1, "<html>Bad gateway</html>")
        .when(F.col("o_orderkey") % 97 == 2, None)
        .otherwise(
            F.concat(F.lit('{"data":[{"id":"'), followee, F.lit('"}],"meta":{"result_count":1'), token, F.lit("}}"))
        )
        .alias("body"),
    )


def user_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lookups of a hundred customers each, with a list of records and a list of errors."""
    c = F.col("c_custkey")
    uid = c.cast("string")
    record = F.struct(
        uid.alias("id"),
        F.concat(F.lit("user_"), uid).alias("username"),
        F.col("c_name").alias("name"),
        _bio(c % len(BIOS)).alias("description"),
        F.lit("2020-01-01T00:00:00.000Z").alias("created_at"),
        F.col("c_mktsegment").alias("location"),
        F.concat(F.lit("https://img.example/"), uid, F.lit(".jpg")).alias("profile_image_url"),
        F.when(c % 3 == 0, F.concat(F.lit("https://example.org/"), uid)).alias("url"),
        F.when(c % 50 == 0, F.struct(F.array(F.lit("DE"), F.lit("FR")).alias("country_codes"), F.lit("user").alias("scope"))).alias("withheld"),
        (c % 2 == 0).alias("protected"),
        (c % 5 == 0).alias("verified"),
        F.struct(
            (c % 100).alias("followers_count"), (c % 70).alias("following_count"), (c % 60).alias("tweet_count"), (c % 7).alias("listed_count")
        ).alias("public_metrics"),
    )
    missing = F.struct(uid.alias("value"), F.format_string("Could not find user with ids: [%d].", c).alias("detail"))
    lists = table(spark, sf_dir, "customer").groupBy(F.floor((c - 1) / 100).alias("user_id")).agg(
        F.collect_list(F.when(c % 9 != 0, record)).alias("data"), F.collect_list(F.when((c % 9 == 0) | (c % 4 == 0), missing)).alias("errors")
    )
    return lists.select("user_id", F.to_json(F.struct("data", F.when(F.size("errors") > 0, F.col("errors")).alias("errors"))).alias("body"))


def post_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored page per conversation with all its messages, each with its whole text."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    post = F.struct(
        number.cast("string").alias("id"),
        "text",
        F.lit("2024-01-01T00:00:00.000Z").alias("created_at"),
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.when(F.col("turn") > 0, F.col("conv_id").cast("string")).alias("in_reply_to_user_id"),
        F.lit("en").alias("lang"),
        F.struct(
            F.col("turn").alias("reply_count"), F.length("text").alias("like_count"), (number % 7).alias("retweet_count"), (number % 3).alias("quote_count")
        ).alias("public_metrics"),
    )
    lists = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.collect_list(post).alias("data"))
    meta = F.struct(F.size("data").alias("result_count")).alias("meta")
    return lists.select("user_id", F.to_json(F.struct("data", meta)).alias("body"))


def chained_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages that each name the next one; some are missing, some failed, some are stored twice."""
    order = F.col("o_orderkey")
    by_user = Window.partitionBy("o_custkey").orderBy(order)
    after = F.lead(order).over(by_user)
    token = F.when(after.isNotNull(), F.concat(F.lit(',"next_token":"t'), after.cast("string"), F.lit('"'))).otherwise("")
    body = F.concat(F.lit('{"data":[{"id":"'), order.cast("string"), F.lit('"}],"meta":{"result_count":1'), token, F.lit("}}"))
    failed = F.when(order % 97 == 0, '{"errors":[{"value":"1","detail":"Over capacity"}]}').otherwise(body)
    pages = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.lag(order).over(by_user).isNotNull(), F.concat(F.lit("t"), order.cast("string"))).alias("token"),
        failed.alias("body"),
        order.alias("n"),
    )
    kept = pages.filter("n % 67 <> 5")
    return kept.unionByName(kept.filter("n % 5 = 0")).drop("n")


def broken_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Documents as lines of JSON or of tab-separated fields, four in nine of them broken in different ways, one blank."""
    doc, user = F.col("doc_id"), F.col("doc_id") % 50
    if kind == "json":
        good = F.to_json(F.struct(doc.alias("id"), user.alias("user_id"), "text"))
        broken = ('{"id": %1$d, "user_id": 3, "te', '{"id": "none %1$d", "user_id": 3, "text": "x"}', '{"user_id": %1$d, "text": "orphan"}', "line %1$d is no JSON")
    else:
        text = line_breaks.escaped(F.col("text")).alias("text")
        good = F.to_csv(F.struct(doc.alias("id"), user.alias("user_id"), text), {"sep": "\t", "escape": '"'})
        broken = ("%1$d", "none %1$d\t3\tx", "\t%1$d\torphan", "%1$d\t3\tx\tmore")
    line = F.when(doc % 9 == 4, "")
    for n, template in enumerate(broken):
        line = line.when(doc % 9 == n, F.format_string(template, doc))
    return table(spark, sf_dir, "documents").select(line.otherwise(good).alias("value"))
