"""Every table's schema in one place, as DDL text; nothing is inferred from data."""

from __future__ import annotations

STREAM_POSTS = (
    "id BIGINT, text STRING, user STRUCT<id: BIGINT, screen_name: STRING, description: STRING>, ds STRING"
)
PANEL_POSTS = (
    "id BIGINT, user STRUCT<id: BIGINT>, full_text STRING, created_at_bucket STRING, user_id_bucket INT"
)
RAW_POSTS = "id BIGINT, user_id BIGINT, text STRING"
MATCHED_BIOS = "user_id BIGINT, user_screen_name STRING, user_bio STRING, ds STRING"
LABELED_BIOS = (
    "user_id BIGINT, user_screen_name STRING, user_bio STRING,"
    " age_pattern STRING, age_label STRING, gender_pattern STRING, gender_label STRING"
)
VALIDATION_AGE = "user_id BIGINT, age_group STRING, age_label STRING, age_pattern STRING"
VALIDATION_GENDER = "user_id BIGINT, gender_pattern STRING, gender_label STRING"
POST_EMBEDDINGS = "id BIGINT, user_id BIGINT, user_id_bucket INT, embed ARRAY<DOUBLE>"
ANNOTATIONS = "user_id BIGINT, gender_1 STRING, gender_2 STRING, age_1 DOUBLE, age_2 DOUBLE"
PANEL_SAMPLE = "user_id BIGINT, sex STRING, birth_date DATE"
PANEL_5K = "panel_uid BIGINT, gender STRING, age INT"
PREDICTIONS = (
    "id STRING, `age_<=18` DOUBLE, `age_19-29` DOUBLE, `age_30-39` DOUBLE, `age_>=40` DOUBLE,"
    " gender_male DOUBLE, gender_female DOUBLE"
)
USER_PROFILES = (
    "uid STRING, name STRING, screen_name STRING, description STRING, profile_image_url_https STRING"
)
MODEL_INPUT = (
    "id_str STRING, profile_image_url_https STRING, description STRING, name STRING, screen_name STRING,"
    " default_profile_image BOOLEAN"
)
FOLLOW_EDGES = "user_id BIGINT, followee_id BIGINT"

# Items of ``data`` in stored API responses.
EDGE_ITEM = "STRUCT<id: STRING>"
USER_ITEM = (
    "STRUCT<id: STRING, username: STRING, name: STRING, description: STRING, created_at: STRING, location: STRING,"
    " profile_image_url: STRING, protected: BOOLEAN, verified: BOOLEAN, url: STRING,"
    " public_metrics: STRUCT<followers_count: BIGINT, following_count: BIGINT, tweet_count: BIGINT, listed_count: BIGINT>,"
    " withheld: STRUCT<country_codes: ARRAY<STRING>, scope: STRING>>"
)
POST_ITEM = (
    "STRUCT<id: STRING, text: STRING, created_at: STRING, conversation_id: STRING, in_reply_to_user_id: STRING,"
    " lang: STRING,"
    " public_metrics: STRUCT<retweet_count: BIGINT, reply_count: BIGINT, like_count: BIGINT, quote_count: BIGINT>>"
)


def response_schema(item: str) -> str:
    """Schema of a response body whose ``data`` list holds ``item``."""
    return (
        f"data ARRAY<{item}>, errors ARRAY<STRUCT<value: STRING, detail: STRING>>,"
        " meta STRUCT<result_count: BIGINT, next_token: STRING>"
    )
