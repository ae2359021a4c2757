"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from panelforge.plans.catalog import AGE_TODAY, ANNOTATED_ON, CALENDAR
from panelforge.plans.testdata import BIOS, BUSY_AUTHOR
from panelforge.rules import AGE_BINS, DEFAULT_PROFILE_IMAGE, INTENDED, LITERAL, RuleSet

DIM = 32


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _bio(position: str) -> str:
    return f"([{', '.join(_text(b) for b in BIOS)}])[({position}) % {len(BIOS)} + 1]"


def _match(rule) -> str:
    return f"regexp_matches(user_bio, {_text(rule.regex)})"


def _case(rules, value, marker: str) -> str:
    whens = " ".join(f"WHEN {_match(r)} THEN {value(r)}" for r in rules)
    return f"CASE {whens} ELSE '{marker}' END"


POSTS = f"""posts AS (
    SELECT event_id AS id, concat_ws(' ', event_type, props) AS text, user_id,
           concat('user_', user_id) AS user_screen_name, {_bio('user_id * 7 + event_id % 3')} AS user_bio,
           strftime(ts, '%Y-%m-%d') AS ds
    FROM events)"""


def _matched(rules: RuleSet) -> str:
    condition = " OR ".join(_match(r) for r in rules.first_stage())
    return f"{POSTS}, matched AS (SELECT user_id, user_screen_name, user_bio, ds FROM posts WHERE {condition})"


def _labeled(rules: RuleSet = INTENDED) -> str:
    return f"""{_matched(rules)}, labeled AS (
    SELECT user_id, user_screen_name, user_bio,
        {_case(rules.age, lambda r: f"'{r.name}'", 'unlabeled_age')} AS age_pattern,
        {_case(rules.age, lambda r: f"regexp_extract(user_bio, {_text(r.regex)}, 1)", 'unlabeled_age')} AS age_label,
        {_case(rules.gender, lambda r: f"'{r.name}'", 'unlabeled_gender')} AS gender_pattern,
        {_case(rules.gender, lambda r: f"'{r.label}'", 'unlabeled_gender')} AS gender_label
    FROM (SELECT DISTINCT user_bio, user_id, user_screen_name FROM matched))"""


def _grouped() -> str:
    return f"""{_labeled()}, aged AS (
    SELECT *, CASE WHEN age_label = 'unlabeled_age' THEN NULL WHEN length(age_label) = 4
        THEN 2021 - CAST(age_label AS INTEGER) ELSE CAST(age_label AS INTEGER) END AS age
    FROM labeled), grouped AS (
    SELECT * EXCLUDE (age), CASE WHEN age <= 18 THEN '<=18' WHEN age < 30 THEN '(18-30)' WHEN age < 40 THEN '[30-40)'
        ELSE '[40-99)' END AS age_group
    FROM aged WHERE age >= 8 AND age < 99)"""


DOCUMENT_POSTS = f"""document_posts AS (
    SELECT doc_id AS id, CAST(CASE WHEN doc_id % 3 = 0 THEN {BUSY_AUTHOR} ELSE doc_id END AS BIGINT) AS user_id, text,
           strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS ds
    FROM documents)"""
FOLLOWEES = """followees AS (
    SELECT c_custkey AS followee_uid FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE'))"""
PANEL_UIDS = "panel AS (SELECT c_custkey AS panel_uid FROM customer WHERE c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE'))"


def _vectors(source: str, keys: str, text: str = "text") -> str:
    """CTEs that end in ``vectors`` with one row per value; ``source`` has one row per id."""
    return f"""tokens AS (
    SELECT id, unnest(regexp_split_to_array({text}, '\\s+')) AS token FROM {source}),
    slots AS (SELECT id, CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % {DIM} AS pos, count(*) AS n
              FROM tokens WHERE token <> '' GROUP BY ALL),
    norms AS (SELECT id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM slots GROUP BY id),
    grid AS (SELECT {keys}, CAST(unnest(range({DIM})) AS INTEGER) AS pos FROM {source}),
    vectors AS (SELECT g.*, round(coalesce(s.n / m.norm, 0), 6) AS value
                FROM grid g LEFT JOIN slots s ON s.id = g.id AND s.pos = g.pos LEFT JOIN norms m ON m.id = g.id)"""


PREDICTIONS = """predictions AS (
    SELECT CASE WHEN c_custkey % 8 = 3 THEN c_custkey + 10000000 ELSE c_custkey END AS id, (c_custkey * 7) % 11 AS s0, (c_custkey * 5) % 13 AS s1, (c_custkey * 3) % 17 AS s2,
           (c_custkey * 2) % 19 AS s3, (c_custkey * 13) % 101 AS male, 100 - (c_custkey * 13) % 101 AS female
    FROM customer)"""
DECODED = f"""{PREDICTIONS}, ranged AS (
    SELECT id, CASE WHEN male >= female THEN 'Male' ELSE 'Female' END AS pred_gender,
        CASE WHEN s0 >= s1 AND s0 >= s2 AND s0 >= s3 THEN '0-18' WHEN s1 >= s2 AND s1 >= s3 THEN '19-29'
             WHEN s2 >= s3 THEN '30-39' ELSE '40-999' END AS pred_age_range
    FROM predictions), decoded AS (
    SELECT *, CAST(split_part(pred_age_range, '-', 1) AS INTEGER) AS min_age,
              CAST(split_part(pred_age_range, '-', 2) AS INTEGER) AS max_age FROM ranged)"""


def _age_on(date: str) -> str:
    return (
        f"CAST(year(DATE '{date}') - year(birth_date) - CASE WHEN (month(DATE '{date}'), day(DATE '{date}')) <"
        " (month(birth_date), day(birth_date)) THEN 1 ELSE 0 END AS INTEGER)"
    )


SAMPLE = f"""sample AS (
    SELECT *, {_age_on(AGE_TODAY)} AS real_age, {_age_on(ANNOTATED_ON)} AS age_then FROM (
        SELECT c_custkey AS user_id,
            CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
            CASE WHEN c_custkey % 97 = 0 THEN DATE '2000-02-29' WHEN c_custkey % 11 = 0 THEN NULL
                 ELSE DATE '1940-01-01' + CAST((c_custkey * 37) % 27000 AS INTEGER) END AS birth_date
        FROM customer WHERE c_mktsegment <> 'MACHINERY'))"""
PANEL_5K = """panel5k AS (
    SELECT c_custkey AS panel_uid,
        CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'Male' ELSE 'Female' END AS gender,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey * 37) % 80 END AS age
    FROM customer WHERE c_acctbal > 0)"""
ANNOTATIONS = """annotations AS (
    SELECT * FROM (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'F' END AS gender_1,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'M' END AS gender_2,
        CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 10 + (c_custkey * 7) % 45 END AS DOUBLE) AS age_1,
        CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 10 + (c_custkey * 7) % 45 + c_custkey % 3 - 1 END AS DOUBLE)
            AS age_2
    FROM customer WHERE c_mktsegment <> 'HOUSEHOLD') WHERE gender_1 IS NOT NULL OR gender_2 IS NOT NULL)"""


def _bin(age: str, null_bin: str | None) -> str:
    whens = " ".join(f"WHEN {age} <= {upper} THEN '{name}'" for upper, name in AGE_BINS if upper is not None)
    return f"CASE WHEN {age} IS NULL THEN {_text(null_bin)} {whens} ELSE '{AGE_BINS[-1][1]}' END"


def _agreement(null_bin: str | None = None) -> str:
    first, second, then = (_bin(a, null_bin) for a in ("age_1", "age_2", "age_then"))
    return f"""{SAMPLE}, {ANNOTATIONS}, agreement AS (
    SELECT *, coalesce({first} = {second} AND {first} = {then}, FALSE) AS annot_goodness
    FROM annotations JOIN sample USING (user_id) WHERE user_id % 8 <> 3)"""


_ACCURACY = """count(*) AS joined_rows,
    round(avg(CASE WHEN {gender} = pred_gender THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS gender_accuracy,
    round(avg(CASE WHEN min_age > {age} OR max_age < {age} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS age_accuracy"""

PROFILES = f"""profiles AS (
    SELECT CAST(c_custkey AS VARCHAR) AS uid, c_name AS name, concat('user_', c_custkey) AS screen_name,
        {_bio('c_custkey')} AS description,
        CASE WHEN c_custkey % 4 = 0 THEN {_text(DEFAULT_PROFILE_IMAGE)} WHEN c_custkey % 9 = 0 THEN NULL
             ELSE concat('https://img.example/', c_custkey, '.jpg') END AS profile_image_url_https
    FROM customer)"""
_DEFAULT_IMAGE = f"coalesce(profile_image_url_https = {_text(DEFAULT_PROFILE_IMAGE)}, FALSE)"

FOLLOW_RESPONSES = """follow_responses AS (
    SELECT c_custkey AS user_id, CAST(CASE c_custkey % 6
        WHEN 0 THEN format('{{"data":[{{"id":"{}"}},{{"id":"{}"}}],"meta":{{"result_count":2,"next_token":"t{}"}}}}',
                           c_custkey + 1, c_custkey + 2, c_custkey)
        WHEN 1 THEN '{"meta":{"result_count":0}}'
        WHEN 2 THEN format('{{"errors":[{{"value":"{}","detail":"Could not find user with id: [{}]."}}]}}',
                           c_custkey, c_custkey)
        WHEN 3 THEN format('{{"data":[{{"id":"{}"}}],"errors":[{{"value":"{}","detail":"Partly hidden"}}]}}',
                           c_custkey + 1, c_custkey)
        WHEN 4 THEN '{"meta":{}}'
        ELSE format('{{"data":[{{"id":"{}"}}],"meta":{{"result_count":1}}}}', c_custkey + 3) END AS JSON) AS body
    FROM customer),
    classified AS (SELECT *, CASE WHEN json_array_length(body, '$.errors') > 0 THEN 'error'
        WHEN json_exists(body, '$.data') THEN 'data' WHEN CAST(json_extract_string(body, '$.meta.result_count') AS BIGINT) = 0 THEN 'empty'
        ELSE 'unknown' END AS outcome FROM follow_responses),
    edges AS (SELECT user_id, CAST(unnest(from_json(json_extract(body, '$.data'), '[{"id":"VARCHAR"}]')).id AS BIGINT) AS followee_id
        FROM classified WHERE outcome = 'data'),
    errors AS (SELECT user_id, regexp_replace(json_extract_string(body, '$.errors[0].detail'), '\\[.*', '') AS detail
        FROM classified WHERE outcome = 'error')"""


def _select(ctes: str, query: str) -> str:
    return f"WITH {ctes} {query}"


def _day_sums() -> str:
    return _select(
        f"{DOCUMENT_POSTS}, {_vectors('document_posts', 'id, ds')}",
        """SELECT ds, count(*) AS n_posts, CAST(sum(id) AS BIGINT) AS id_sum, round(sum(exact), 4) AS first_value_sum
           FROM (SELECT g.id, g.ds, coalesce(s.n / m.norm, 0) AS exact FROM grid g
                 LEFT JOIN slots s ON s.id = g.id AND s.pos = 0 LEFT JOIN norms m ON m.id = g.id WHERE g.pos = 0)
           GROUP BY ds""",
    )


LABEL_COLUMNS = "user_id, user_screen_name, user_bio, age_pattern, age_label, gender_pattern, gender_label"

def _rejected_lines(line: str) -> str:
    return f"""
        SELECT doc_id AS id, doc_id % 50 AS user_id, text, NULL AS reason FROM documents WHERE doc_id % 9 > 4
        UNION ALL
        SELECT NULL, NULL, {line}, CASE WHEN doc_id % 9 = 2 THEN 'no id' ELSE 'unreadable' END FROM documents WHERE doc_id % 9 < 4"""


_DISTINCT_LABELS = _select(_labeled(), f"SELECT {LABEL_COLUMNS} FROM labeled")


ORACLE: dict[str, str] = {
    "bio_match_any": _select(_matched(INTENDED), "SELECT * FROM matched"),
    "posts_day_range": _select(
        POSTS, "SELECT ds, count(*) AS n FROM posts WHERE ds > '2024-01-09' AND ds <= '2024-01-31' GROUP BY ds"
    ),
    "posts_on_day": _select(POSTS, "SELECT id, user_id, text, ds FROM posts WHERE ds = '2024-01-16'"),
    "bio_distinct": _select(_matched(INTENDED), "SELECT DISTINCT user_bio, user_id, user_screen_name FROM matched"),
    "bio_distinct_counts": _select(
        _matched(INTENDED),
        """SELECT (SELECT count(*) FROM matched) AS total_rows,
                  (SELECT count(*) FROM (SELECT DISTINCT user_bio, user_id, user_screen_name FROM matched))
                      AS distinct_rows""",
    ),
    "bio_labels_intended": _select(_labeled(), f"SELECT {LABEL_COLUMNS} FROM labeled"),
    "bio_labels_literal": _select(_labeled(LITERAL), f"SELECT {LABEL_COLUMNS} FROM labeled"),
    "gender_pattern_counts_female": _select(
        _labeled(), "SELECT gender_pattern, count(*) AS n FROM labeled WHERE gender_label = 'FEMALE' GROUP BY 1"
    ),
    "gender_pattern_counts_male": _select(
        _labeled(), "SELECT gender_pattern, count(*) AS n FROM labeled WHERE gender_label = 'MALE' GROUP BY 1"
    ),
    "female_pattern_7_bios": _select(
        _labeled(), "SELECT user_id, user_bio FROM labeled WHERE gender_pattern = 'gender_pattern_7'"
    ),
    "age_pattern_counts": _select(_labeled(), "SELECT age_pattern, count(*) AS n FROM labeled GROUP BY 1"),
    "age_label_counts_sorted": _select(
        _labeled(), "SELECT age_label, count(*) AS n FROM labeled GROUP BY 1 ORDER BY 1"
    ),
    "age_label_preview": _select(
        _labeled(), "SELECT age_label, count(*) AS n, row_number() OVER (ORDER BY age_label) AS place FROM labeled GROUP BY 1 ORDER BY 1 LIMIT 5"
    ),
    "age_groups": _select(_grouped(), f"SELECT {LABEL_COLUMNS}, age_group FROM grouped"),
    "age_groups_sql": _select(_grouped(), "SELECT user_id, age_label, age_group FROM grouped"),
    "age_group_counts": _select(_grouped(), "SELECT age_group, count(*) AS n FROM grouped GROUP BY 1"),
    "age_gender_overlap": _select(
        _grouped(), "SELECT age_pattern, gender_pattern, count(*) AS n FROM grouped GROUP BY 1, 2"
    ),
    "age_gender_cross_table": _select(
        _grouped(),
        """SELECT age_pattern, count(*) FILTER (gender_label = 'MALE') AS "MALE",
               count(*) FILTER (gender_label = 'FEMALE') AS "FEMALE",
               count(*) FILTER (gender_label = 'unlabeled_gender') AS unlabeled_gender
           FROM grouped GROUP BY 1""",
    ),
    "validation_age_export": _select(_grouped(), "SELECT user_id, age_group, age_label, age_pattern FROM grouped"),
    "validation_gender_export": _select(
        _labeled(),
        "SELECT user_id, gender_pattern, gender_label FROM labeled WHERE gender_pattern <> 'unlabeled_gender'",
    ),
    "id_bucket_filter": """
        SELECT c_custkey AS uid, CAST(c_custkey % 40 AS INTEGER) AS user_id_bucket FROM customer
        WHERE c_custkey % 40 BETWEEN 0 AND 19""",
    "posts_for_followees": _select(
        f"{POSTS}, {FOLLOWEES}",
        """SELECT DISTINCT id, user_id, text, CAST(user_id % 40 AS INTEGER) AS user_id_bucket
           FROM posts JOIN followees ON followee_uid = user_id""",
    ),
    "posts_for_panel": _select(
        f"{POSTS}, {PANEL_UIDS}",
        """SELECT id, user_id, text AS full_text, CAST(user_id % 40 AS INTEGER) AS user_id_bucket
           FROM posts JOIN panel ON panel_uid = user_id""",
    ),
    "post_embeddings": _select(
        f"""{DOCUMENT_POSTS}, {FOLLOWEES}, kept AS (
            SELECT DISTINCT id, user_id, text, CAST(user_id % 40 AS INTEGER) AS user_id_bucket
            FROM document_posts JOIN followees ON followee_uid = user_id),
            {_vectors('kept', 'id, user_id, user_id_bucket')}""",
        "SELECT id, user_id, user_id_bucket, pos, value FROM vectors",
    ),
    "panel_embeddings": _select(
        f"""{POSTS}, {PANEL_UIDS}, kept AS (
            SELECT id, user_id, text AS full_text, CAST(user_id % 40 AS INTEGER) AS user_id_bucket
            FROM posts JOIN panel ON panel_uid = user_id),
            {_vectors('kept', 'id, user_id, full_text, user_id_bucket', 'full_text')}""",
        "SELECT id, user_id, full_text, user_id_bucket, pos, value FROM vectors",
    ),
    "embed_batches_udf": _select(
        f"{DOCUMENT_POSTS}, {_vectors('document_posts', 'id')}", "SELECT id, pos, value FROM vectors"
    ),
    "embed_token_budget": _select(
        f"{DOCUMENT_POSTS}, {_vectors('document_posts', 'id')}", "SELECT id, pos, value FROM vectors"
    ),
    "embed_shipped_model": _select(
        f"{DOCUMENT_POSTS}, {_vectors('document_posts', 'id')}, held AS (SELECT pos, count(*) AS df FROM slots GROUP BY pos)",
        """SELECT p.id, round(coalesce(CAST(sum(n * df) AS DOUBLE) / sum(n), 0), 6) AS mean_weight, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens
           FROM document_posts p LEFT JOIN slots s ON s.id = p.id LEFT JOIN held h ON h.pos = s.pos GROUP BY p.id""",
    ),
    "api_page_chains": """
        WITH pages AS (
            SELECT o_custkey AS user_id, o_orderkey % 67 <> 5 AS stored, o_orderkey % 67 <> 5 AND o_orderkey % 97 <> 0 AS good,
                   lag(o_orderkey) OVER own AS before,
                   lag(o_orderkey % 67 <> 5 AND o_orderkey % 97 <> 0) OVER own AS linked
            FROM orders WINDOW own AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT user_id, count(*) FILTER (stored) AS n_pages, count(*) FILTER (NOT good AND (before IS NULL OR linked)) AS n_gaps,
               count(*) FILTER (stored AND NOT linked) AS n_stray, bool_and(good) AS is_complete
        FROM pages GROUP BY user_id HAVING bool_or(stored)""",
    "embed_increment": _day_sums(),
    "embed_increment_by_id": _day_sums(),
    "embed_bucket_halves": _day_sums(),
    "embed_grown_id_list": _day_sums(),
    "embed_followee_job": _select(
        f"{POSTS}, {FOLLOWEES}",
        """SELECT ds, CAST(user_id % 40 AS INTEGER) AS user_id_bucket, count(*) AS n_posts, CAST(sum(id) AS BIGINT) AS id_sum
           FROM posts JOIN followees ON followee_uid = user_id WHERE ds BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY 1, 2""",
    ),
    "snapshot_crash": _select(
        f"""{POSTS}, before AS (SELECT ds, count(*) AS n_posts, CAST(sum(id) AS BIGINT) AS id_sum FROM posts GROUP BY 1)""",
        """SELECT *, 'before' AS moment FROM before UNION ALL SELECT *, 'crashed' FROM before UNION ALL
           SELECT ds, n_posts, CASE WHEN ds BETWEEN '2024-01-10' AND '2024-01-19' THEN id_sum + n_posts * 1000000 ELSE id_sum END, 'rerun'
           FROM before WHERE ds <> '2024-01-12'""",
    ),
    "stream_distinct_bios": _DISTINCT_LABELS,
    "json_rejects": _rejected_lines(
        """CASE doc_id % 9 WHEN 0 THEN '{"id": ' || doc_id || ', "user_id": 3, "te'
           WHEN 1 THEN '{"id": "none ' || doc_id || '", "user_id": 3, "text": "x"}'
           WHEN 2 THEN '{"user_id":' || doc_id || ',"text":"orphan"}' ELSE 'line ' || doc_id || ' is no JSON' END"""
    ),
    "tsv_rejects": _rejected_lines(
        """CASE doc_id % 9 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'none ' || doc_id || chr(9) || '3' || chr(9) || 'x'
           WHEN 2 THEN '{"user_id":' || doc_id || ',"text":"orphan"}' ELSE doc_id || chr(9) || '3' || chr(9) || 'x' || chr(9) || 'more' END"""
    ),
    "reject_accounts": """
        SELECT format, count(*) FILTER (doc_id % 9 <> 4) AS n_lines, count(*) FILTER (doc_id % 9 > 4) AS n_rows,
               count(*) FILTER (doc_id % 9 < 4) AS n_rejects, true AS adds_up
        FROM documents, (VALUES ('json'), ('tsv')) AS f(format) GROUP BY format""",
    "rejected_id_lines": "SELECT 'n/a ' || c_custkey AS line FROM customer WHERE c_custkey % 50 = 0",
    "work_calendar_gaps": f"""
        SELECT ds, user_id_bucket FROM (
            SELECT strftime(day, '%Y-%m-%d') AS ds, CAST(unnest(range(40)) AS INTEGER) AS user_id_bucket
            FROM (SELECT unnest(generate_series(DATE '{CALENDAR[0]}', DATE '{CALENDAR[1]}', INTERVAL 1 DAY)) AS day))
        EXCEPT SELECT strftime(ts, '%Y-%m-%d'), CAST(user_id % 40 AS INTEGER) FROM events""",
    "decode_predictions": _select(DECODED, "SELECT id, pred_gender, pred_age_range, min_age, max_age FROM decoded"),
    "exact_age": _select(SAMPLE, "SELECT user_id, real_age FROM sample"),
    "panel_with_predictions": _select(
        f"{DECODED}, {SAMPLE}",
        """SELECT user_id, sex, real_age, pred_gender, pred_age_range, min_age, max_age
           FROM sample JOIN decoded ON id = user_id""",
    ),
    "panel_accuracy": _select(
        f"{DECODED}, {SAMPLE}",
        f"SELECT {_ACCURACY.format(gender='sex', age='real_age')} FROM sample JOIN decoded ON id = user_id",
    ),
    "panel5k_accuracy": _select(
        f"{DECODED}, {PANEL_5K}",
        f"SELECT {_ACCURACY.format(gender='gender', age='age')} FROM panel5k JOIN decoded ON id = panel_uid",
    ),
    "annotation_filter": _select(ANNOTATIONS, "SELECT * FROM annotations"),
    "annotation_agreement": _select(_agreement(), "SELECT user_id, age_1, age_2, annot_goodness FROM agreement"),
    "annotation_agreement_old_bin": _select(
        _agreement("age_>=40"), "SELECT user_id, age_1, age_2, annot_goodness FROM agreement"
    ),
    "agreement_counts": _select(_agreement(), "SELECT annot_goodness, count(*) AS n FROM agreement GROUP BY 1"),
    "agreed_accuracy": _select(
        f"{DECODED}, {_agreement()}",
        """SELECT count(*) AS agreed_rows,
               round(avg(CASE WHEN min_age > real_age OR max_age < real_age THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6)
                   AS age_accuracy
           FROM agreement JOIN decoded ON id = user_id WHERE annot_goodness""",
    ),
    "default_image_flag": _select(PROFILES, f"SELECT uid, {_DEFAULT_IMAGE} AS default_profile_image FROM profiles"),
    "predict_table": _select(
        f"""{PROFILES}, people AS (
            SELECT CAST(uid AS BIGINT) AS id, length(name) AS n, length(coalesce(description, '')) AS t,
                   CASE WHEN {_DEFAULT_IMAGE} THEN 1 ELSE 0 END AS i FROM profiles),
            scores AS (SELECT id, (id * 7 + t) % 11 AS s0, (id * 5 + n) % 13 AS s1, (id * 3 + i) % 17 AS s2,
                (id * 2) % 19 AS s3, (id * 13 + n) % 101 AS male FROM people),
            ranged AS (SELECT *, CASE WHEN male >= 100 - male THEN 'Male' ELSE 'Female' END AS pred_gender,
                CASE WHEN s0 >= s1 AND s0 >= s2 AND s0 >= s3 THEN '0-18' WHEN s1 >= s2 AND s1 >= s3 THEN '19-29'
                     WHEN s2 >= s3 THEN '30-39' ELSE '40-999' END AS pred_age_range FROM scores)""",
        """SELECT id, CAST(s0 AS DOUBLE) AS "age_<=18", CAST(s1 AS DOUBLE) AS "age_19-29",
               CAST(s2 AS DOUBLE) AS "age_30-39", CAST(s3 AS DOUBLE) AS "age_>=40",
               CAST(male AS DOUBLE) AS gender_male, CAST(100 - male AS DOUBLE) AS gender_female,
               pred_gender, pred_age_range, CAST(split_part(pred_age_range, '-', 1) AS INTEGER) AS min_age,
               CAST(split_part(pred_age_range, '-', 2) AS INTEGER) AS max_age
           FROM ranged""",
    ),
    "union_results": _select(
        f"{DECODED}, {SAMPLE}, {PANEL_5K}",
        """SELECT id, pred_gender, pred_age_range FROM decoded WHERE id IN (SELECT panel_uid FROM panel5k)
           UNION ALL
           SELECT id, pred_gender, pred_age_range FROM decoded WHERE id IN (SELECT user_id FROM sample)""",
    ),
    "api_outcomes": _select(FOLLOW_RESPONSES, "SELECT user_id, outcome FROM classified"),
    "api_outcome_counts": _select(FOLLOW_RESPONSES, "SELECT outcome, count(*) AS n FROM classified GROUP BY 1"),
    "api_errors_first": _select(FOLLOW_RESPONSES, "SELECT user_id, detail FROM errors"),
    "api_errors_all": """
        SELECT c_custkey AS user_id, concat('Could not find user with ids: [', c_custkey, '].') AS detail
        FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 4 = 0""",
    "api_users": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS id, concat('user_', c_custkey) AS username, c_name AS name,
               {_bio('c_custkey')} AS description, '2020-01-01T00:00:00.000Z' AS created_at, c_mktsegment AS location,
               c_custkey % 2 = 0 AS protected, c_custkey % 5 = 0 AS verified,
               c_custkey % 100 AS followers_count, c_custkey % 70 AS following_count, c_custkey % 60 AS tweet_count,
               c_custkey % 7 AS listed_count, concat('https://img.example/', c_custkey, '.jpg') AS profile_image_url,
               CASE WHEN c_custkey % 3 = 0 THEN concat('https://example.org/', c_custkey) END AS url,
               CASE WHEN c_custkey % 50 = 0 THEN 'DE,FR' END AS withheld_in,
               CASE WHEN c_custkey % 50 = 0 THEN 'user' END AS withheld_scope
        FROM customer WHERE c_custkey % 9 <> 0""",
    "follow_edges": _select(FOLLOW_RESPONSES, "SELECT user_id, followee_id FROM edges"),
    "api_next_tokens": _select(
        FOLLOW_RESPONSES, "SELECT user_id, json_extract_string(body, '$.meta.next_token') AS next_token FROM classified"
    ),
    "api_pages_edges": "SELECT DISTINCT o_custkey AS user_id, o_orderkey % 50 AS followee_id FROM orders WHERE o_orderkey % 97 > 2",
    "api_pages_complete": """
        SELECT o_custkey AS user_id, count(*) AS n_pages,
               min(o_orderkey % 97) > 2 AND bool_or(coalesce(o_orderstatus, '') <> 'O') AS is_complete
        FROM orders GROUP BY 1""",
    "api_posts": """
        SELECT conv_id AS user_id, conv_id * 1000 + turn AS id, text, '2024-01-01T00:00:00.000Z' AS created_at,
               conv_id AS conversation_id, CASE WHEN turn > 0 THEN conv_id END AS in_reply_to_user_id, 'en' AS lang,
               turn AS reply_count, length(text) AS like_count, (conv_id * 1000 + turn) % 7 AS retweet_count,
               (conv_id * 1000 + turn) % 3 AS quote_count
        FROM conversations""",
    "routed_outcomes": _select(
        FOLLOW_RESPONSES,
        """SELECT 'data' AS outcome, user_id, followee_id, NULL AS detail FROM edges
           UNION ALL SELECT 'error', user_id, NULL, detail FROM errors
           UNION ALL SELECT outcome, user_id, NULL, NULL FROM classified WHERE outcome IN ('empty', 'unknown')""",
    ),
    "resume_ids": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "id_batches_100": """
        SELECT batch_no, count(*) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids
        FROM (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS place,
                     CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS batch_no FROM customer)
        GROUP BY batch_no""",
    "json_by_day_round_trip": _select(_matched(INTENDED), "SELECT * FROM matched"),
    "labels_json_round_trip": _select(_labeled(), f"SELECT {LABEL_COLUMNS} FROM labeled"),
    "posts_json_scan": _select(POSTS, "SELECT id, user_id, text, ds FROM posts"),
    "panel_partition_scan": """
        WITH parts AS (
            SELECT concat(strftime(ts, '%Y-%m-'), CASE WHEN day(ts) < 16 THEN '01' ELSE '16' END) AS created_at_bucket,
                   CAST(user_id % 40 AS INTEGER) AS user_id_bucket, count(*) AS n FROM events GROUP BY ALL)
        SELECT *, 'all' AS scan FROM parts
        UNION ALL SELECT *, 'one' FROM parts WHERE created_at_bucket = '2024-01-16' AND user_id_bucket = 7""",
    "raw_posts_any_format": _select(DOCUMENT_POSTS, "SELECT id, user_id, text FROM document_posts"),
    "bios_tsv_round_trip": _select(
        PROFILES,
        """SELECT uid, concat(coalesce(description, 'none'), chr(9), '"', uid, '"', chr(13), chr(10), '\\n ') AS description, breaks
           FROM profiles, (VALUES ('quoted'), ('escaped')) AS ways(breaks)""",
    ),
    "replaced_days": _select(_matched(INTENDED), "SELECT * FROM matched WHERE ds NOT IN ('2024-01-12', '2024-01-16')"),
    "embedding_csv_export": _select(
        f"{DOCUMENT_POSTS}, {_vectors('document_posts', 'id, user_id')}", "SELECT id, user_id, pos, value FROM vectors"
    ),
    "predictions_csv_round_trip": _select(
        PREDICTIONS,
        """SELECT CAST(id AS VARCHAR) AS id, CAST(s0 AS DOUBLE) AS "age_<=18", CAST(s1 AS DOUBLE) AS "age_19-29",
               CAST(s2 AS DOUBLE) AS "age_30-39", CAST(s3 AS DOUBLE) AS "age_>=40",
               CAST(male AS DOUBLE) AS gender_male, CAST(female AS DOUBLE) AS gender_female
           FROM predictions""",
    ),
    "profiles_to_json_lines": _select(
        PROFILES,
        f"""SELECT uid AS id_str, profile_image_url_https, nullif(description, '') AS description, name, screen_name,
                   {_DEFAULT_IMAGE} AS default_profile_image FROM profiles""",
    ),
    "stream_bio_labels": _select(
        _matched(INTENDED),
        f"""SELECT user_id, user_screen_name, user_bio, ds,
            {_case(INTENDED.age, lambda r: f"'{r.name}'", 'unlabeled_age')} AS age_pattern,
            {_case(INTENDED.age, lambda r: f"regexp_extract(user_bio, {_text(r.regex)}, 1)", 'unlabeled_age')} AS age_label,
            {_case(INTENDED.gender, lambda r: f"'{r.name}'", 'unlabeled_gender')} AS gender_pattern,
            {_case(INTENDED.gender, lambda r: f"'{r.label}'", 'unlabeled_gender')} AS gender_label
        FROM matched""",
    ),
}
