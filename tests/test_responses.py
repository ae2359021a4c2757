import pytest
from conftest import rows

from panelforge.operators import responses

BODIES = [
    (1, '{"data":[{"id":"11"},{"id":"12"}],"meta":{"result_count":2,"next_token":"n1"}}'),
    (2, '{"meta":{"result_count":0}}'),
    (3, '{"errors":[{"value":"3","detail":"Could not find user with id: [3]."},{"value":"4","detail":"b"}]}'),
    (4, '{"data":[{"id":"13"}],"errors":[{"value":"4","detail":"no bracket"}]}'),
    (5, '{"meta":{}}'),
    (6, '{"data":[{"id":"14"}],"errors":[],"meta":{"result_count":1}}'),
    (7, '{"data":[]}'),
    (8, "not json"),
    (9, None),
    (1, '{"data":[{"id":"12"},{"id":"15"}],"meta":{"result_count":2}}'),
]


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(BODIES, "user_id BIGINT, body STRING")


def test_outcomes_cover_every_response(stored):
    assert rows(responses.response_outcomes(stored)) == [
        (1, "data"), (1, "data"), (2, "empty"), (3, "error"), (4, "error"), (5, "unknown"), (6, "data"), (7, "data"),
        (8, "unknown"), (9, "unknown"),
    ]


def test_edges_skip_responses_with_errors(stored):
    assert rows(responses.follow_edges(stored)) == [(1, 11), (1, 12), (1, 12), (1, 15), (6, 14)]


def test_edges_over_pages_are_a_set(stored):
    assert rows(responses.edges_over_pages(stored)) == [(1, 11), (1, 12), (1, 15), (6, 14)]


def test_page_status(stored):
    status = {r.user_id: (r.n_pages, r.is_complete) for r in responses.page_status(stored).collect()}
    assert status[1] == (2, True) and status[2] == (1, True)
    first_page_only = stored.filter("body LIKE '%next_token%'")
    assert rows(responses.page_status(first_page_only)) == [(1, 1, False)]


def test_first_errors_are_cut_at_the_bracket(stored):
    assert rows(responses.first_errors(stored)) == [(3, "Could not find user with id: "), (4, "no bracket")]


def test_all_errors_keep_their_text(stored):
    assert rows(responses.all_errors(stored)) == [
        (3, "Could not find user with id: [3]."), (4, "b"), (4, "no bracket"),
    ]


def test_users_are_kept_beside_errors(stored):
    assert rows(responses.users_from_responses(stored), "id") == [("11",), ("12",), ("12",), ("13",), ("14",), ("15",)]


def test_next_tokens(stored):
    assert [r for r in rows(responses.next_tokens(stored)) if r[1]] == [(1, "n1")]


def test_routed_rows(stored):
    assert rows(responses.routed(stored)) == sorted(
        [
            ("data", 1, 11, None), ("data", 1, 12, None), ("data", 1, 12, None), ("data", 1, 15, None),
            ("data", 6, 14, None), ("empty", 2, None, None), ("error", 3, None, "Could not find user with id: "),
            ("error", 4, None, "no bracket"), ("unknown", 5, None, None), ("unknown", 8, None, None),
            ("unknown", 9, None, None),
        ],
        key=repr,
    )


def test_posts(spark):
    body = (
        '{"data":[{"id":"5","text":"a \\"b\\"\\n","conversation_id":"4","lang":"en",'
        '"public_metrics":{"retweet_count":1,"reply_count":2,"like_count":3,"quote_count":4}}]}'
    )
    post = responses.posts_from_responses(spark.createDataFrame([(1, body)], "user_id BIGINT, body STRING")).first()
    assert (post.user_id, post.id, post.text, post.conversation_id, post.in_reply_to_user_id) == (1, 5, 'a "b"\n', 4, None)
    assert post.public_metrics.like_count == 3


@pytest.mark.parametrize(
    "operator",
    [responses.follow_edges, responses.all_errors, responses.users_from_responses, responses.routed, responses.first_errors],
)
def test_each_body_is_parsed_once(stored, operator):
    plan = operator(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def _chain(spark, *pages):
    """Pages ``(user, token, next token or None, good)``."""
    bodies = []
    for user, token, after, good in pages:
        meta = f',"next_token":"{after}"' if after else ""
        body = f'{{"data":[{{"id":"1"}}],"meta":{{"result_count":1{meta}}}}}' if good else '{"errors":[{"value":"1","detail":"x"}]}'
        bodies.append((user, token, body))
    return spark.createDataFrame(bodies, "user_id BIGINT, token STRING, body STRING")


@pytest.mark.parametrize(
    "pages, expected",
    [
        ([(None, "a", 1), ("a", "b", 1), ("b", None, 1)], (3, 0, 0, True)),
        ([(None, None, 1)], (1, 0, 0, True)),
        ([(None, "a", 1), ("b", None, 1)], (2, 1, 1, False)),  # the middle page is missing
        ([("a", "b", 1), ("b", None, 1)], (2, 1, 1, False)),  # the first page is missing
        ([(None, "a", 1), ("a", "b", 1)], (2, 1, 0, False)),  # the last page is missing
        ([(None, "a", 1), ("a", "b", 0), ("b", None, 1)], (3, 1, 1, False)),  # the middle page failed
        ([(None, "a", 1), ("a", "b", 0), ("a", "b", 1), ("b", None, 1)], (3, 0, 0, True)),  # and was asked again
        ([(None, "a", 1), ("a", None, 1), ("a", None, 1)], (2, 0, 0, True)),  # a copy
        ([(None, "a", 1), ("a", "b", 1), ("b", "a", 1)], (3, 0, 0, False)),  # a loop
        ([(None, "a", 1), ("a", None, 1), ("z", None, 1)], (3, 0, 1, False)),  # a page from elsewhere
        ([(None, "a", 0)], (1, 1, 0, False)),
    ],
)
def test_page_chains(spark, pages, expected):
    df = _chain(spark, *[(7, t, n, g) for t, n, g in pages], (8, None, None, 1))
    got = {r.user_id: tuple(r)[1:] for r in responses.page_chains(df).collect()}
    assert got == {7: expected, 8: (1, 0, 0, True)}


def test_lists_of_a_hundred_records(spark):
    data = ",".join(f'{{"id":"{i}","username":"u{i}"}}' for i in range(100))
    errors = ",".join(f'{{"value":"{i}","detail":"d [{i}]"}}' for i in range(100, 140))
    df = spark.createDataFrame([(1, f'{{"data":[{data}],"errors":[{errors}]}}'), (2, f'{{"data":[{data}]}}')], "user_id BIGINT, body STRING")
    users = responses.users_from_responses(df)
    assert sorted(int(r.id) for r in users.collect()) == sorted([*range(100)] * 2)
    assert [r.user_id for r in responses.all_errors(df).orderBy("user_id").collect()] == list(range(100, 140))
    posts = responses.posts_from_responses(df)
    assert sorted(r.id for r in posts.collect()) == list(range(100)) and {r.user_id for r in posts.collect()} == {2}
