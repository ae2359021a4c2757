"""Ranked lexical search against a dictionary-based version."""

import math
import re
from collections import Counter

import duckdb
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from panelforge.llm import lexical
from panelforge.llm.oracle import ORACLE

SF = f"{TESTDATA}/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " .,;\n", "Ärger ÄRGER ärger É", "the the THE", "the the the", "x" * 50_000, "the " * 30_000 + "rare", "a_b-c`d{e}f\x7fg 漢字、仮名 it's"]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counts:
            length = sum(c.values())
            m = 10 + (90 * length * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2, "x", 0) for i, t in docs], "doc_id BIGINT, text STRING, row INT, term INT, block STRING, score INT")
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id BIGINT, text STRING, row INT, rank INT")
    return d.repartition(3, "doc_id"), q.repartition(2, "item_id")


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def data():
    docs = list(enumerate(ODD)) + [(100 + i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    docs += [(1000 + i, "the same words in every copy") for i in range(60)]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    return docs, items + [(900 + i, t) for i, t in enumerate([*ODD, "same copy words", "nowhere to be found zzzz", "the"])]


@pytest.mark.parametrize("most_terms, per_block, shard, owners", [(1 << 20, 256, 1 << 14, lexical.OWNERS), (0, 7, 16, lexical.OWNERS), (1 << 20, 5, 4, ()), (1 << 20, 9, 8, (0.5,))])
def test_search_equals_brute_force(spark, most_terms, per_block, shard, owners):
    docs, items = data()
    d, q = frames(spark, docs, items)
    got = found(lexical.search(d, q, most_terms=most_terms, items_per_block=per_block, owners=owners, shard_size=shard))
    assert got == sorted(brute(docs, items))


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    docs = [(5, "red apple"), (5, "red apple"), (None, "red apple"), (3, "red pear"), (7, "blue plum")]
    d, q = frames(spark, docs, [(1, "red"), (1, "apple red"), (None, "blue")])
    got = sorted((tuple(r) for r in lexical.search(d, q, k=3).select("item_id", "rank", "doc_id").collect()), key=repr)
    assert got == sorted([(1, 1, 3), (1, 2, 5), (1, 3, 5), (1, 1, 5), (1, 2, 5), (1, 3, None), (None, 1, 7)], key=repr)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty_tables_give_no_rows(spark, docs, items):
    assert found(lexical.search(*frames(spark, docs, items))) == []


def test_long_texts_are_counted_alike(monkeypatch):
    text = ("The café, the 漢字 " * 500).encode()
    short = lexical.counted(text, None)
    monkeypatch.setattr(lexical, "LONG", 10)
    assert lexical.counted(text, None) == short and short[0] == 2000
    assert lexical.counted(text, {b"the": 0}) == (2000, Counter({b"the": 1000}))


def test_query_equals_its_sql(spark):
    from panelforge.llm.queries import QUERIES

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert found(QUERIES["op13_lexical"](spark, SF)) == sorted(connection.execute(ORACLE["op13_lexical"]).fetchall())
