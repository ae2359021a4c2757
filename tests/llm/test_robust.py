"""Empty tables, clashing columns, repeated and null ids for every operator; the quality scorer by plain loops."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import binarycodes, bpe, density, langcrf, lexical, lm, multiindex, quality, queries, rules, simhash, substrings, whitening

TEXTS = [None, "", "One two three four.", "One two three four.", "x " * 300, "ÄÖ " * 40 + "\n" + "end"]
#: Names that operators use inside.
CLASHING = ["id", "row", "key", "fp", "n", "terms", "score", "number", "h", "text_", "__row", "part", "kept", "anchors", "spots", "cell"]


def documents(spark, ids=None, clash=True):
    ids = list(range(len(TEXTS))) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en" if n % 2 else "de", "src1") for n, (i, t) in enumerate(zip(ids, TEXTS))], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING]) if clash else df


def vectors(spark, ids=None):
    data = np.random.default_rng(1).standard_normal((6, 4)).astype(np.float32).tolist()
    data[1] = data[0]
    df = spark.createDataFrame(list(zip(ids or range(6), data)), "vec_id BIGINT, embedding ARRAY<FLOAT>")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHING])


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id BIGINT, quality INT")


def tagged(spark, docs):
    return langcrf.predict(docs.select("doc_id", "text"), langcrf.fit(documents(spark, clash=False), F.lit(True)))


def scored(spark, docs):
    return quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels(spark), F.lit(True)))


def ruled(spark, docs):
    return rules.judge(docs.select("doc_id", "text"), rules.fit(docs, labels(spark)))


def modelled(spark, docs):
    return lm.scores(docs.select("doc_id", "text"), F.lit(True), queries.vocabulary("byte_bpe_50k.tiktoken"))


def searched(spark, docs):
    return lexical.search(docs, docs.select(F.col("doc_id").alias("item_id"), "text", "n", "row"), 50)


#: Operators that give one row per document.
PER_DOCUMENT = {
    "op1": lambda spark, docs: bpe.encode_texts(docs, queries.vocabulary(), with_ids=False),
    "op2": lambda spark, docs: simhash.near_duplicates(docs),
    "op4": lambda spark, docs: substrings.removed_words(docs),
    "op7": scored,
    "op8": modelled,
    "op10": tagged,
    "op11": ruled,
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_documents(spark, name):
    run = PER_DOCUMENT[name]
    assert run(spark, documents(spark).where("false")).count() == 0
    assert sorted(r.doc_id for r in run(spark, documents(spark)).collect()) == list(range(len(TEXTS)))
    ids = [4, 4, 4, None, None, 9]
    found = sorted((r.doc_id for r in run(spark, documents(spark, ids)).collect()), key=repr)
    assert found == sorted(ids, key=repr)


def test_rows_are_kept_with_their_columns(spark):
    docs = documents(spark)
    for keeps in (simhash.one_per_group, substrings.without_repeats):
        kept = keeps(docs)
        assert kept.columns == docs.columns and keeps(docs.where("false")).count() == 0
        assert {tuple(r)[4:] for r in kept.collect()} == {(7,) * len(CLASHING)}
    mixed = queries.mixed(docs)
    assert mixed.columns == docs.columns and queries.mixed(docs.where("false")).count() == 0


def test_search(spark):
    docs = documents(spark)
    assert searched(spark, docs.where("false")).count() == 0
    found = {(r.item_id, r.doc_id) for r in searched(spark, docs).collect()}
    assert {(2, 2), (2, 3), (3, 3), (4, 4), (5, 5)} <= found and not {i for i, _ in found} & {0, 1}


@pytest.mark.parametrize("run", [multiindex.nearest_rows, binarycodes.near_duplicates, whitening.whiten])
def test_vectors(spark, run):
    more = (F.lit(True),) if run is multiindex.nearest_rows else ()
    assert run(vectors(spark).where("false"), *more).count() == 0
    rows = run(vectors(spark), *more).collect()
    if run is binarycodes.near_duplicates:
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows)[:2] == [(0, 1, 0), (1, 1, 0)] and len(rows) == 6
    elif run is whitening.whiten:
        assert len(rows) == 24
    else:
        assert len(rows) == 30


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b c"), (1, None, None), (None, "u", "")], "page_id BIGINT, url STRING, html STRING")
    pages = pages.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    assert density.extract(pages.where("false")).count() == 0
    assert sorted((r.page_id, r.text) for r in density.extract(pages).where("page_id is not null").collect()) == [(1, ""), (1, "a b c")]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    documents(spark, clash=False).withColumn("n_chars", F.length("text").cast("bigint")).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    docs = documents(spark).withColumns({c: F.lit("c") for c in ("lang_pred", "n_switches", "c0", "text_sha256")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
    left = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5]


# The quality scorer


def plain_slots(word):
    raw = f"<{word}>".encode()
    found = [crc32(raw) % quality.SLOTS]
    for n in (3, 4):
        found += [crc32(raw[i : i + n], n) % quality.SLOTS for i in range(len(raw) - n + 1)]
    return found + ([quality.CAPITALS] if word.isupper() and len(word) > 1 else [])


def plain_features(text):
    words = (text or "").split()
    return [s for w in words for s in plain_slots(w)] + [quality.AGAIN for a, b in zip(words, words[1:]) if a == b]


def plain_training(texts, labels, rounds, rate, batch, seed=9):
    """Stochastic gradient descent, number by number in double precision."""
    rng = np.random.default_rng(seed)
    start = (rng.random((quality.SLOTS, quality.WIDTH), dtype=np.float32) - 0.5) / quality.WIDTH
    vectors, layer, bias = {}, np.zeros((quality.WIDTH, 2)), np.zeros(2)
    steps, done = rounds * -(-len(texts) // batch), 0
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            group, now = order[at : at + batch], rate * (1 - done / steps)
            moves, layer_move, bias_move = [], np.zeros_like(layer), np.zeros(2)
            for g in group:
                slots = plain_features(texts[g])
                mean = sum((vectors.setdefault(s, start[s].astype(float)) for s in slots), np.zeros(quality.WIDTH)) / max(len(slots), 1)
                logits = mean @ layer + bias
                chance = np.exp(logits - logits.max())
                error = chance / chance.sum() - np.eye(2)[labels[g]]
                moves.append((slots, layer @ error))
                layer_move += np.outer(mean, error) / len(group)
                bias_move += error / len(group)
            layer, bias = layer - now * layer_move, bias - now * bias_move
            for slots, back in moves:
                for s in set(slots):
                    vectors[s] = vectors[s] - now * 4 * np.sqrt(slots.count(s) / len(slots)) * back
            done += 1
    return lambda s: vectors.get(s, start[s].astype(float)) @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]


def test_quality_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_STEPS", 1)
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["sea", "old", "man", "went", "the", "HOME", "ß"], 9)) for _ in range(20)]
    bad = [" ".join(rng.choice(["buy", "now", "NOW", "the", "$$"], 9)) for _ in range(20)]
    texts, marks = [*good, *bad, "", "the the the"], [1] * 20 + [0] * 20 + [1, 0]
    scorer = quality.train(texts, marks, rounds=3, batch=8)
    slot, lean = plain_training(texts, marks, 3, 1.0, 8)
    asked = [*texts, "unseen words here", "HOME HOME sea", None]
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id BIGINT, text STRING")
    for r in quality.score(df, scorer).collect():
        found = plain_features(asked[r.doc_id])
        odds = np.mean([slot(s) for s in found]) + lean if found else scorer.prior
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=2e-4), asked[r.doc_id]
    assert scorer.prior == pytest.approx(np.log(21.5 / 21.5))


def test_long_labelled_texts_train_by_a_piece(spark):
    long = "spam eggs " * 5000
    rows = [(i, "plain old words here", 1) for i in range(40)] + [(100 + i, long, 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id BIGINT, quality INT")
    scorer = quality.fit(docs, marks, F.lit(True), longest=500)
    assert all((r.score >= 0.5) == (r.doc_id < 100) for r in quality.score(docs, scorer).collect())
    again = quality.fit(docs.repartition(5), marks, F.lit(True), longest=500)
    assert (again._slot == scorer._slot).all()


def test_repeated_ids_train_alike_however_rows_lie(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} of many {i * 7}") for i in range(60)], "doc_id BIGINT, text STRING")
    marks = spark.createDataFrame([(i % 3, i % 2) for i in range(30)], "doc_id BIGINT, quality INT")
    first, second = (quality.fit(docs.repartition(n), marks.repartition(n), F.lit(True), sample=7) for n in (1, 4))
    assert (first._slot == second._slot).all() and first.prior == second.prior
