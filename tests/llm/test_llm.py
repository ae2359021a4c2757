"""Each operator against a brute-force version or known cases, with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelforge.llm import attention, binarycodes, bpe, density, langcrf, lm, mixing, multiindex, quality, queries, simhash, substrings

SF = f"{TESTDATA}/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [None, "", " \n\t", "one", "one two", "ΑΣ é é <|endoftext|>x ½ ֋! don't", LONG, "same text here now", "same text here now"]


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", 0, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score BIGINT")


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    texts = ODD + [t for _, t in table("documents", "doc_id, text")]
    for row in bpe.encode_texts(documents(spark, texts), queries.vocabulary()).collect():
        ids = tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert bpe.model(queries.vocabulary()).decode(ids) == decoded


def _fingerprint(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_simhash_equals_brute_force(spark):
    texts = ODD + [t for _, t in table("documents", "doc_id, text")]
    prints = np.array([_fingerprint(t) for t in texts], dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(texts)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2) if j > i]
    root = _components(len(texts), pairs)
    for row in simhash.near_duplicates(documents(spark, texts)).collect():
        assert (row.fingerprint, row.component_id) == (f"{prints[row.doc_id]:016x}", root[row.doc_id])
    kept = simhash.one_per_group(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root)) and "score" in kept.columns


@pytest.mark.parametrize("crowded", [64, 2])
def test_links_within_two_bits_on_both_paths(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = {int(s) for s in seeds} | {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(40):
            bits = rng.choice(64, rng.integers(1, 4), replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in bits))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    found = simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp BIGINT")).collect()
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected)


def test_substrings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    make = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    shared, long = make(60), make(400)
    texts = [*ODD, make(20) + " " + shared, shared + "\n" + make(70), make(31) + "\t" + shared, long, long, long[:-9] + " x y", make(49), "a " * 200, "a " * 120]
    texts += [make(rng.integers(0, 9)) + " " + " ".join(long.split()[int(s) : int(s) + 55]) for s in rng.integers(0, 340, 40)]
    first, words = {}, [WORDS.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    rows = {r.doc_id: r for r in substrings.removed_words(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    cut = {r.doc_id: r.text for r in substrings.without_repeats(documents(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i
        assert cut.get(i) == ((kept or None) if any(gone) else texts[i])


def test_substrings_judge_rows_of_one_id_one_by_one(spark):
    long = [f"v{i}" for i in range(200)]
    part = lambda a, b, *more: " ".join([*long[a:b], *more])
    rows = [(5, part(0, 120)), (5, part(0, 60, "x", "y")), (5, "short"), (3, part(100, 160)), (9, part(0, 70)), (9, part(0, 70)), (9, None), (None, part(0, 120)), (None, part(0, 55))]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id BIGINT, text STRING, id INT, number INT")
    words = [(t or "").split() for _, t in rows]
    expected = []
    for (i, t), w in zip(rows, words):
        gone = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - 49):
            own = w[s : s + 50]
            if i is not None and any(j is not None and j < i and own == v[r : r + 50] for (j, _), v in zip(rows, words) for r in range(len(v) - 49)):
                gone[s : s + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((i, len(w), int(gone.sum()), kept, t))
    got = substrings.removed_words(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(
        ((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k, _ in expected), key=repr
    )
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr) == sorted(((i, k if m else t) for i, _, m, k, t in expected if k or not m), key=repr)
    unique = docs.where("doc_id = 3 or doc_id is null and text like '%v100%'")
    assert sorted(r.n_removed for r in substrings.removed_words(unique).collect()) == [0, 0]


def _vectors(spark):
    x = np.array([v for _, v in table("embeddings", "vec_id, embedding")], dtype=np.float64)
    near = x[:40] + 0.01 * np.random.default_rng(3).standard_normal((40, x.shape[1]))
    data = [*x.tolist(), *near.tolist(), x[0].tolist(), x[0].tolist(), None, [0.0] * x.shape[1], [float("nan")] * x.shape[1], []]
    return spark.createDataFrame(list(enumerate(data)), "vec_id BIGINT, embedding ARRAY<FLOAT>"), np.array(data[: len(x) + 42], dtype=np.float32).astype(float), len(data)


def test_binary_codes_equal_brute_force(spark):
    df, x, n = _vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = np.triu(unit @ unit.T >= 0.95, 1)
    root = _components(n, list(zip(*np.nonzero(close))))
    degree = (close | close.T).sum(axis=1)
    for r in binarycodes.near_duplicates(df).collect():
        assert (r.n_links, r.component_id) == (degree[r.vec_id] if r.vec_id < len(x) else 0, root[r.vec_id])
        assert r.kept == (r.vec_id == r.component_id)


def test_code_tables_grow_with_the_data_and_bounds_hold():
    assert binarycodes.plan(10, 0.95, 0.99) == (0, 1)
    bits, tables = binarycodes.plan(10**9, 0.95, 0.99)
    assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.99
    x = np.random.default_rng(4).standard_normal((300, 64))
    signs, factor = binarycodes.codes(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    upper = binarycodes._upper(signs.astype(float), factor, unit @ binarycodes.rotation(64, 0))
    assert (upper >= unit @ unit.T).mean() > 0.9999


def test_multi_index_recall_and_order(spark):
    df, x, _ = _vectors(spark)
    rows = multiindex.nearest_rows(df, F.col("vec_id") % 20 == 0, share=0.6).collect()
    score, hits, total = x @ x.T, 0, 0
    for q in range(0, len(x), 20):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - score[q, r.vec_id]) < 1e-12 and r.vec_id != q for r in mine)
        best = [i for i in np.lexsort((np.arange(len(x)), -score[q])) if i != q][:20]
        hits, total = hits + len({r.vec_id for r in mine} & set(best)), total + 20
    assert hits / total >= 0.9
    assert multiindex.nearest_rows(df.where("false"), F.lit(True)).count() == 0


def test_walk_is_by_summed_distance():
    index = multiindex.Index(np.random.default_rng(5).standard_normal((400, 6)), 5.0, 7)
    index.counts[:] = 1
    da, db = np.random.default_rng(6).random((2, 7))
    sums = [da[a] + db[b] for a, b in index.walk(da, db, 10**6)]
    assert len(sums) == 49 and sums == sorted(sums)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>x</script>", ""),
        ("plain &lt;b&gt; &amp", "plain <b> &"),
        ("<div>a<br>b</div><div>c &nbsp; d</div>", "a b\nc d"),
        ("<body><nav><a>m</a></nav><article><h1>T t</h1><p>One <b>two<p>three</article><footer>f</footer>", "T t\nOne two\nthree"),
        ("<div class='cookie-notice'>We use cookies</div><div class=content><p>First text of all.<p>Second text.</div><div id=comments><p>Nice one</div>", "First text of all.\nSecond text."),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    assert density.main_text(html) == text


def test_pages_keep_their_rows(spark):
    got = density.extract(spark.read.parquet(f"{SF}/pages.parquet"))
    assert got.count() == len(table("pages", "page_id")) and got.where("n_chars <> length(text)").count() == 0
    assert "<" not in "".join(r.text for r in got.collect())


def test_raking_meets_every_margin(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 10), ("b", "x", 5), ("b", mixing.OTHER, 20), ("b", "y", 50)], "__m0 STRING, __m1 STRING, tokens BIGINT")
    raked = mixing.rake(cells, {"m": {"a": 0.3, "b": 0.7}, "n": {"x": 1.0, "y": 1.0}}, 40).toPandas()
    assert raked.groupby("__m0").weight.sum().to_dict() == pytest.approx({"a": 0.3, "b": 0.7})
    assert raked.groupby("__m1").weight.sum()["x"] == pytest.approx(raked.groupby("__m1").weight.sum()["y"])
    chances = mixing.probabilities(mixing.rake(cells, {"m": {"a": 0.3, "b": 0.7}, "n": {"x": 1.0, "y": 1.0}}, 40), 0.6).toPandas()
    assert (chances.probability * chances.tokens).sum() == pytest.approx(0.6 * 185) and chances.probability.max() <= 1


def test_mixing_keeps_clashing_columns(spark):
    docs = documents(spark, ODD).withColumn("probability", F.lit("p"))
    kept = queries.mixed(docs)
    assert kept.columns == docs.columns and queries.mixed(docs.where("false")).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    scores, moves, start = rng.standard_normal((7, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    lengths = np.array([2, 4, 1])
    got = langcrf.forward_backward(scores, lengths, moves, start)
    at = 0
    for n in lengths:
        total, chance = 0, np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            weight = np.exp(start[path[0]] + sum(scores[at + i, s] for i, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            for i, s in enumerate(path):
                chance[i, s] += weight
        assert np.allclose(got[at : at + n], chance / total)
        at += n


def test_lexicons_hold_words_of_one_language():
    documents = [{"the", "x", "der"}, {"the", "one"}, {"der", "x"}, {"der"}, {"der"}, {"le", "x"}]
    found = langcrf.lexicons(documents, [0, 0, 1, 1, 1, 2], 3)
    # "x" and, by shares, "der" are common to several; "one" and "le" have one document.
    assert found == {"the": 0} and langcrf.lexicons([], [], 2) == {}
    more = langcrf.lexicons(documents + [{"y"}] * 30, [0, 0, 1, 1, 1, 2] + [0] * 30, 3)
    assert more["der"] == 1 and more["y"] == 0


def test_lexicon_decides_where_spelling_does_not():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]  # both languages are spelled alike
    texts, langs = [], []
    for i in range(200):
        own = words[:200] if i % 4 < 2 else words[200:]
        texts.append(" ".join(rng.choice(own, 30)))
        langs.append("aa" if i % 4 < 2 else "bb")
    tagger = langcrf.train(texts, langs)
    assert len(tagger.lexicon) == 400 and tagger.weights[langcrf.SLOTS, 0] > tagger.weights[langcrf.SLOTS, 1] + 0.5
    switched = [*words[:12], *words[200:212], *words[20:32]]
    scores = tagger.emissions(switched)[:, :-1]
    chance = langcrf.forward_backward(scores, np.array([36]), tagger.moves, tagger.start)
    assert [tagger.labels[i] for i in chance.argmax(axis=1)] == ["aa"] * 12 + ["bb"] * 12 + ["aa"] * 12


def test_every_language_of_the_training_rows_is_a_label(spark):
    rows = [(i, " ".join(f"en{j % 50}ing" for j in range(i, i + 30)), "en") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"zyx{j % 20}qq" for j in range(i, i + 30)), "zz") for i in range(3)]
    rows += [(9000, "lööng " * 5000, "sv"), (9001, None, "no"), (9002, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").repartition(3)
    tagger = langcrf.fit(docs, F.lit(True), sample=60, longest=2000)
    assert tagger.labels == ["en", "sv", "zz"]
    asked = spark.createDataFrame([(1, "zyx3qq zyx4qq"), (2, "en3ing en9ing"), (3, "lööng lööng")], "doc_id BIGINT, text STRING")
    assert {r.doc_id: r.lang_pred for r in langcrf.predict(asked, tagger).collect()} == {1: "zz", 2: "en", 3: "sv"}
    again = langcrf.fit(docs.repartition(7), F.lit(True), sample=60, longest=2000)
    assert (again.weights == tagger.weights).all() and again.lexicon == tagger.lexicon


def test_language_of_held_out_and_odd_texts(spark):
    truth = dict(table("documents", "doc_id, lang"))
    found = queries.op10_langcrf(spark, SF).where("held_out").collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in found]) > 0.9 and all(0 <= r.score <= 1 for r in found)
    docs = documents(spark, [*ODD, "12 3 ! 4² ½ Ⅷ"])
    tagger = langcrf.fit(docs, F.lit(True))
    got = {r.doc_id: r.lang_pred for r in langcrf.predict(docs.select("doc_id", "text"), tagger).collect()}
    assert [got[i] for i in (0, 1, 2, 9)] == ["und"] * 4 and got[3] == "en"
    nothing = langcrf.predict(docs.select("doc_id", "text"), langcrf.fit(docs.where("false"), F.lit(True)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_quality_of_odd_texts_and_held_out(spark):
    good = [f"the old man went to the sea and sat by it {i}" for i in range(60)]
    bad = [f"word{i} " * 12 + "| !! | ***" for i in range(60)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id BIGINT, quality INT")
    scorer = quality.fit(docs, labels, F.col("id") % 4 != 0)
    held = quality.score(docs.where("doc_id % 4 = 0").select("doc_id", "text"), scorer).collect()
    assert all((r.score >= 0.3) == (r.doc_id < 60) for r in held)
    odd = quality.score(documents(spark, ODD).select("doc_id", "text"), scorer).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    none = quality.fit(docs, labels.where("false"), F.lit(True))
    assert {r.score for r in quality.score(docs.select("doc_id", "text"), none).collect()} == {0.5}


def test_language_model_counts_and_gain(spark):
    texts = {i: WORDS.findall((t or "").translate(LOWER)) + [None] for i, t in table("documents", "doc_id, text")}
    rows = queries.op8_lm(spark, SF).collect()
    counts = {}
    for r in rows:
        for w in texts[r.doc_id] if not r.held_out else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    for r in rows:
        c = np.array([counts.get(w, 0) for w in texts[r.doc_id]])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), (c > 0).sum(), total)
        assert r.base_score == pytest.approx(np.log10((c + 1) / (total + len(counts) + 1)).sum())
        assert np.isfinite(r.score) and r.score < 0
    learned = [r for r in rows if not r.held_out]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)
    odd = lm.scores(documents(spark, ODD).select("doc_id", "text"), F.lit(True), queries.vocabulary("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: r.n_tokens for r in odd.collect()}[0] == 1 and odd.count() == len(ODD)
    assert all(np.isfinite(r.score) and r.score < 0 for r in odd.collect())


def test_attention_is_causal_and_sums_to_one():
    model = attention.train([np.array([3, 4, 5, 4, 3, 1])] * 3, 8, steps=5)
    start = np.array([3, 4, 5, 3, 4] * 9)
    a, b = (attention.score(model, [np.append(start, x)]) - attention.score(model, [start]) for x in (1, 5))
    every = [attention.score(model, [np.append(start, x)])[0] - attention.score(model, [start])[0] for x in range(1, 8)]
    # START itself is never a target, so that the rest sums to its complement.
    assert 0.5 < np.exp(every).sum() <= 1 + 1e-5 and a != b


def _cut(words):
    """Brute force of the third stage: lists of words, in order of ids, without what starts earlier."""
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    out = []
    for i, w in enumerate(words):
        gone = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = True
        out.append((gone.any(), [x for x, g in zip(w, gone) if not g]))
    return out


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {i: t for i, t in table("documents", "doc_id, text")}
    kept = [i for i in sorted(rows) if any(map(str.isalpha, rows[i] or ""))]
    prints = np.array([_fingerprint(rows[i]) for i in kept], dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(kept)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2) if j > i]
    kept = [kept[i] for i in sorted(set(_components(len(kept), pairs)))]
    now = docs
    stages = list(corpus_pipeline.STAGES)
    for _, stage in stages[:2]:
        now = stage(spark, now, SF)
    now = now.cache()
    assert sorted(r.doc_id for r in now.select("doc_id").collect()) == kept and now.columns == docs.columns
    cut = {i: " ".join(words) if changed else rows[i] for i, (changed, words) in zip(kept, _cut([WORDS.findall(rows[i]) for i in kept]))}
    cut = {i: t for i, t in cut.items() if t}
    now = stages[2][1](spark, now, SF).cache()
    assert {r.doc_id: r.text for r in now.collect() if r.text} == cut and now.columns == docs.columns
    sampled = stages[3][1](spark, now, SF).cache()
    chosen = {r.doc_id: r.text for r in sampled.collect()}
    assert chosen.items() <= {r.doc_id: r.text for r in now.collect()}.items() and sampled.columns == docs.columns
    assert 0.3 < len(chosen) / len(kept) < 0.9
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    done = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in done} == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in chosen.items()}


def test_attention_gives_every_id_its_own_probability(monkeypatch):
    monkeypatch.setattr(attention, "HEAD", 6)
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 60, 40), 1) for _ in range(4)]
    model = attention.train(texts, 60, steps=20)
    assert model.cuts == [6, 24, 60]
    o = rng.standard_normal((1, attention.WIDTH)).astype(np.float32)
    logs = model.log_probs(np.repeat(o, 60, axis=0), np.arange(60))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5) and len(set(logs.tolist())) == 60
    # Gradients of both steps against differences of the loss.
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    windows, targets, _ = attention.windowed(texts[:2])
    _, grads = model.step(windows, targets)
    for name, at in (("out", (3, 2)), ("out", (3, 40)), ("bias", (50,)), ("turn", (2, 1)), ("turn_bias", (0,)), ("w2", (5, 5)), ("embed", (int(texts[0][0]), 3))):
        values, losses = getattr(model, name), []
        for d in (1e-4, -2e-4):
            values[at] += d
            losses.append(model.step(windows, targets)[0])
        values[at] += 1e-4
        assert (losses[0] - losses[1]) / 2e-4 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-6)


def test_every_first_id_of_the_training_texts_is_a_class():
    words = [chr(c).encode() + b"x" for c in range(97, 123)] + [f"{i:03d}z".encode() for i in range(400)]
    spelling = lm.Spelling(queries.vocabulary("byte_bpe_50k.tiktoken"))
    ids = spelling.ids(words)
    spelling.learn(*lm.tally(np.array(list(map(len, ids))), np.concatenate(ids), np.ones(len(words), dtype=np.int64)))
    first = {i[0] for i in spelling.ids(words)}
    assert len(first) > 125 and len({int(spelling.classes[i]) for i in first} - {lm.REST}) == len(first)


def test_spelling_comes_from_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 2)
    monkeypatch.setattr(lm, "TALLIED", 50)
    texts = [None, *(t for _, t in table("documents", "doc_id, text")[:150]), "überlang zzyzx " * 2_000]
    docs = documents(spark, texts)
    spelling = lm.Spelling(queries.vocabulary("byte_bpe_50k.tiktoken"))
    counts = {}
    for t in texts:
        for w in lm.tokens((t or "").encode()):
            counts[w] = counts.get(w, 0) + 1
    spelled = dict(zip(counts, spelling.ids(list(counts))))
    sums = lm.tallies(lm.count_words(docs, spelling)).toArrow()
    spelling.learn(*(sums.column(c).to_numpy() for c in ("a", "b", "n", "words")))
    often, words, pairs, stops = {}, {}, {}, {}
    for w, ids in spelled.items():
        often[ids[0]] = often.get(ids[0], 0) + counts[w]
        words[ids[0]] = words.get(ids[0], 0) + 1
        stops[ids[-1]] = stops.get(ids[-1], 0) + 1
        for p in zip(ids, ids[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    assert spelling.kinds == len(often) + lm.REST + 1 and spelling.tokens[lm.END] == len(texts)
    assert all(spelling.tokens[spelling.classes[i]] == n and spelling.words[spelling.classes[i]] == words[i] for i, n in often.items())
    assert dict(zip(spelling.pairs.tolist(), spelling.pair_counts.tolist())) == {a * spelling.size + b: n for (a, b), n in pairs.items()}
    layer = lm.fit_layer(docs, F.lit(True), spelling, "text", "doc_id").layer
    assert len(layer.embed) == spelling.kinds
    facts = spelling.facts([w for w in spelled])
    assert (facts[:, 0] != lm.REST).all() and np.isfinite(facts).all()
    bound = {i: sum(np.exp(f[1]) for f, s in zip(facts, spelled.values()) if s[0] == i) for i in often}
    assert max(bound.values()) <= 1 + 1e-9


def test_only_ids_travel_with_anchors_and_windows(spark):
    texts = spark.createDataFrame([(1, [5, 6]), (2, [6, 7]), (3, [8])], "id BIGINT, anchors ARRAY<BIGINT>")
    found = spark.createDataFrame([(1, [0], [False], [9], [4]), (2, [3], [True], [9], [4])], "id BIGINT, at ARRAY<INT>, late ARRAY<BOOLEAN>, h ARRAY<BIGINT>, h2 ARRAY<BIGINT>")
    spots, starts = substrings.shared_anchors(texts), substrings.repeated_windows(found)
    assert {r.id: len(r.spots) for r in spots.collect()} == {1: 1, 2: 1}
    assert [tuple(r) for r in starts.collect()] == [(2, [3])]
    for frame in (spots, starts):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert " AS doc#" not in plan.replace("struct(doc, ", "")


def test_the_attention_learns_from_all_training_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 2)
    monkeypatch.setattr(lm, "SHARE", 3_000)
    texts = [t for _, t in table("documents", "doc_id, text")[:60]] + ["zyx " * 30_000, None]
    docs = documents(spark, texts)

    def fitted(docs):
        spelling = lm.Spelling(queries.vocabulary("byte_bpe_50k.tiktoken"))
        sums = lm.tallies(lm.count_words(docs, spelling)).toArrow()
        spelling.learn(*(sums.column(c).to_numpy() for c in ("a", "b", "n", "words")))
        return spelling, lm.fit_layer(docs, F.lit(True), spelling, "text", "doc_id").layer

    spelling, layer = fitted(docs)
    # No first id of a text outside the start keeps the mean embedding; the last id of a text is never read.
    kinds = {int(k) for t in texts for k in spelling.kinds_of([*lm.tokens((t or "").encode())[:-1], b"x"])[:-1, 0]}
    assert len({layer.embed[k].tobytes() for k in kinds}) == len(kinds)
    again = fitted(docs.repartition(5))[1]
    assert all((getattr(layer, n) == getattr(again, n)).all() for n in layer.NAMES)


def test_joined_shares_weigh_by_what_they_learned():
    rng = np.random.default_rng(8)
    start = attention.train([rng.integers(1, 700, 400)], 700, steps=3)
    one, two = attention.Learner(start, 1_000), attention.Learner(start, 1_000)
    one.learn([rng.integers(1, 300, 100)])
    two.learn([rng.integers(200, 700, 300), np.array([1])])
    rows = {}
    for a, b in zip(attention.blocks(one), attention.blocks(two)):
        rows[a[0]] = attention.joined(np.array([a[1], b[1]]), np.array([a[2], b[2]]), np.array([a[3], b[3]]))
    both = attention.with_blocks(start, rows)
    assert (one.learned, two.learned) == (100, 301)
    for name in start.NAMES:
        if name != "embed":
            mean = (100 * getattr(one.model, name) + 301 * getattr(two.model, name)) / 401
            assert getattr(both, name) == pytest.approx(mean, abs=1e-6)
    for n in range(700):
        a, b = one.read[n], two.read[n]
        expected = (a * one.model.embed[n] + b * two.model.embed[n]) / (a + b) if a + b else start.embed[n]
        assert both.embed[n] == pytest.approx(expected, abs=1e-6)


def test_marginals_by_blocks_equal_the_plain_steps():
    rng = np.random.default_rng(6)
    for k in (2, 4):
        lengths = np.concatenate([[1, 63, 64, 65, 128, 129, 5000], rng.integers(1, 300, 40)])
        scores, moves, start = 3 * rng.standard_normal((lengths.sum(), k)), rng.standard_normal((k, k)), rng.standard_normal(k)
        assert np.abs(langcrf.marginals(scores, lengths, moves, start) - langcrf.forward_backward(scores, lengths, moves, start)).max() < 1e-10
    assert langcrf.marginals(scores[:3], np.array([3]), moves, start) == pytest.approx(langcrf.forward_backward(scores[:3], np.array([3]), moves, start))


def test_pair_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    k, lengths = 3, np.array([4, 1, 2])
    scores, moves, start = rng.standard_normal((7, k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    chance, moved = langcrf.forward_backward(scores, lengths, moves, start, pairs=True)
    expected, singles, at = np.zeros((k, k)), np.zeros((7, k)), 0
    for n in lengths:
        paths = list(product(range(k), repeat=int(n)))
        value = np.exp([start[p[0]] + sum(scores[at + i, x] for i, x in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:])) for p in paths])
        for p, v in zip(paths, value / value.sum()):
            for i, x in enumerate(p):
                singles[at + i, x] += v
            for x, y in zip(p, p[1:]):
                expected[x, y] += v
        at += n
    assert moved == pytest.approx(expected) and chance == pytest.approx(singles)


@pytest.mark.parametrize(
    "name", ["class='has-sidebar'", "class='no-sidebar wide'", "class='content-with-sidebar'", "class='page-notices'", "class='sidebar'", "id='menu-overlay'", "role='search'"]
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "{}"])
def test_a_wrapper_named_beside_keeps_the_article(name, inner):
    text = "<p>The first sentence of the article.</p><p>The second sentence of the article.</p>"
    html = f"<body><div class='cookie-notice'>We use cookies</div><div {name}>{inner.format(text)}</div></body>"
    assert density.main_text(html) == "The first sentence of the article.\nThe second sentence of the article."


def test_widgets_headlines_and_page_wide_forms_stay():
    parts = "".join(f"<div class='elementor-widget-text-editor'><p>Paragraph number {i} of this page.</p></div>" for i in range(5))
    html = f"<body><form id=aspnetForm><div><div class='entry-header'><h1>The headline here</h1></div>{parts}</div><div class='sidebar-left'>Aside</div></form></body>"
    assert density.main_text(html) == "\n".join(["The headline here", *(f"Paragraph number {i} of this page." for i in range(5))])
    # Everything in named parts, each of them small.
    html = "".join(f"<div class=widget><p>Part {i} of the page.</p></div>" for i in range(4))
    assert density.main_text(html) == "\n".join(f"Part {i} of the page." for i in range(4))


def test_multi_index_recall_where_the_walk_stops(spark):
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((60, 16))[rng.integers(0, 60, 5000)] + 0.4 * rng.standard_normal((5000, 16))).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    asked = range(0, len(x), 50)
    score = x[list(asked)] @ x.T
    truth = {q: set([int(i) for i in np.argsort(-s, kind="stable") if i != q][:20]) for q, s in zip(asked, score)}

    def recall(share):
        rows = multiindex.nearest_rows(df, F.col("vec_id") % 50 == 0, share=share, least=0).collect()
        return sum(r.vec_id in truth[r.query_id] for r in rows) / (20 * len(truth))

    few, many = recall(0.02), recall(multiindex.SHARE)
    assert few < many and many >= 0.9


def test_rows_of_a_repeated_id_are_decided_one_by_one(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(80)]
    clean = " ".join(f"c{i}" for i in range(50))
    docs = documents(spark, [" ".join(base), " ".join(base), clean, clean + " ", None, clean])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 2, 1).when(F.col("doc_id") == 5, None).otherwise(F.col("doc_id"))).withColumnRenamed("score", "fp")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == [(0, " ".join(base)), (1, clean), (4, None), (None, clean)]


def test_a_text_travels_once_to_be_cut(spark, tmp_path):
    passage = " ".join(f"v{i}" for i in range(60))
    rows = [(1, passage, "a"), (2, "x " + passage, "b"), (3, passage, "c"), (4, " kept  as it is", "d"), (5, None, "e"), (6, "", "f"), (7, passage + " y z", "g")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        cut = substrings.without_repeats(docs)
        plan = cut._jdf.queryExecution().executedPlan().toString()
        found = sorted(tuple(r) for r in cut.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == [(1, passage, "a"), (2, "x", "b"), (4, " kept  as it is", "d"), (5, None, "e"), (6, "", "f"), (7, "y z", "g")]
    # One scan reads the texts, for one join, and they stand beside the row's other columns, not twice.
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string") == 1 and plan.count("SortMergeJoin") == 1
    assert "text" not in substrings.told_apart(docs, "text", "doc_id").schema["row"].dataType.names


def test_texts_are_parted_and_spelled_once_for_all_passes(spark, monkeypatch):
    texts = ["Ab ab\tÉté x", None, "", "漢字 ab", " \n", "x" * 3_000 + " Y"]
    docs = documents(spark, texts).select("doc_id", "text")
    learns = F.col("doc_id") < 5
    spelling = lm.Spelling(queries.vocabulary("byte_bpe_50k.tiktoken"))
    whole = lm.stored(lm.encoded(docs, learns, spelling, "text", "doc_id"), "encoded")
    sums = lm.tallies(lm.counted(whole)).toArrow()
    spelling.learn(*(sums.column(c).to_numpy() for c in ("a", "b", "n", "words")))
    model = lm.fit_layer(docs, learns, spelling, "text", "doc_id", whole)
    model.learn(np.empty(0, np.int64), np.empty(0, np.int64))
    # From here on nothing can be spelled.
    monkeypatch.setattr(spelling, "path", "/nowhere")
    lm.learned_by_all(whole, model.layer, spelling)
    found = {r.doc_id: r for r in lm.first_scores(whole, model).collect()}
    for i, text in enumerate(texts):
        words = Counter(lm.tokens((text or "").encode()))
        assert found[i].n_tokens == words.total() + 1 and {r.h: r.k for r in found[i].rare} == {lm.hashed(w): n for w, n in words.items()}
    counted = {r.h: r.n for r in lm.counted(whole).collect()}
    assert counted == {lm.hashed(w): n for w, n in Counter([b""] * 5 + [w for t in texts[:5] for w in lm.tokens((t or "").encode())]).items()}


def test_numbers_per_word_travel_as_bytes(spark):
    docs = documents(spark, ["ab ab c", None, "d" * 70_000]).select("doc_id", "text")
    spelling = lm.Spelling(queries.vocabulary("byte_bpe_50k.tiktoken"))
    whole = lm.encoded(docs, F.lit(True), spelling, "text", "doc_id")
    assert all(dict(whole.dtypes)[name] == "binary" for name in ("places", "h", "n", "spelled", "ids"))
    assert dict(lm.count_words(docs, spelling).dtypes)["ids"] == "binary"
    ids = {r.h: np.frombuffer(r.ids, "<i4").tolist() for r in lm.count_words(docs, spelling).collect()}
    words = [b"ab", b"c", b"d" * 70_000]
    assert ids == {lm.hashed(b""): [], **{lm.hashed(w): i for w, i in zip(words, spelling.ids(words))}}
    for numbers in ([], [0], [255, 1], [256], [65_536], [1 << 33, 3]):
        assert lm.unpacked(lm.packed(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_a_step_fills_the_same_arrays_again_and_knows_when_powers_fit():
    import tracemalloc

    rng = np.random.default_rng(6)
    texts = [np.append(rng.integers(1, 300, 60), 1) for _ in range(64)]
    model = attention.train(texts, 300, steps=3)
    windows, targets, _ = attention.windowed(texts)
    room = attention.Room()
    first = model.step(windows, targets, room)
    tracemalloc.start()
    again = model.step(windows, targets, room)
    taken = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 24 * windows.size * attention.WIDTH  # before, some 80 bytes for each number of the windows' ids
    assert first[0] == again[0] and all((first[1][n] == again[1][n]).all() for n in first[1])
    # A very low bias alone leaves the powers in bounds, high weights do not; either way the result is that of brute force.
    for low, wide in ((-70, 1), (0, 400)):
        model = attention.train(texts, 300, steps=3)
        model.bias[5], model.out[:] = low, model.out * wide
        o = rng.standard_normal((40, attention.WIDTH)).astype(np.float32)
        wanted = rng.integers(1, 64, 40)
        with_one = np.concatenate([o, np.ones((40, 1), np.float32)], axis=1)
        assert model.bounded(model.weights(), with_one, 60)[0] == (wide == 1)
        logits = o.astype(np.float64) @ np.concatenate([model.out[:, :64], model.turn], axis=1) + np.concatenate([model.bias[:64], model.turn_bias])
        logits = np.clip(logits, -80, 80)
        exact = logits[np.arange(40), wanted] - np.log(np.exp(logits).sum(axis=1))
        assert model.log_probs(o, wanted) == pytest.approx(exact, rel=1e-4, abs=1e-4) and np.isfinite(model.step(windows, targets)[0])
