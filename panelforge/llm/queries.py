"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import binarycodes, bpe, density, langcrf, lexical, lm, mixing, multiindex, quality, rules, simhash, substrings, whitening
from panelforge.llm.common import fold, stored, table
from panelforge.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Targets of the mix: even sources, languages and topics by share.
TOPICS = {"action": ("tion", "ci\u00f3n", "ung"), "being": ("ing", "ment", "heit")}
TARGETS: mixing.Targets = {
    "source": {f"src{n}": 1.0 for n in range(20)},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11},
    "topic": {"action": 0.5, "being": 0.45, "none": 0.05},
}
KEEP = 0.6


def mixed(docs: DataFrame) -> DataFrame:
    margins = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"), TOPICS)}
    return mixing.sample(docs, margins, TARGETS, mixing.count_words(F.col("text")), KEEP).select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", "lang", mixing.topic(F.col("text"), TOPICS).alias("topic"), mixing.count_words(F.col("text")).alias("tokens"))
    margins = {m: F.col(m) for m in TARGETS}
    kept = mixing.sample(stored(slim, "margins"), margins, TARGETS, F.col("tokens"), KEEP)
    return kept.select("__row.doc_id", F.col("__m0").alias("source"), F.col("__m1").alias("lang"), F.col("__m2").alias("topic"), F.round("probability", 6).alias("probability"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_words(table(spark, sf_dir, "documents"))


def op5_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = quality.fit(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    scored = quality.score(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), scorer)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return lm.scores(docs, ~F.col("held_out"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_binarycodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binarycodes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_langcrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = langcrf.fit(docs, fold("doc_id", 3) != 1)
    found = langcrf.predict(docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out")), tagger)
    return found.select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs.select("doc_id", "text"), rules.fit(docs, table(spark, sf_dir, "labels")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_substrings": op4_substrings,
    "op5_multiindex": op5_multiindex,
    "op6_density": op6_density,
    "op7_quality": op7_quality,
    "op8_lm": op8_lm,
    "op9_binarycodes": op9_binarycodes,
    "op10_langcrf": op10_langcrf,
    "op11_rules": op11_rules,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
}
