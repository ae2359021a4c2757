"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to a few owners, rare terms to the first, frequent ones to the last. A bundle is a block
of items over one shard of documents; it carries a sparse table of accumulators (item, document, score so far). In each
stage the bundles are cogrouped with the postings of that stage's owner, which adds its integer contributions; the bundle
goes on to the next owner. The last one selects each item's best documents of the shard, and the shards' best are ranked.

Whole results, bounded bundles: a shard holds at most ``SHARD`` documents and a block about ``ITEMS`` items. A term that
half of all documents hold is spread over all shards. An accumulator is left behind only where it provably cannot reach
the item's ``k`` best: all contributions are at least zero, so that the k-th best score so far in the shard is a lower
bound of the k-th best of all, and the terms of later owners add less than their weight times 1,000,000 each.

Every row is a document or an item of its own, also under a repeated or null id; a document's null id ranks behind all
other ids of the same score. Null and empty texts have no terms: such items get no rows. Equal scores go by ascending id;
equal rows under one id by an arbitrary but fixed place. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelforge.llm.common import slices, stored

#: Documents of a shard and items of a block: a bundle has at most about their product of accumulators.
SHARD = 1 << 14
ITEMS = 256
#: A term belongs to the first owner whose share of the documents its own does not exceed; the last owner has the rest.
OWNERS = (0.001, 0.02, 0.2)
#: Terms and bytes of the items' vocabulary up to which every task gets it, so that other terms end in the scan. A larger
#: vocabulary is joined by term; the result is the same.
MOST_TERMS = 1 << 20
MOST_BYTES = 1 << 26
#: Above any contribution of a term of weight one.
TOP = 1_000_000
#: A text beyond so many bytes is counted term by term, without a list of all its terms.
LONG = 1 << 22
LAST_ID = (1 << 63) - 1

# Bytes of UTF-8 that terms are made of: every character from U+0080 on, digits and letters.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def counted(text: bytes, wanted) -> tuple[int, Counter]:
    """Number of all terms of a text, and the occurrences of the wanted ones (all if ``wanted`` is None)."""
    text = text.translate(_LOWER)
    if len(text) > LONG:
        n, counts = 0, Counter()
        for match in _TERM.finditer(text):
            n += 1
            term = match.group()
            if wanted is None or term in wanted:
                counts[term] += 1
        return n, counts
    terms = _TERM.findall(text)
    return len(terms), Counter(terms if wanted is None else filter(wanted.__contains__, terms))


def with_terms(df: DataFrame, key: str, text: str, numbers: dict[bytes, int] | None) -> DataFrame:
    """A stored row per row of ``df``: ``row`` (its number), ``key``, ``n`` terms, and ``terms`` with their occurrences ``tf``.

    Terms are numbers if ``numbers`` names the wanted ones, and texts otherwise.
    """
    kind = T.StringType() if numbers is None else T.LongType()
    schema = T.StructType(
        [T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(kind)), T.StructField("tf", T.ArrayType(T.LongType()))]
    )
    arrow = pa.list_(pa.string() if numbers is None else pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, terms, often = [], [], []
            for value in batch.column("text").cast(pa.binary()):
                n, counts = counted(value.as_py() or b"", numbers)
                sizes.append(n)
                terms.append([t.decode() for t in counts] if numbers is None else [numbers[t] for t in counts])
                often.append(list(counts.values()))
            columns = [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(terms, arrow), pa.array(often, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "terms", "tf"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    # Numbered where it is written: the stored numbers stay, whichever task is run again.
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "key", "n", "terms", "tf"), "terms")


def _postings(docs: DataFrame, vocabulary: DataFrame, numbered: bool) -> DataFrame:
    """A row per document and item term: ``row, n, term`` (number) and ``tf``."""
    pairs = docs.select("row", "n", F.explode(F.arrays_zip("terms", "tf")).alias("p")).select("row", "n", F.col("p.terms").alias("term"), F.col("p.tf").alias("tf"))
    if numbered:
        return pairs
    joined = pairs.withColumnRenamed("term", "name").join(vocabulary, "name").select("row", "n", "term", "tf")
    return stored(joined, "postings")


def owner(df: Column, docs: int, owners: tuple[float, ...] = OWNERS) -> Column:
    """Number of the owner of a term that ``df`` of ``docs`` documents hold."""
    number = F.lit(len(owners))
    for n in range(len(owners) - 1, -1, -1):
        number = F.when(df <= owners[n] * docs, n).otherwise(number)
    return number


_BUNDLE = (
    "block INT, shard BIGINT, items ARRAY<BIGINT>, terms ARRAY<BIGINT>, weights ARRAY<BIGINT>, owners ARRAY<INT>,"
    " acc_item ARRAY<INT>, acc_place ARRAY<INT>, acc_score ARRAY<BIGINT>, acc_id ARRAY<BIGINT>"
)


def _numpy(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def add_stage(number: int, last: int, k: int, size: int):
    """The work of one owner on one bundle: ``(bundle, postings) -> bundle``, for a cogroup.

    A posting is ``term, place`` (of the document in its shard) and ``value``. The last stage's postings also hold every
    document's id under the term -1, and its bundle keeps each item's ``k`` best documents.
    """

    def work(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundle.num_rows:
            return bundle
        items, terms, weights, owners = (_numpy(bundle, c) for c in ("items", "terms", "weights", "owners"))
        acc_item, acc_place, acc_score = (_numpy(bundle, c) for c in ("acc_item", "acc_place", "acc_score"))
        term = postings.column("term").to_numpy()
        order = np.argsort(term, kind="stable")
        term, place, value = term[order], postings.column("place").to_numpy()[order], postings.column("value").to_numpy()[order]
        ids = np.full(size, LAST_ID, dtype=np.int64)
        if number == last:
            end = int(np.searchsorted(term, 0))
            ids[place[:end]] = value[:end]
        kinds, which = np.unique(items, return_inverse=True)
        begins = np.searchsorted(acc_item, np.arange(len(kinds) + 1))
        now, later = owners == number, owners > number
        more = np.bincount(which[later], weights[later].astype(np.float64) * TOP, len(kinds))
        out = []
        for i in range(len(kinds)):
            score = np.zeros(size, dtype=np.int64)
            carried = slice(begins[i], begins[i + 1])
            score[acc_place[carried]] = acc_score[carried]
            for t in terms[now & (which == i)]:
                held = slice(*np.searchsorted(term, (t, t + 1)))
                score[place[held]] += value[held]
            places = np.flatnonzero(score)
            if len(places) > k:
                if number == last:
                    places = np.sort(places[np.lexsort((places, ids[places], -score[places]))[:k]])
                else:
                    bound = np.partition(score[places], len(places) - k)[len(places) - k]
                    places = places[score[places] + more[i] >= bound]
            out.append((np.full(len(places), i, dtype=np.int32), places.astype(np.int32), score[places], ids[places]))
        parts = [np.concatenate(p) for p in zip(*out)]
        fixed = {c: bundle.column(c) for c in ("block", "shard", "items", "terms", "weights", "owners")}
        kinds_of = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        grown = {c: pa.array([p], pa.list_(t)) for c, p, t in zip(("acc_item", "acc_place", "acc_score", "acc_id"), parts, kinds_of)}
        return pa.table({**fixed, **grown})

    return work


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text", item_text: str = "text",
    most_terms: int = MOST_TERMS, items_per_block: int = ITEMS, owners: tuple[float, ...] = OWNERS, shard_size: int = SHARD,
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``, scores above zero.

    ``shard_size`` is a power of two.
    """
    shard = F.shiftright("row", shard_size.bit_length() - 1).alias("shard")
    asked = with_terms(items, item_key, item_text, None)
    n_items = asked.count()
    blocks = max(1, -(-n_items // items_per_block))
    wanted = asked.select("row", F.explode("terms").alias("name"))
    vocabulary = stored(wanted.select("name").distinct().select("name", F.monotonically_increasing_id().alias("term")), "vocabulary")
    size, width = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
    numbered = size <= most_terms and width <= MOST_BYTES
    # Sent to every task only where both bounds hold.
    numbers = {r.name.encode(): r.term for r in vocabulary.collect()} if numbered else None
    counts = with_terms(docs, key, text, numbers)
    n_docs, n_terms = counts.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        n_docs, n_terms = 1, 1
    postings = _postings(counts, vocabulary, numbered)
    held = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    terms = stored(held.select("term", weight.alias("w"), owner(F.col("df"), n_docs, owners).cast("int").alias("owner")), "weights")

    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")
    links = wanted.join(vocabulary, "name").join(terms, "term").select(F.col("row").alias("item"), "term", "w", "owner").select("*", block)
    links = stored(links, "links")
    columns = [F.col(f"all.{c}").alias(name) for c, name in (("item", "items"), ("term", "terms"), ("w", "weights"), ("owner", "owners"))]
    heads = links.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "term", "w", "owner"))).alias("all")).select("block", *columns)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    shards = counts.select(shard).distinct().select("shard", each_block)
    none = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("acc_item", "int"), ("acc_place", "int"), ("acc_score", "bigint"), ("acc_id", "bigint"))]
    bundles = shards.join(heads, "block").select("block", "shard", "items", "terms", "weights", "owners", *none)

    place = F.col("row").bitwiseAND(shard_size - 1).cast("int").alias("place")
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {n_terms}L")
    part = F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    valued = postings.withColumn("m", m).select("term", shard, place, part.alias("part"))
    wants = links.select("block", "term", "w", "owner").distinct()
    last = len(owners)
    ids = counts.where("n > 0").select(each_block, shard, F.lit(-1).cast("bigint").alias("term"), place, F.coalesce(F.col("key").cast("bigint"), F.lit(LAST_ID)).alias("value"))
    for number in range(last + 1):
        own = valued.join(wants.where(F.col("owner") == number), "term").select("block", "shard", "term", "place", (F.col("w") * F.col("part")).alias("value"))
        if number == last:
            own = own.unionByName(ids)
        bundles = bundles.groupBy("block", "shard").cogroup(own.groupBy("block", "shard")).applyInArrow(add_stage(number, last, k, shard_size), _BUNDLE)
    kinds = F.array_distinct("items").alias("kinds")  # sorted, as the stages number them
    best = bundles.select("shard", kinds, F.explode(F.arrays_zip("acc_item", "acc_place", "acc_score", "acc_id")).alias("a"))
    best = best.select(F.get("kinds", F.col("a.acc_item")).alias("row"), "shard", F.col("a.acc_place").alias("place"), F.col("a.acc_score").alias("score"), F.col("a.acc_id").alias("id"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "id", "shard", "place")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = ranked.join(asked.select("row", F.col("key").alias(item_key)), "row")
    return named.select(item_key, "rank", F.when(F.col("id") != LAST_ID, F.col("id")).alias(key), "score")
