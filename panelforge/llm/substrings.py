"""Removal of long passages that repeat, found by difference-cover anchors.

A difference cover of period ``PERIOD`` holds, for any two positions, one shift that moves both onto cover positions.
Anchors of ``window - PERIOD + 1`` words are hashed at cover positions only, so that any two equal windows share an
anchor at the same place inside them. Anchors held by two different texts are extended to the whole windows around them,
and only those windows are hashed and compared. Two 64-bit hashes decide that two windows are equal.

Texts of the same words are told by their sequence hash first: all but the one with the smallest id lose every word of
their windows at once. Null and word-free texts have no words. Minima are combined before every shuffle, so that a
passage in a third of all documents costs one row per task; documents are never paired. Windows are judged on the input.

Every row is judged on its own. Where ids repeat, rows are numbered first, and stand as pairs of id and number in the place
of the id; rows of one id are judged against other ids only. Rows without an id lose nothing and take nothing from others.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelforge.llm.common import discard, hashed_words, sequence_hash, slices, stored, utf8, window_hashes, word_spans

#: A perfect difference cover: every distance modulo 31 is a difference of two of its members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def told_apart(df: DataFrame, text: str, key: str) -> DataFrame:
    """``df`` as ``id``, ``text`` and the row's other columns as ``row``; ``id`` is the key, or where keys repeat ``(id, number)``.

    In the second case the frame is stored, so that numbers stay.
    """
    packed = df.select(df[key].alias("id"), df[text].alias("text"), F.struct(*[c for c in df.columns if c != text]).alias("row"))
    if df.groupBy(key).count().where("count > 1").select(F.lit(1)).isEmpty():
        return packed
    numbered = packed.withColumn("id", F.struct("id", F.monotonically_increasing_id().alias("number")))
    return stored(numbered, "numbered")


def _is_pair(df: DataFrame) -> bool:
    return isinstance(df.schema["id"].dataType, T.StructType)


def _doc(df: DataFrame, column: Column | str = "id") -> Column:
    """The document's id in an id column, for comparisons."""
    column = F.col(column) if isinstance(column, str) else column
    return column.getField("id") if _is_pair(df) else column


def _per_document(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Text, word starts, word ends and word hashes of each document of a slice."""
    joined = b"\n".join(texts)
    starts, ends, hashes = hashed_words(np.frombuffer(joined, dtype=np.uint8))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(starts, at)
    for i, text in enumerate(texts):
        part = slice(cuts[i], cuts[i + 1])
        yield text, starts[part] - at[i], ends[part] - at[i], hashes[part]


def _kept_text(text: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> bytes:
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    return b" ".join([text[s:e] for s, e in zip(starts.tolist(), ends.tolist())])


def summaries(df: DataFrame, window: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, number of words, digest of all words, hash of the word sequence, and anchors in text order."""
    size = window - PERIOD + 1
    cover = np.array(sorted(COVER))
    schema = T.StructType(
        [
            T.StructField("id", df.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("sha", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("seq2", T.LongType()),
            T.StructField("anchors", T.ArrayType(T.LongType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, anchors, offsets = [], [], [0]
            for text, starts, ends, words in _per_document(utf8(batch, "text")):
                all_words = sha256(_kept_text(text, starts, ends)).hexdigest()
                rows.append((len(words), all_words, sequence_hash(words), sequence_hash(words, 1)))
                hashes = window_hashes(words, size) if len(words) >= window else np.empty(0, dtype=np.uint64)
                anchors.append(hashes[_at_cover(len(hashes), cover)].view(np.int64))
                offsets.append(offsets[-1] + len(anchors[-1]))
            n, sha, seq, seq2 = zip(*rows)
            values = pa.array(np.concatenate(anchors), pa.int64())
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(seq, pa.int64()), pa.array(seq2, pa.int64())]
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(df[key].alias("id"), df[text].alias("text")).mapInArrow(run, schema)


def _at_cover(n: int, cover: np.ndarray) -> np.ndarray:
    """Cover positions below ``n``, ascending."""
    places = (np.arange(0, n + PERIOD, PERIOD)[:, None] + cover[None, :]).ravel()
    return places[places < n]


def _position(ordinal):
    """Word position of the anchor with this ordinal."""
    cover = F.array(*[F.lit(c) for c in sorted(COVER)])
    n = F.lit(len(COVER))
    return F.floor(ordinal / n).cast("int") * PERIOD + F.get(cover, (ordinal % n).cast("int"))


def shared_anchors(texts: DataFrame) -> DataFrame:
    """Per document with any: ``id`` and ``spots``, the places of anchors that another id has too.

    ``spots`` are positions, doubled, plus one where a document with a smaller id holds the anchor.
    """
    # The document follows from the id, so that it need not travel beside it.
    held = texts.select("id", F.posexplode("anchors").alias("ordinal", "anchor"))
    twice = stored(
        held.groupBy("anchor")
        .agg(F.min(_doc(held)).alias("least"), F.max(_doc(held)).alias("last"))
        .where("least <> last")
        .select("anchor", "least"),
        "twice",
        tidy=True,
    )
    spots = held.join(twice, "anchor")
    spot = _position(F.col("ordinal")) * 2 + (F.col("least") < _doc(spots)).cast("int")
    return spots.select("id", spot.alias("spot")).groupBy("id").agg(F.collect_list("spot").alias("spots"))


def _near(spots: np.ndarray, n: int, window: int) -> np.ndarray:
    """Marks the starts of windows that hold one of the anchor positions where a shared anchor must lie."""
    starts = n - window + 1
    edges = np.zeros(starts + 1, dtype=np.int64)
    np.add.at(edges, np.maximum(spots - (PERIOD - 1), 0), 1)
    np.add.at(edges, np.minimum(spots + 1, starts), -1)
    return np.cumsum(edges[:-1]) > 0


def _candidates(df: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """``(id, at, late, h, h2)``: hashes of the windows around shared anchors; ``late`` if a smaller id may hold it."""
    schema = T.StructType(
        [
            T.StructField("id", df.schema["id"].dataType),
            T.StructField("at", T.ArrayType(T.IntegerType(), False)),
            T.StructField("late", T.ArrayType(T.BooleanType(), False)),
            T.StructField("h", T.ArrayType(T.LongType(), False)),
            T.StructField("h2", T.ArrayType(T.LongType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marks = batch.column("spots")
            parts, offsets = [], [0]
            for i, (_, _, _, words) in enumerate(_per_document(utf8(batch, "text"))):
                spot = marks[i].values.to_numpy()
                spot = spot[(spot >> 1) + window - PERIOD < len(words)]
                if len(words) < window:
                    spot, words = spot[:0], np.zeros(window, dtype=np.uint64)
                place = spot >> 1
                near = np.flatnonzero(_near(place, len(words), window))
                late = _near(place[spot & 1 == 1], len(words), window)[near]
                parts.append((near.astype(np.int32), late, window_hashes(words, window)[near].view(np.int64), window_hashes(words, window, 1)[near].view(np.int64)))
                offsets.append(offsets[-1] + len(near))
            bounds = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(values))) for values in zip(*parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists], names=schema.names)

    return df.join(spots, "id").select("id", "text", "spots").mapInArrow(run, schema)


def repeated_windows(found: DataFrame) -> DataFrame:
    """Per document with any: ``id`` and ``starts``, where windows start that a document with a smaller id holds too."""
    held = found.select("id", F.explode(F.arrays_zip("at", "late", "h", "h2")).alias("w")).select("id", "w.*")
    # One row per window hash: its smallest id with the second hash there, and whether another id holds it.
    first = held.groupBy("h").agg(F.min(F.struct(_doc(held).alias("doc"), "h2")).alias("first"), F.max(_doc(held)).alias("last")).where("first.doc < last")
    again = held.where("late").join(first, "h").where((F.col("first.doc") < _doc(held)) & (F.col("first.h2") == F.col("h2")))
    return again.groupBy("id").agg(F.collect_list("at").alias("starts"))


def judged(df: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """Two tables by ``id``, from rows that are told apart: a summary of every row with ``copy`` (all windows repeat), and
    repeated window starts."""
    texts = stored(summaries(df, window, "text", "id"), "texts")
    doc = _doc(texts)
    least = texts.where(F.col("n_words") >= window).groupBy("seq", "seq2", "n_words").agg(F.min(doc).alias("least"), F.max(doc).alias("last"))
    copied = least.where("least < last").drop("last")
    rows = (
        texts.drop("anchors")
        .join(copied, ["seq", "seq2", "n_words"], "left")
        .select("id", "n_words", "sha", F.coalesce(F.col("least") < doc, F.lit(False)).alias("copy"))
    )
    rows = stored(rows, "rows")
    whole = rows.where("copy").select("id").distinct()
    first = texts.where((F.size("anchors") > 0) & doc.isNotNull()).select("id", "anchors").join(whole, "id", "left_anti")
    spots = stored(shared_anchors(first), "spots", tidy=True)
    discard(texts)
    found = stored(_candidates(df, spots, window), "windows", tidy=True)
    starts = stored(repeated_windows(found), "starts", tidy=True)
    discard(found)
    return rows, starts


def _cut(df: DataFrame, window: int) -> DataFrame:
    """``df(row, text, starts)``: the row with the number of removed words and the kept text; without starts, the text as it is."""
    schema = T.StructType([df.schema["row"], T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marked = batch.column("starts").is_valid()
            part = batch.select(["text", "starts"]).filter(marked)
            marks = part.column("starts")
            removed, kept = np.zeros(batch.num_rows, dtype=np.int64), []
            for i, (text, starts, ends, words) in enumerate(_per_document(utf8(part, "text")) if part.num_rows else ()):
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                at = marks[i].values.to_numpy()
                at = at[at + window <= len(words)]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept.append((int(gone.sum()), _kept_text(text, starts, ends, ~gone).decode("utf-8")))
            texts = batch.column("text")
            if kept:
                removed[marked.to_numpy(zero_copy_only=False)] = [n for n, _ in kept]
                texts = pc.replace_with_mask(texts, marked, pa.array([k for _, k in kept], texts.type))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(removed), texts], names=schema.names)

    return df.select("row", "text", "starts").mapInArrow(run, schema)


def removed_words(df: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_words``, ``n_removed`` and ``kept_sha256`` of the kept words joined by one space."""
    told = told_apart(df.select(key, text), text, key)
    rows, starts = judged(told, window)
    cuts = _cut(told.select("id", "text").join(starts, "id").withColumnRenamed("id", "row"), window)
    cuts = cuts.select(F.col("row").alias("id"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    empty = F.lit(sha256(b"").hexdigest())
    plain = (
        rows.join(starts.select("id"), "id", "left_anti")
        .select("id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"), F.when(F.col("copy"), empty).otherwise(F.col("sha")).alias("kept_sha256"))
    )
    cut = cuts.join(rows.select("id", "n_words"), "id").select("id", "n_words", "n_removed", "kept_sha256")
    both = plain.unionByName(cut)
    return both.select(_doc(both).alias(key), "n_words", "n_removed", "kept_sha256")


def without_repeats(df: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with repeated passages cut out of ``text``; rows that lose every word go, untouched ones keep their text as it is."""
    told = told_apart(df, text, key)
    rows, starts = judged(told, window)
    none = F.lit(None).cast(starts.schema["starts"].dataType)
    found = starts.select("id", "starts", F.lit(False).alias("copy")).unionByName(rows.where("copy").select("id", none.alias("starts"), "copy"))
    # A text travels once, whether it is cut or not.
    left = told.join(found, "id", "left").where(~F.coalesce("copy", F.lit(False)))
    cuts = _cut(left, window).where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    return cuts.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
