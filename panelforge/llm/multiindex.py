"""Nearest neighbours by largest inner product through an inverted multi-index.

Vectors get one more component that gives all the same length, so that the nearest by distance have the largest inner
product. Both halves are quantised by codebooks of their own; a pair of codewords is a cell. For a query, a heap walks
over pairs of codewords by summed distance until the cells hold ``share`` of all rows. The rows of those cells are
ranked again by their exact inner product in double precision.

Codebooks are fitted on at most ``SAMPLE`` rows (by hash of the id); every row is indexed. Cells are cut into chunks of
rows and queries into blocks that meet in tasks of bounded size, so that a crowded cell spreads. ``share`` bounds the
walk, which makes the search approximate; recall against brute force is measured in the tests, with
walks that stop. Tables of up to ``least`` usable rows are searched whole.

Vectors that are null, zero, or hold null or non-finite components, or whose length is not that of the others, take no
part; the length is the most common one. Rows that share the query's id are the query's own. A table without usable
vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelforge.llm.common import stored
from panelforge.llm.vectors import matrix, usable

SAMPLE = 20_000
CODEWORDS = 32
SHARE = 0.6
#: Rows below which a walk does not stop.
LEAST = 2_000
CHUNK = 2_048


def codebook(x: np.ndarray, size: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's algorithm."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, label, x)
        count = np.bincount(label, minlength=len(centres))
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(axis=1)


class Index:
    """Codebooks of both halves and the rows of every cell."""

    def __init__(self, sample: np.ndarray, longest: float, codewords: int):
        self.longest = longest
        self.cut = sample.shape[1] // 2
        a, b = self.halves(sample)
        self.a, self.b = codebook(a, codewords), codebook(b, codewords)
        self.counts = np.zeros((len(self.a), len(self.b)), dtype=np.int64)

    def halves(self, x: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Both halves; a row's extra component fills its length up to the longest, a query's is zero."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return x[:, : self.cut], np.column_stack([x[:, self.cut :], extra])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return nearest(a, self.a), nearest(b, self.b)

    def walk(self, da: np.ndarray, db: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """Cells by summed distance of their codewords until they hold ``wanted`` rows; empty cells are passed over."""
        by_a, by_b = np.argsort(da, kind="stable").tolist(), np.argsort(db, kind="stable").tolist()
        da, db = da.tolist(), db.tolist()
        counts = self.counts
        heap = [(da[by_a[0]] + db[by_b[0]], 0, 0)]
        cells = []
        while heap and wanted > 0:
            _, i, j = heappop(heap)
            a, b = by_a[i], by_b[j]
            if counts[a, b]:
                cells.append((a, b))
                wanted -= int(counts[a, b])
            # Every pair is pushed once: along a row always, down a column from its first pair only.
            if j + 1 < len(by_b):
                heappush(heap, (da[a] + db[by_b[j + 1]], i, j + 1))
            if j == 0 and i + 1 < len(by_a):
                heappush(heap, (da[by_a[i + 1]] + db[b], i + 1, 0))
        return cells


def fit(rows: DataFrame, codewords: int) -> Index | None:
    """Codebooks from a bounded sample of ``(id, vec)``, chosen by hash of the id."""
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    if longest is None:
        return None
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()
    return Index(matrix(sample.column("vec")), longest, codewords)


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """``(id, vec, a, b)``: the codewords of both halves of every row."""
    schema = T.StructType([*rows.schema.fields, T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = index.cells(matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def walks(queries: DataFrame, index: Index, wanted: int) -> DataFrame:
    """``(id, vec, a, bs)``: for each query and codeword of the first half, the second codewords it visits."""
    schema = T.StructType([*queries.schema.fields, T.StructField("a", T.IntegerType()), T.StructField("bs", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = index.halves(matrix(batch.column("vec")), query=True)
            rows, firsts, seconds = [], [], []
            for n, (da, db) in enumerate(zip(distances(a, index.a), distances(b, index.b))):
                visited: dict[int, list[int]] = {}
                for i, j in index.walk(da, db, wanted):
                    visited.setdefault(i, []).append(j)
                rows += [n] * len(visited)
                firsts += visited.keys()
                seconds += visited.values()
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(firsts, pa.int32()), pa.array(seconds, pa.list_(pa.int32()))], names=schema.names)

    return queries.mapInArrow(run, schema)


def best(x: np.ndarray, ids: np.ndarray, query: np.ndarray, allowed: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the ``k`` allowed rows with the largest inner product, ties to the smaller id."""
    rows = np.flatnonzero(allowed)
    if len(rows) > k:
        floor = np.partition(rough[rows], len(rows) - k)[len(rows) - k]
        rows = rows[rough[rows] >= floor - 1e-9 * max(1.0, abs(floor))]
    score = (x[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][order], score[order]


def nearest_rows(
    df: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vec: str = "embedding",
    k: int = 20,
    share: float = SHARE,
    codewords: int = CODEWORDS,
    least: int = LEAST,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row its ``k`` nearest found among the other rows."""
    slim = df.select(df[key].alias("id"), df[vec].alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable(F.col("vec")) & F.col("id").isNotNull())
    length = slim.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    id_type = df.schema[key].dataType
    out = T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", id_type), T.StructField("score", T.DoubleType())])
    if length is None:
        return df.sparkSession.createDataFrame([], out)
    slim = slim.where(F.size("vec") == length.n)
    index = fit(slim.select("id", "vec"), codewords)
    cells = stored(assign(slim.select("id", "vec", "asks"), index), "cells")
    for row in cells.groupBy("a", "b").count().collect():  # one short row per cell, at most codewords squared
        index.counts[row.a, row.b] = row["count"]
    wanted = max(int(np.ceil(share * index.counts.sum())), min(least, int(index.counts.sum())))
    asked = cells.where("asks").select("id", "vec")
    blocks = max(1, -(-asked.count() // CHUNK))
    chunks = np.maximum(1, -(-index.counts.sum(1) // CHUNK)).tolist()
    parts = F.get(F.array(*[F.lit(int(c)) for c in chunks]), F.col("a"))
    members = cells.select(
        F.col("id"), "vec", "a", "b", F.pmod(F.xxhash64("id"), parts).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    asking = walks(asked, index, wanted).select(
        "id", "vec", "a", "bs", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("chunk")
    )
    codewords_b = len(index.b)

    def rank_block(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(asks):
            x, ids, b = np.stack(rows["vec"].to_numpy()).astype(np.float64), rows["id"].to_numpy(), rows["b"].to_numpy()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                q = np.stack(part["vec"].to_numpy()).astype(np.float64)
                rough = q @ x.T
                for n, (qid, bs) in enumerate(zip(part["id"], part["bs"])):
                    visited = np.zeros(codewords_b, dtype=bool)
                    visited[bs] = True
                    near, score = best(x, ids, q[n], visited[b] & (ids != qid), rough[n], k)
                    found.append(pd.DataFrame({"query_id": qid, "vec_id": near, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    name = id_type.simpleString()
    place = ["a", "chunk", "block"]
    found = members.groupBy(*place).cogroup(asking.groupBy(*place)).applyInPandas(rank_block, f"query_id {name}, vec_id {name}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
