"""Near-duplicate vectors by binary codes of randomised rotations.

Every vector is rotated at random and kept as one sign bit per dimension, with the inner product of the code and the
rotated unit vector as correction factor. Code times rotated vector, divided by the factor, is an unbiased estimate of
the cosine of two vectors, with an error bound that holds with high probability. Pairs whose upper bound reaches the
threshold are computed again in double precision; no link rests on an estimate.

Pairs meet in buckets: bits of further rotations are keys of several tables, as many that a pair at the threshold meets
with probability ``recall``; nearer pairs meet almost surely. Tables and bits follow from the number of vectors, so that
a bucket holds about ``OCCUPANCY`` of them at any size. A larger bucket is cut into chunks that meet two by two in
tasks of their own; nothing is dropped. A pair is counted in the first table in which it meets. A task returns a row per
vector (its links there and one edge to a root), never its pairs.

Equal vectors are one node with a weight. Vectors that are null, zero, or hold null or non-finite components link with
nothing. Vectors of different lengths never link. Ids should be unique: vectors that share an id share a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from panelforge.llm.common import stored
from panelforge.llm.graph import components
from panelforge.llm.vectors import by_length, matrix, usable

OCCUPANCY = 512
CHUNK = 1024
#: Width of the confidence bound in units of the estimator's scale.
SIGMAS = 5.0
MOST_BITS = 24


@lru_cache(maxsize=64)
def rotation(dim: int, which: int) -> np.ndarray:
    """A random rotation that every worker derives alike."""
    q, r = np.linalg.qr(np.random.default_rng([17, dim, which]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(n, 1) / OCCUPANCY))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if meet == 1 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated vectors and their correction factors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ rotation(x.shape[1], 0)
    bits = turned > 0
    return bits, np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1])


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A key of ``bits`` sign bits for each table."""
    dim = x.shape[1]
    need = bits * tables
    signs = np.concatenate([x @ rotation(dim, 1 + r) > 0 for r in range(math.ceil(need / dim))] or [np.empty((len(x), 0), bool)], axis=1)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, t * bits : (t + 1) * bits] @ weights for t in range(tables)], axis=1).astype(np.int32)


def index(df: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(node, weight, vec)`` with packed ``code``, ``factor`` and ``keys``."""
    schema = T.StructType(
        [
            *df.select("node", "weight", "vec").schema.fields,
            T.StructField("code", T.BinaryType()),
            T.StructField("factor", T.DoubleType()),
            T.StructField("keys", T.ArrayType(T.IntegerType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, "vec"):
                x = matrix(batch.column("vec"))
                signs, factor = codes(x)
                packed = [row.tobytes() for row in np.packbits(signs, axis=1)]
                keys = pa.FixedSizeListArray.from_arrays(pa.array(table_keys(x, bits, tables).ravel()), tables).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary()), pa.array(factor), keys], names=schema.names)

    return df.select("node", "weight", "vec").mapInArrow(run, schema)


def _upper(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Upper bounds of the cosines of coded rows (down) with rotated unit vectors (across)."""
    dim = signs.shape[1]
    if dim < 8:
        return np.full((len(signs), len(turned)), np.inf)
    estimate = ((2.0 * signs - 1) / math.sqrt(dim)) @ turned.T / factor[:, None]
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(dim - 1)
    return estimate + SIGMAS * spread[:, None]


def compare(rows: pd.DataFrame, table: int, same_chunk: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs of one block."""
    x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
    dim = x.shape[1]
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotation(dim, 0)
    signs = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(x), -1), axis=1, count=dim)
    upper = _upper(signs, rows["factor"].to_numpy(), turned)
    i, j = np.nonzero(np.triu(np.maximum(upper, upper.T) >= threshold, 1))
    if not same_chunk:
        chunk = rows["chunk"].to_numpy()
        i, j = (side[chunk[i] != chunk[j]] for side in (i, j))
    keys = np.stack(rows["keys"].to_numpy())[:, :table]
    linked = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        first = ~(keys[a] == keys[b]).any(axis=1)
        cosine = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b])
        linked[at : at + (1 << 16)] = first & (cosine >= threshold)
    return i[linked], j[linked]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches by pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = np.minimum(after, after[after])
        if (after == root).all():
            return root
        root = after


def links(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``(node, root, links)`` of every block: weighted links counted there and one node reached there."""
    bits, tables = plan(nodes.count(), threshold, recall)
    indexed = stored(index(nodes, bits, tables), "codes")
    entries = indexed.select("*", F.size("vec").alias("dim"), F.posexplode("keys").alias("table", "key"))
    place = ["dim", "table", "key"]
    held = entries.groupBy(place).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rows = (
        entries.join(held.select(*place, chunks.alias("chunks")), place)
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", "weight", "vec", "code", "factor", "keys", "table", "key", "dim", "chunk",
                F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    )
    node_type = nodes.schema["node"].dataType.simpleString()

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        i, j = compare(rows, int(rows["table"][0]), bool(rows["low"][0] == rows["high"][0]), threshold)
        weight = rows["weight"].to_numpy()
        count = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
        root = _roots(len(rows), i, j)
        seen = np.flatnonzero(count)
        node = rows["node"].to_numpy()
        return pd.DataFrame({"node": node[seen], "root": node[root[seen]], "links": count[seen].astype(np.int64)})

    return rows.groupBy(*place, "low", "high").applyInPandas(block, f"node {node_type}, root {node_type}, links bigint")


def near_duplicates(df: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, recall: float = 0.99) -> DataFrame:
    """Per row: key, ``n_links`` (other vectors at a cosine of ``threshold`` or more), ``component_id``, ``kept``."""
    slim = df.select(df[key].alias("id"), df[vec].alias("vec"))
    fine = slim.where(usable(F.col("vec")))
    nodes = stored(fine.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")), "nodes")
    found = stored(links(nodes.where("node is not null"), threshold, recall), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    facts = nodes.join(counted, "node", "left").join(roots, "node", "left").select("vec", "node", "weight", "links", "root")
    own = fine.join(facts, "vec").select(
        "id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"), F.coalesce("root", "node").alias("component_id")
    )
    rest = slim.where(~usable(F.col("vec"))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return own.unionByName(rest).select(F.col("id").alias(key), "n_links", "component_id", kept)
