"""Whitened embeddings by incremental eigendecomposition.

Entries become whole numbers ``x = floor(1024 * c) + 100000``, so that counts, sums and deviations are exact. Every
partition follows the spectrum of its vectors by centred rank-one updates (``spectra.py``); the spectra of sixteen
partitions at a time are joined by rank-one updates until one is left. Its eigenvectors are the basis of a last pass over
all vectors, which projects the exactly centred vectors, sums their products over the partitions and solves the small
problem (Rayleigh-Ritz). A further pass measures how far the whitened vectors' covariance is from the identity.

What travels is one spectrum or one matrix of width x width a partition, never vectors; equal vectors of one batch are
one update with their number as weight.

Vectors that are null, empty, or hold null or non-finite entries are left out, as are those with an entry too large for
whole numbers (beyond 2**31) and those whose length is not the most frequent one (the longer of equals). Repeated rows and
ids count as often as they occur; null ids stay. A component without variance (fewer distinct vectors than components)
has ``whitened`` null and ``explained`` zero and does not count for ``identity_error``, which is null if no component has
variance. ``deviation`` is null where it does not fit 64 bits. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from panelforge.llm.common import stored
from panelforge.llm.spectra import EPS, Spectrum

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 31
COMPONENTS = 8
#: Spectra joined by one task.
JOINED = 16


def whole_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and whole-number vectors of the rows that take part."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(places))).cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False).reshape(len(places), width)
    with np.errstate(invalid="ignore"):
        fine = (np.abs(values) * SCALE < LARGEST - SHIFT - 1).all(axis=1)  # false for NaN and infinities
    return places[fine], np.floor(SCALE * values[fine]).astype(np.int64) + SHIFT


def _common_width(df: DataFrame, vector: str) -> int | None:
    sizes = df.select(F.size(vector).alias("width")).where("width > 0").groupBy("width").count()
    top = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return top.width if top else None


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.col(vector).alias("v"))


def _totals(df: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            _, x = whole_vectors(batch.column("v"), width)
            n += len(x)
            sums += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums])], names=["n", "sums"])

    parts = _vectors(df, vector).mapInArrow(run, "n BIGINT, sums ARRAY<BIGINT>")
    rows = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = np.zeros(width, dtype=np.int64)
    for r in rows:
        sums[r.at] = r.s
    return (rows[0].n if rows else 0), sums


_SPECTRUM = "part INT, n BIGINT, mean ARRAY<DOUBLE>, vals ARRAY<DOUBLE>, vecs ARRAY<DOUBLE>"


def _packed(part: int, s: Spectrum) -> pa.Table:
    arrays = [pa.array([part], pa.int32()), pa.array([s.n], pa.int64()), *(pa.array([a.ravel()], pa.list_(pa.float64())) for a in (s.mean, s.values, s.vectors))]
    return pa.table(arrays, names=["part", "n", "mean", "vals", "vecs"])


def _unpacked(rows: pa.Table, width: int) -> Iterator[Spectrum]:
    for row in rows.to_pylist():
        s = Spectrum(width)
        s.n, s.mean, s.values, s.vectors = row["n"], np.array(row["mean"]), np.array(row["vals"]), np.array(row["vecs"]).reshape(width, width)
        yield s


def incremental_spectrum(df: DataFrame, vector: str, width: int) -> Spectrum:
    """The spectrum of all vectors: one per partition, joined sixteen at a time."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(width)
        for batch in batches:
            _, x = whole_vectors(batch.column("v"), width)
            distinct, often = np.unique(x, axis=0, return_counts=True)
            for row, times in zip(distinct.astype(np.float64), often.tolist()):
                s.add(row, times)
        yield from _packed(0, s).to_batches()

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        first, *others = _unpacked(rows, width)
        for other in others:
            first.join(other)
        return _packed(rows.column("part")[0].as_py() // JOINED, first)

    own = _vectors(df, vector).mapInArrow(follow, _SPECTRUM).withColumn("part", F.spark_partition_id())
    own = stored(own, "spectra")
    left = (own.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        own = own.groupBy(F.expr(f"part div {JOINED}").alias("group")).applyInArrow(joined, _SPECTRUM)
        left = -(-left // JOINED)
    rows = own.toArrow()
    return next(_unpacked(rows, width), Spectrum(width))


def _summed_products(df: DataFrame, vector: str, width: int, project, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``y`` and of ``y y'`` over all vectors, for ``y = project(x)`` of length ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            _, x = whole_vectors(batch.column("v"), width)
            y = project(x)
            total += y.sum(axis=0)
            products += y.T @ y
        both = np.vstack([total[None, :], products])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(list(both), pa.list_(pa.float64()))], names=["i", "row"])

    parts = _vectors(df, vector).mapInArrow(run, "i BIGINT, row ARRAY<DOUBLE>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    both = np.zeros((size + 1, size))
    for c in cells:
        both[c.i, c.j] = c.v
    return both[0], both[1:]


def refined(df: DataFrame, vector: str, width: int, n: int, sums: np.ndarray, spectrum: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance, by one Rayleigh-Ritz step over all vectors."""
    basis, _ = np.linalg.qr(spectrum.vectors[:, ::-1])
    total, products = _summed_products(df, vector, width, lambda x: (n * x - sums) / n @ basis, width)
    covariance = products / n - np.outer(total / n, total / n)
    values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
    vectors = (basis @ turn)[:, ::-1]
    heads = vectors[np.abs(vectors).argmax(axis=0), np.arange(width)]
    return np.maximum(values[::-1], 0), vectors * np.where(heads < 0, -1.0, 1.0)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares of whole numbers, null where they exceed 64 bits."""
    largest = int(np.abs(apart).max(initial=0))
    if largest <= math.isqrt(((1 << 63) - 1) // max(1, apart.shape[1])):
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    added = (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), *((c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, t) for c, t in added)])
    width = _common_width(df, vector)
    n, sums = _totals(df, vector, width) if width else (0, None)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    values, vectors = refined(df, vector, width, n, sums, incremental_spectrum(df, vector, width))
    shown = min(components, width)
    trace = float(values.sum())
    varied = int((values[:shown] > 8 * EPS * width * values[0]).sum()) if values[0] > 0 else 0
    scaled = vectors[:, :varied] / np.sqrt(values[:varied])
    explained = np.append(values[:varied] / trace if varied else [], np.zeros(shown - varied))
    error = None
    if varied:
        total, products = _summed_products(df, vector, width, lambda x: (n * x - sums) / n @ scaled, varied)
        covariance = products / n - np.outer(total / n, total / n)
        error = float(np.abs(covariance - np.eye(varied)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = whole_vectors(batch.column("v"), width)
            apart = n * x - sums
            shape = (len(x), shown)
            white = np.full(shape, np.nan)
            white[:, :varied] = apart / n @ scaled
            rows = np.repeat(places, shown)
            columns = [
                batch.column(key).take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n)),
                pa.array(deviations(apart), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), shown))),
                pa.array(white.ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x))),
                pa.array([error] * len(rows), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(key), F.col(vector).alias("v")).mapInArrow(run, schema)
