"""Whitening of embeddings: blockwise TSQR and a one-sided Jacobi SVD.

1. Entries become whole numbers, and each distinct vector of these is written
   once (the fit list), so sums over it are exact.
2. Each task centres its rows of the fit list and reduces them, block by block,
   to an upper triangle R by QR of R stacked on the next block. The triangles are
   stacked and reduced again in rounds of ``FAN_IN``, until one is left. It has as many
   rows as there are dimensions, whatever the number of vectors.
3. Plane rotations make R's columns orthogonal, two at a time, sweep by sweep.
   The rotations multiplied are the components; the columns' lengths, over the
   root of the number of vectors, are the standard deviations. No covariance
   is formed, so small ones keep their digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import staged

SCALE = 64
#: Whole numbers stay within this, so that doubles hold them exactly.
MOST = 1 << 52
#: Triangles that one task reduces to one, and rows stacked on a triangle at once.
FAN_IN, BLOCK = 32, 4096
SWEEPS = 60


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) as 64-bit numbers. The shift by 1,000,000 is left out, as all results are differences from the mean."""
    return np.clip(np.floor(vectors * SCALE), -MOST, MOST).astype(np.int64)


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the rows that remain, their lengths, their entries end to end)."""
    lists = batch["embedding"]
    if not pa.types.is_list(lists.type):
        lists = lists.cast(pa.list_(lists.type.value_type))
    entries = np.asarray(lists.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False))
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(sizes)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    keep = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    return np.flatnonzero(keep), sizes[keep], entries[np.repeat(keep, sizes)]


def packed(row: np.ndarray) -> bytes:
    """One form for each vector: 32-bit numbers where all fit, else 64-bit ones."""
    small = row.astype("<i4")
    return (small if (small == row).all() else row.astype("<i8")).tobytes()


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    kinds = {4 * dim: "<i4", 8 * dim: "<i8"}
    return np.array([np.frombuffer(x, kinds[len(x)]) for x in column.to_pylist()], np.int64).reshape(-1, dim)


def triangle(upper: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """R of ``upper`` stacked on ``rows``, filled up to a square with zeros."""
    r = np.linalg.qr(np.vstack((upper, rows)), mode="r")
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(r)] = r
    return out


def jacobi_svd(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns.

    Rotates each pair of columns until all are orthogonal to double precision."""
    columns, rotations = np.array(r, float).T.copy(), np.eye(r.shape[1])
    eps, n = np.finfo(float).eps, len(columns)
    for _ in range(SWEEPS):
        turned = False
        for i in range(n - 1):
            for j in range(i + 1, n):
                x, y = columns[i], columns[j]
                a, b, c = x @ x, y @ y, x @ y
                if abs(c) <= eps * math.sqrt(a * b):
                    continue
                turned = True
                tau = (b - a) / (2 * c)
                t = math.copysign(1.0, tau) / (abs(tau) + math.hypot(1.0, tau))
                cos = 1 / math.hypot(1.0, t)
                turn = np.array([[cos, -t * cos], [t * cos, cos]])
                columns[[i, j]], rotations[[i, j]] = turn @ columns[[i, j]], turn @ rotations[[i, j]]
        if not turned:
            break
    sizes = np.sqrt((columns**2).sum(1))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], rotations[order].T


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    * Rows whose vector is null, empty, or holds null or non-finite entries are
      dropped; so are rows of another length than most distinct vectors have (of
      equally frequent lengths the longest counts).
    * Entries c become x = floor(64 * c) + 1,000,000; far larger ones stop at 2^52.
      ``n`` is the number of distinct x-vectors, S their sum by dimension.
    * ``component`` counts from 1 by falling variance. Directions without variance
      (to double precision) are no components, so n = 1 gives no rows; there are
      at most as many as dimensions.
    * ``deviation`` is the sum of (n * x - S)^2, exact; null where it passes 64 bits.
    * ``whitened`` is x - S / n along the component over its standard deviation,
      ``explained`` its share of the variance, ``identity_error`` the largest entry of the
      covariance of ``whitened`` over the distinct vectors minus the identity.
    * Identifiers may be null or repeated; equal vectors give equal values. An
      empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sizes, entries = rows_of(batch)
            numbers, ends = whole(entries), np.cumsum(sizes)
            own = [packed(numbers[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32)), pa.array(own, pa.binary())], names=["dim", "x"])

    # Distinct in each task before it travels, so a vector with very many copies is sent once a task.
    fit = staged(plain.select("embedding").mapInArrow(pack, "dim int, x binary").distinct())
    most = fit.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    dim, n = most["dim"], most["n"]
    fit = fit.where(F.col("dim") == dim).select("x")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim  # Python's numbers don't overflow
        for batch in batches:
            x = unpacked(batch["x"], dim)
            # halves are summed apart, so a batch stays within 64 bits
            high, low = x >> 32, x & 0xFFFFFFFF
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, high.sum(0), low.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total])], names=["k", "total"])

    # Sums by dimension: a decimal holds 38 digits, and only one row a dimension comes back.
    parts = fit.mapInArrow(add, "k int, total string").groupBy("k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = [int(r["total"]) for r in sorted(parts.collect())]
    middle = [t // n for t in total]
    centre, rest = np.array(middle, np.int64), np.array([(t - m * n) / n for t, m in zip(total, middle)])
    left = np.array([t - m * n for t, m in zip(total, middle)], np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - centre).astype(float) - rest

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            x = centred(unpacked(batch["x"], dim))
            for at in range(0, len(x), BLOCK):
                r = triangle(r, x[at : at + BLOCK])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            for raw in batch["r"].to_pylist():
                r = triangle(r, np.frombuffer(raw).reshape(dim, dim))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    triangles = staged(fit.mapInArrow(reduce_rows, "r binary"))
    while (left_over := triangles.count()) > 1:
        groups = -(-left_over // FAN_IN)
        triangles = staged(triangles.repartition(groups).mapInArrow(reduce_triangles, "r binary"))
    sizes, directions = jacobi_svd(np.frombuffer(triangles.first()["r"]).reshape(dim, dim))  # dim x dim numbers
    real = sizes > sizes[0] * max(dim, 1) * np.finfo(float).eps if len(sizes) else sizes > 0
    count = min(components, int((real & (sizes > 0)).sum()))
    explained = (sizes**2 / max((sizes**2).sum(), np.finfo(float).tiny))[:count]
    scaled = directions[:, :count] * (math.sqrt(n) / sizes[:count]) if count else np.zeros((dim, 0))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = centred(unpacked(batch["x"], dim)) @ scaled
            sums, squares = sums + w.sum(0), squares + w.T @ w
        own = np.concatenate((sums, squares.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(own)], names=["k", "total"])

    if not count:
        return spark.createDataFrame([], schema)
    parts = fit.mapInArrow(check, "k int, total double").groupBy("k").agg(F.sum("total").alias("total"))
    sums = [r["total"] for r in sorted(parts.collect())]
    means, products = np.array(sums[:count]) / n, np.array(sums[count:]).reshape(count, count) / n
    error = float(np.abs(products - np.outer(means, means) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lengths, entries = rows_of(batch)
            keep = lengths == dim
            x = whole(entries[np.repeat(keep, lengths)]).reshape(-1, dim)
            y = x - centre
            far = (n * np.abs(y).astype(float) + np.abs(left)) ** 2
            deviation: list = ((n * y - left) ** 2).sum(1).tolist()
            for i in np.flatnonzero(far.sum(1) >= 2.0**62).tolist():
                exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(y[i], left))
                deviation[i] = exact if exact < 1 << 63 else None
            w = centred(x) @ scaled
            rows = np.repeat(np.arange(len(x)), count)
            nth = np.tile(np.arange(count), len(x))
            columns = [batch["vec_id"].take(pa.array(at[keep])).take(pa.array(rows)), pa.array(nth + 1, pa.int32()), pa.array(np.full(len(rows), n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(rows)), pa.array(w.ravel()), pa.array(explained[nth]), pa.array(np.full(len(rows), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return plain.mapInArrow(project, schema)
