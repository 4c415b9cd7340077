"""The rows most like each of many queries, by cosine: queries and rows that share a cell meet.

A task holds the queries of a cell and takes its rows in blocks. A product of matrices bounds the
similarities from above; those that may be among the first are computed anew as SQL would, entry by
entry in order, so that ranks are exact. What is kept of a query are its first rows so far, so memory
is that of a cell's queries and one block, and what is handed on grows with queries and cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows multiplied at a time.
QUERIES, ROWS = 1024, 2048
#: Queries that one cell of ``against_all`` has, and rows, about.
CELL_QUERIES, CELL_ROWS = 1 << 14, 1 << 16
#: Above what rounding to six digits may change in a similarity.
SLACK = 3e-6
NO_TAG = -(1 << 63)
MET = "cell int, id bigint, other bigint, tag bigint, cosine double, similarity double"


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; those that are null or hold nulls count as of length 0."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parents, values = pc.list_parent_indices(vectors), pc.list_flatten(vectors)
    if values.null_count:
        lengths[parents.filter(pc.is_null(values)).to_numpy()] = 0
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), n) if n else np.zeros((len(at), 0))


def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of columns, added in order, of matrices that have a column for each pair."""
    out = np.zeros(x.shape[1])
    for a, b in zip(x, y):
        out += a * b
    return out


class Vectors:
    """Vectors of one length, as columns, with their lengths and directions (zero without one)."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, matrix: np.ndarray):
        self.ids, self.tags, self.columns = ids, tags, np.ascontiguousarray(matrix.T)
        with np.errstate(all="ignore"):
            self.norms = np.sqrt(added(self.columns, self.columns))
            self.units = np.where(self.norms[:, None] == 0, 0.0, matrix / self.norms[:, None])

    def part(self, start: int, end: int) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.tags, out.columns, out.norms, out.units = self.ids[start:end], self.tags[start:end], self.columns[:, start:end], self.norms[start:end], self.units[start:end]
        return out


class Best:
    """The first ``k`` rows so far of some queries of one length."""

    def __init__(self, queries: Vectors, k: int):
        self.queries, self.k = queries, k
        self.at, self.other, self.tags, self.cosine, self.similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        self.least = np.full(len(queries.ids), -np.inf)

    def add(self, rows: Vectors) -> None:
        q, k = self.queries, self.k
        alike = len(q.columns) == len(rows.columns)
        with np.errstate(all="ignore"):
            about = q.units @ rows.units.T if alike else np.zeros((len(q.ids), len(rows.ids)))
        about[np.isnan(about)] = np.inf  # as SQL orders them
        about[q.ids[:, None] == rows.ids] = -np.inf
        least = self.least
        if about.shape[1] >= k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(about, -k, axis=1)[:, -k])
        at, place = np.nonzero((about >= (least - SLACK)[:, None]) & (about > -np.inf))
        if not len(at):
            return
        cosine = np.zeros(len(at))
        if alike:
            with np.errstate(all="ignore"):
                for a, b in zip(q.columns, rows.columns):
                    cosine += a[at] * b[place]
                norms = q.norms[at] * rows.norms[place]
                cosine = np.where(norms == 0, 0.0, cosine / norms)
        rounded = np.copysign(np.floor(np.abs(cosine) * 1e6 + 0.5), cosine) / 1e6
        at, other, tags = np.concatenate((self.at, at)), np.concatenate((self.other, rows.ids[place])), np.concatenate((self.tags, rows.tags[place]))
        cosine, similarity = np.concatenate((self.cosine, cosine)), np.concatenate((self.similarity, rounded))
        order = np.lexsort((other, -np.where(np.isnan(similarity), np.inf, similarity), at))
        new = np.flatnonzero(np.diff(at[order], prepend=-1))
        order = order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < k]
        self.at, self.other, self.tags, self.cosine, self.similarity = (c[order] for c in (at, other, tags, cosine, similarity))
        full = np.flatnonzero(np.bincount(self.at, minlength=len(q.ids)) == k)
        last = np.searchsorted(self.at, full, "right") - 1
        self.least[full] = np.where(np.isnan(self.similarity[last]), np.inf, self.similarity[last])


def met(cells: DataFrame, k: int, parts: int) -> DataFrame:
    """(cell, id, other, tag, cosine, similarity to six digits): for each query the ``k`` most similar rows of its cell, ties by ``other``.

    cells: cell (from 0 to ``parts`` - 1), asks (queries true, rows false), id, vector (array of double), tag
    (bigint, of rows). A row is no neighbour of a query of its identifier. Vectors of different length
    or without a norm have the similarity 0; one that is no number comes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries = None, []

        def close():
            for b in queries:
                if len(b.at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.at), cell, np.int32)), pa.array(b.queries.ids[b.at]), pa.array(b.other), pa.array(b.tags), pa.array(b.cosine), pa.array(b.similarity)], names=["cell", "id", "other", "tag", "cosine", "similarity"])

        for batch in batches:
            keys = batch["cell"].to_numpy() * 2 + pc.invert(batch["asks"]).cast(pa.int32()).to_numpy()
            edges = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)).tolist() if len(keys) else []
            for start, end in zip(edges, [*edges[1:], len(keys)]):
                own = batch.slice(start, end - start)
                if cell != int(keys[start]) // 2:
                    yield from close()
                    cell, queries = int(keys[start]) // 2, []
                ids, tags = own["id"].to_numpy(), pc.fill_null(own["tag"], NO_TAG).to_numpy()
                for at, matrix in matrices(own["vector"]):
                    v = Vectors(ids[at], tags[at], matrix)
                    if keys[start] % 2 == 0:
                        queries += [Best(v.part(i, i + QUERIES), k) for i in range(0, len(at), QUERIES)]
                    else:
                        for i in range(0, len(at), ROWS):
                            for b in queries:
                                b.add(v.part(i, i + ROWS))
        yield from close()

    dealt = cells.select("cell", "asks", F.col("id").cast("bigint").alias("id"), "vector", "tag").where("id IS NOT NULL").repartitionById(parts, F.col("cell"))
    found = dealt.sortWithinPartitions("cell", F.desc("asks")).mapInArrow(work, MET)
    return found.withColumn("tag", F.nullif("tag", F.lit(NO_TAG)))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each query of all cells, with their ``rank``."""
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.drop("cell").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def against_all(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``ranked`` rows of (id, vector, tag) for each query (id, vector): every query meets every row, in cells of both."""
    blocks = -(-queries.count() // CELL_QUERIES) or 1
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // CELL_ROWS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("part", every(parts)).select((block * parts + F.col("part")).alias("cell"), F.lit(True).alias("asks"), "id", "vector", F.lit(None).cast("bigint").alias("tag"))
    r = rows.withColumn("block", every(blocks)).select((F.col("block") * parts + part).alias("cell"), F.lit(False).alias("asks"), "id", "vector", "tag")
    return ranked(met(q.unionByName(r), k, blocks * parts), k)
