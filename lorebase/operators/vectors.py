"""Nearest vectors by cosine from inverted lists over trained centroids.

Centroids are fitted on a bounded sample; every row is in the list of its nearest
one, and each list keeps the largest angle between its centroid and a row. A search ranks the
rows of a few lists near the query, which bounds the cosine that a row must reach, and then opens every list
that may hold such a row: by the triangle inequality of angles, none is nearer than the centroid less the
list's angle. So the result is exact, and the lists opened are few where vectors form clusters;
``exact=False`` stops after the first lists.
Vectors without a direction (null, of another length than the index's, with null or
non-finite entries, or all zero) are in list -1, and are no query's neighbour nor a query.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.nearest import CELL_ROWS, SLACK, met, ranked

#: Rows at most that centroids are fitted on (those of the least hashes of their identifiers).
SAMPLE = 20_000
UNIT = "id bigint, unit array<double>, angle double, list int"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def units(vectors: DataFrame, dims: int) -> DataFrame:
    """(id, unit): vectors of length one, null without a direction."""
    x = F.col("vector").cast("array<double>")
    sane = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is above all
    v = vectors.select(F.col("id").cast("bigint").alias("id"), F.when(sane, x).alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    usable = (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    return v.select("id", F.when(usable, F.transform("v", lambda e: e / F.col("norm"))).alias("unit"))


class VectorIndex:
    """An index in the folder ``path``: a folder of rows for each list, and the centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.dims, *rows = [json.loads(r["value"]) for r in spark.read.text(f"{path}/centroids").orderBy(F.get_json_object("value", "$[0]").cast("int")).collect()]
        self.dims, self.centroids, self.angles, self.sizes = self.dims[1], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows]  # as many as lists

    @classmethod
    def build(cls, vectors: DataFrame, path: str, dims: int, lists: int = 64, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Index ``vectors`` (id, vector), whole."""
        spark = vectors.sparkSession
        rows = units(vectors, dims)
        fit = rows.where("unit IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector("unit").alias("features")).persist()
        try:
            found = KMeans(k=lists, seed=seed, maxIter=15, distanceMeasure="cosine").fit(fit).clusterCenters() if not fit.isEmpty() else []
            centres = [[float(x) / math.sqrt(sum(float(e) ** 2 for e in c)) for x in c] for c in found]
        finally:
            fit.unpersist()
        at = nearest(F.col("unit"), centres, 1)
        placed = rows.withColumn("at", at).select("id", "unit", F.get("at.angles", 0).alias("angle"), F.coalesce(F.get("at.lists", 0), F.lit(-1)).alias("list"))
        placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/rows")
        own = spark.read.schema(UNIT).parquet(f"{path}/rows").where("list >= 0").groupBy("list").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n"))
        widest = {r["list"]: (r["widest"], r["n"]) for r in own.collect()}  # a row for each list
        kept = [(json.dumps([-1, dims]),)] + [(json.dumps([i, c, *widest.get(i, (0.0, 0))]),) for i, c in enumerate(centres)]
        spark.createDataFrame(kept, "value string").coalesce(1).write.text(f"{path}/centroids")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int = 5, probes: int = 4, exact: bool = True) -> DataFrame:
        """(id, other, cosine, similarity (rounded to six digits), rank) of the ``k`` rows most like each query (id, vector), ties by
        identifier. A row is no neighbour of its own identifier. Queries and rows of a list meet in cells of about ``CELL_ROWS`` rows."""
        stored = self.spark.read.schema(UNIT).parquet(f"{self.path}/rows").select("id", "unit", "list").where("list >= 0")
        asked = units(queries, self.dims).where("unit IS NOT NULL")
        # The cells of a list follow one another; a row is dealt to one of them, a query to all.
        own = [max(1, -(-n // CELL_ROWS)) for n in self.sizes]
        first = [sum(own[:i]) for i in range(len(own))]
        at = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("list"))
        rows = stored.select((at(first) + F.pmod(F.xxhash64("id"), at(own))).cast("int").alias("cell"), F.lit(False).alias("asks"), "id", "unit")

        def best(lists: Column) -> DataFrame:
            ask = asked.withColumn("list", F.explode(lists)).withColumn("cell", F.explode(F.sequence(at(first), at(first) + at(own) - 1)))
            cells = ask.select("cell", F.lit(True).alias("asks"), "id", "unit").unionByName(rows)
            found = met(cells.select("cell", "asks", "id", F.col("unit").alias("vector"), F.lit(None).cast("bigint").alias("tag")), k, sum(own))
            return ranked(found, k).select("id", "other", "cosine", "similarity", "rank")

        if not self.centroids:
            return asked.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
        near = best(nearest(F.col("unit"), self.centroids, max(1, probes))["lists"])
        if not exact:
            return near
        reach = near.where(F.col("rank") == k).groupBy("id").agg(F.min("similarity").alias("least"))
        asked = asked.join(reach, "id", "left")
        return best(may_hold(F.col("unit"), F.col("least"), self.centroids, self.angles))


def _cosines(units: pa.Array, centroids: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors, none of them null, and centroids."""
    return np.clip(units.flatten().to_numpy().reshape(len(units), -1) @ centroids.T, -1.0, 1.0)


def nearest(unit: Column, centroids: list[list[float]], n: int) -> Column:
    """The numbers of the ``n`` centroids most like a unit vector, and their angles (null without one)."""
    c = np.array(centroids)

    @F.arrow_udf("struct<lists:array<int>,angles:array<double>>")
    def find(units: pa.Array) -> pa.Array:
        there = np.flatnonzero(units.is_valid().to_numpy(zero_copy_only=False)) if len(c) else np.zeros(0, np.int64)
        if not len(there):
            return pa.nulls(len(units), pa.struct({"lists": pa.list_(pa.int32()), "angles": pa.list_(pa.float64())}))
        cosines = _cosines(units.drop_null(), c)
        lists = np.argsort(-cosines, axis=1, kind="stable")[:, :n]
        angles = np.arccos(np.take_along_axis(cosines, lists, axis=1))
        flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
        rows = pa.StructArray.from_arrays([flat(lists.astype(np.int32), pa.int32()), flat(angles, pa.float64())], names=["lists", "angles"])
        place = np.full(len(units), -1)
        place[there] = np.arange(len(there))
        return rows.take(pa.array(place, mask=place < 0))

    return find(unit)


def may_hold(unit: Column, least: Column, centroids: list[list[float]], angles: list[float]) -> Column:
    """The numbers of the lists that may hold a row as similar as ``least`` to a unit vector: all if that is null."""
    c, wide = np.array(centroids), np.array(angles)

    @F.arrow_udf("array<int>")
    def find(units: pa.Array, least: pa.Array) -> pa.Array:
        if not len(units):
            return pa.array([], pa.list_(pa.int32()))
        bounds = np.cos(np.maximum(0.0, np.arccos(_cosines(units, c)) - wide))
        may = bounds >= pc.fill_null(least, -2.0).to_numpy()[:, None] - SLACK
        offsets = np.concatenate(([0], np.cumsum(may.sum(axis=1)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(may)[1].astype(np.int32)))

    return find(unit, least)
