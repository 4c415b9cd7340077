"""A full-text index that is kept up: segments of postings, added to and merged.

The folder is that of ``segmented``: numbered manifests name the segments that hold.

* A batch of added, edited and deleted rows becomes one new segment: its
  postings, sorted by word, and the identifiers that it touches. A posting
  counts unless a younger segment touches its identifier, so an edit or a
  deletion writes no more than itself.
* Segments are kept in tiers by size: the youngest, four or more, become one as soon
  as the oldest of them is no larger than the others together; what younger ones
  have touched is left out. So a posting is written again only into a segment at
  least twice as large, and there are few segments: but for the youngest, each is
  larger than all younger ones.
* The manifest has a word directory: the first and last word of each file. A
  lookup opens only files whose words may be asked for.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.operators.search import index, lookup, parse, parts_of
from lorebase.operators.segmented import Segmented, merge_from

#: Postings to a file, about.
FILE_ROWS = 2_000_000
#: A lookup that opens files of at most so many postings is one task.
ONE_TASK = 4_000_000
POSTINGS = "token string, id bigint, column string, places array<bigint>"


class KeptIndex(Segmented):
    """An index over ``columns`` of rows with an ``id``, kept in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, *columns: str):
        super().__init__(spark, path)
        self.columns = columns

    def _segment(self, postings: DataFrame, ids: DataFrame, rows: int | None = None) -> dict:
        """Write a segment. ``rows``: about how many postings there are, if known."""
        name = uuid.uuid4().hex
        files = max(1, math.ceil((rows or 0) / FILE_ROWS)) if rows is not None else None
        ranged = postings.repartitionByRange(files, "token", "id") if files else postings.repartitionByRange("token", "id")
        ranged.sortWithinPartitions("token", "id").write.option("compression", "zstd").parquet(f"{self.path}/{name}/postings")
        ids.select("id").distinct().write.parquet(f"{self.path}/{name}/ids")
        # the word directory, from what was written
        own = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/{name}/postings")
        found = own.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")).collect()
        touched = self.spark.read.schema("id bigint").parquet(f"{self.path}/{name}/ids").count()
        return {"name": name, "ids": touched, "rows": sum(r["rows"] for r in found), "bytes": sum(r["bytes"] for r in found), "files": sorted([r["file"], r["first"], r["last"], r["rows"]] for r in found)}

    def _ids(self, segment: dict, age: int) -> DataFrame:
        return self.spark.read.schema("id bigint").parquet(f"{self.path}/{segment['name']}/ids").withColumn("touched", F.lit(age))

    def _postings(self, segments: list[dict], asked: list[tuple[str, bool]] | None = None) -> DataFrame:
        """Postings that count, of files that may hold the words asked for."""
        parts, rows = [], 0
        for age, x in enumerate(segments):
            own = [(f, n) for f, first, last, n in x["files"] if asked is None or any(may_hold(first, last, w, p) for w, p in asked)]
            files, rows = [f"{self.path}/{x['name']}/postings/{f}" for f, _ in own], rows + sum(n for _, n in own)
            if files:
                parts.append(self.spark.read.schema(POSTINGS).parquet(*files).withColumn("age", F.lit(age)))
        if not parts:
            return self.spark.createDataFrame([], POSTINGS)
        every = reduce(DataFrame.unionAll, parts)
        if asked is not None:
            every = every.where(reduce(lambda a, b: a | b, [F.col("token").startswith(w) if p else F.col("token") == w for w, p in asked]))
        if len(segments) > 1:
            touched = reduce(DataFrame.unionAll, [self._ids(x, age) for age, x in enumerate(segments) if age]).groupBy("id").agg(F.max("touched").alias("touched"))
            every = every.join(touched, "id", "left").where("touched IS NULL OR touched <= age")
        elif asked is not None and rows <= ONE_TASK:
            every = every.coalesce(1)  # a few sorted files, of which few rows are read: no exchange is worth it
        return every.select("token", "id", "column", "places")

    def apply(self, items: DataFrame | None = None, deleted: DataFrame | None = None) -> dict:
        """Add or replace the rows of ``items`` (id and the index's columns) and drop the
        identifiers of ``deleted`` (id), in one new version.

        An identifier in both is replaced. Rows without an identifier are left
        out; rows of a batch that share one are found by any of their words.
        Returns what was written: rows and bytes of postings, of the batch and of merges."""
        before = self.manifest()
        segments = list(before["segments"])
        empty = self.spark.createDataFrame([], "id bigint")
        items = (items if items is not None else self.spark.createDataFrame([], "id bigint, " + ", ".join(f"`{c}` string" for c in self.columns))).where("id IS NOT NULL")
        items = items.withColumn("id", F.col("id").cast("bigint"))
        gone = (deleted if deleted is not None else empty).select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL")
        new = self._segment(index(items, *self.columns), items.select("id").unionAll(gone))
        done = {"rows": new["rows"], "bytes": new["bytes"], "merged_rows": 0, "merged_bytes": 0}
        if new["ids"]:
            segments.append(new)
        while (start := merge_from([x["rows"] + x["ids"] for x in segments])) is not None:
            own = segments[start:]
            if start:
                ids = reduce(DataFrame.unionAll, [self._ids(x, 0) for x in own])
            else:  # nothing is older, so only identifiers that still have postings are needed
                ids = self._postings(own).select("id")
            one = self._segment(self._postings(own), ids, sum(x["rows"] for x in own))
            done["merged_rows"] += one["rows"]
            done["merged_bytes"] += one["bytes"]
            segments[start:] = [one]
        self._commit(before, segments)
        return done | {"segments": len(segments), "version": before["version"] + 1}

    def lookup(self, expression: str) -> DataFrame:
        """(id) of the rows that match; the language is that of ``search``."""
        asked = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in parts_of(parse(expression)) for i, w in enumerate(p.words)))
        return lookup(self._postings(self.manifest()["segments"], asked), expression)


def may_hold(first: str, last: str, word: str, prefix: bool) -> bool:
    """Whether a file of words from ``first`` to ``last`` may hold the word, or one that starts with it."""
    return first <= word <= last or prefix and first[: len(word)] <= word <= last
