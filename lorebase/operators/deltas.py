"""Derived tables kept up by signed changes.

A change hands over the rows that it touches as they were (``before``) and as they
are now (``after``): an added row is only in the second, a deleted one only in the
first. Both are classified and searched for names; what the first give counts
-1 and what the second give counts +1. The sums of these rows are the tables:
labels, names, mentions, the names of each category, and edges.

A change is written as a segment of such sums, so the work and the bytes grow
with the change and not with what is kept. Segments are merged by size, and
there rows whose sum is 0 go. Texts are never read again: top lists, clusters, ideas
and the graph are made from the kept tables.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.functions.taxonomy import DEFAULT, Taxonomy
from lorebase.operators import derive as D
from lorebase.operators.classify import classify
from lorebase.operators.entities import extract
from lorebase.operators.segmented import Segmented, merge_from

#: The kept tables: their keys. Each has a column ``n`` besides, which is never 0 in the sum.
TABLES = {
    "labels": "id bigint, author string, primary string, confidence double",
    "names": "id bigint, name string, type string",
    "links": "id bigint, url string",
    "mentions": "name string, type string",
    "category_names": "category string, name string",
    "edges": "src_type string, src_id string, dst_type string, dst_id string, relation string",
}


def _keys(table: str) -> list[str]:
    return [x.split()[0] for x in TABLES[table].split(", ")]


def facts(items: DataFrame, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """What rows (id, author, text, links) say, a row each: their labels, names with types and links."""
    some = items.select(F.col("id").cast("bigint").alias("id"), "author", "text", "links")
    said = classify(some, links="links", taxonomy=taxonomy).select("id", "author", "primary", "confidence", "links")
    names = extract(some, links="links").groupBy("id").agg(F.collect_set(F.struct(F.lower("name").alias("name"), "type")).alias("names"))
    return said.join(names, "id", "left")


class Derived(Segmented):
    """Derived tables of items (id, author, text, links), kept in the folder ``path``.

    Identifiers are unique among the items, and ``min_confidence`` tells which labels
    count for clusters and their names."""

    def __init__(self, spark, path: str, taxonomy: Taxonomy = DEFAULT, min_confidence: float = 0.4):
        super().__init__(spark, path)
        self.taxonomy, self.min_confidence = taxonomy, min_confidence

    def _signed(self, said: DataFrame) -> dict[str, DataFrame]:
        """The change of each table, from ``facts`` with a sign."""
        sure = said.where(F.col("confidence") >= self.min_confidence)
        named = said.select("id", "primary", "confidence", "sign", F.inline("names"))
        s = lambda c: F.col(c).cast("string")

        def edge(rows, dst_type, dst, relation):
            own = rows.select(F.lit("bookmark").alias("src_type"), s("id").alias("src_id"), F.lit(dst_type).alias("dst_type"), dst.alias("dst_id"), F.lit(relation).alias("relation"), "sign")
            return own.where("src_id IS NOT NULL AND dst_id IS NOT NULL AND dst_id <> ''")

        links = said.select("id", "sign", F.explode(F.array_distinct("links")).alias("url"))
        hosts = said.select("id", "sign", F.explode(F.array_distinct(F.transform("links", X.link_domain))).alias("domain"))
        spelled = said.select("id", "sign", F.explode(F.array_distinct(F.transform("names", lambda x: x["name"]))).alias("name"))
        edges = [
            edge(said, "category", F.col("primary"), "categorized_as"),
            edge(spelled, "entity", F.col("name"), "mentions"),
            edge(said, "author", F.col("author"), "authored_by"),
            edge(hosts, "domain", F.col("domain"), "links_to"),
            edge(links, "link", F.col("url"), "references"),
        ]
        names = sure.select(F.col("primary").alias("category"), "sign", F.explode(F.array_distinct(F.transform("names", lambda x: x["name"]))).alias("name"))
        return {"labels": said, "names": named, "links": links, "mentions": named, "category_names": names, "edges": reduce(DataFrame.unionByName, edges)}

    def _read(self, segments: list[dict], table: str) -> DataFrame:
        """Sums of a table's rows that aren't 0."""
        paths = [f"{self.path}/{x['name']}/{table}" for x in segments]
        if not paths:
            return self.spark.createDataFrame([], f"{TABLES[table]}, n bigint")
        rows = self.spark.read.schema(f"{TABLES[table]}, n bigint").parquet(*paths)
        return rows if len(paths) == 1 else rows.groupBy(*_keys(table)).agg(F.sum("n").alias("n")).where("n <> 0")

    def _write(self, tables: dict[str, DataFrame]) -> dict:
        """A segment; ``tables`` have the columns of ``TABLES`` and n."""
        name, sizes = uuid.uuid4().hex, {}
        for table, rows in tables.items():
            at = f"{self.path}/{name}/{table}"
            rows.write.parquet(at)
            sizes[table] = self.spark.read.schema("n bigint").parquet(at).count()
        return {"name": name, "rows": sum(sizes.values()), "tables": sizes}

    def apply(self, before: DataFrame | None = None, after: DataFrame | None = None) -> dict:
        """Take up a change in one new version: rows as they were, and as they are.

        Either may be missing. Returns how many rows were written for the change
        and by merges."""
        kept = self.manifest()
        segments = list(kept["segments"])
        parts = [facts(x, self.taxonomy).withColumn("sign", F.lit(sign)) for x, sign in ((before, -1), (after, 1)) if x is not None]
        done = {"rows": 0, "merged_rows": 0}
        if parts:
            # Texts are worked on once; the tables' changes are made from what was found.
            at = f"{self.path}/facts-{uuid.uuid4().hex}"
            reduce(DataFrame.unionByName, parts).write.parquet(at)
            signed = self._signed(self.spark.read.parquet(at))
            new = self._write({t: signed[t].groupBy(*_keys(t)).agg(F.sum("sign").cast("bigint").alias("n")).where("n <> 0").select(*_keys(t), "n") for t in TABLES})
            self._fs.delete(self._at(at.rpartition("/")[2]), True)
            done["rows"] = new["rows"]
            if new["rows"]:
                segments.append(new)
        while (start := merge_from([x["rows"] for x in segments])) is not None:
            one = self._write({t: self._read(segments[start:], t) for t in TABLES})
            done["merged_rows"] += one["rows"]
            segments[start:] = [one]
        self._commit(kept, segments)
        return done | {"segments": len(segments), "version": kept["version"] + 1}

    def table(self, name: str) -> DataFrame:
        """A kept table: its keys, and ``n``."""
        return self._read(self.manifest()["segments"], name)

    def mentions(self, least: int = 1, kind: str | None = None) -> DataFrame:
        """(name, type, mentions) of names with at least so many documents."""
        rows = self.table("mentions").where(F.col("n") >= least)
        return (rows if kind is None else rows.where(F.col("type") == kind)).withColumnRenamed("n", "mentions")

    def top_names(self, top: int = 5) -> DataFrame:
        """(category, name, n, rank): the most frequent names of each category, ties by name."""
        order = Window.partitionBy("category").orderBy(F.desc("n"), "name")
        return self.table("category_names").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    def category_counts(self) -> DataFrame:
        return self.table("labels").groupBy(F.col("primary").alias("category")).agg(F.sum("n").alias("members"))

    def clusters(self) -> DataFrame:
        return D.clusters(self.table("labels"), self.table("names"), min_confidence=self.min_confidence)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges with clusters and projects; edges of items are read as they are kept."""
        members, names = self.clusters(), self.table("names")
        labels = self.table("labels")
        none = lambda schema: self.spark.createDataFrame([], schema)
        empty = (none("id bigint, author string"), none("id bigint, primary string"), none("id bigint, name string"), none("id bigint, url string"))
        _, derived = D.graph(*empty, members, D.project_ideas(members, names))
        edges = self.table("edges").drop("n").unionByName(derived)
        ends = [edges.select(F.col(f"{e}_type").alias("type"), F.col(f"{e}_id").alias("id")) for e in ("src", "dst")]
        own = labels.select(F.lit("bookmark").alias("type"), F.col("id").cast("string").alias("id")).where("id IS NOT NULL")
        return reduce(DataFrame.unionByName, [own, *ends]).distinct(), edges
