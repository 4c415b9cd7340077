"""Writes: bridges, labels, analysis results and derived tables as new versions.

Parquet has no MERGE. Each function takes the stored rows and the arriving ones
and gives the rows of the next version; the caller writes them. Rows are met by
key in joins and partial aggregations, so a version costs one shuffle of each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X


def put(stored: DataFrame, arriving: DataFrame, *key: str) -> DataFrame:
    """Arriving rows in place of the stored ones of equal key; of arriving rows with
    one key the largest in the order of the other columns stays (embeddings, states, enrichments)."""
    rest = [c for c in stored.columns if c not in key]
    new = arriving.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__x")).select(*key, *[F.col("__x")[c].alias(c) for c in rest])
    return stored.join(new.select(*key), list(key), "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def insert(stored: DataFrame, arriving: DataFrame, *key: str) -> DataFrame:
    """Stored rows and those arriving rows whose key is new; of equal keys the least row comes in."""
    rest = [c for c in stored.columns if c not in key]
    new = arriving.groupBy(*key).agg(*([F.min(F.struct(*rest)).alias("__x")] if rest else [F.lit(1).alias("__x")])).select(*key, *[F.col("__x")[c].alias(c) for c in rest])
    return stored.unionByName(new.join(stored.select(*key), list(key), "left_anti").select(*stored.columns))


def add_links(links: DataFrame, bridge: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` (url, domain, first_seen, last_seen) and ``bridge`` (id, url, role) with
    ``arriving`` (id, links, at): every URL once, seen from its first to its last time; empty URLs are none."""
    each = arriving.select("id", "at", F.explode("links").alias("url")).where("url <> ''")
    seen = each.select("url", X.link_domain(F.col("url")).alias("domain"), F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    merged = links.unionByName(seen).groupBy("url").agg(F.max("domain").alias("domain"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return merged, insert(bridge, each.select("id", "url", F.lit("mentioned").alias("role")), "id", "url")


def add_entities(entities: DataFrame, bridge: DataFrame, found: DataFrame, salience: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """``entities`` (normalized, type, name, source) and ``bridge`` (id, normalized, type, salience, evidence)
    with ``found`` (id, name, type, source, text): stored spellings and evidence stay."""
    low = found.where(F.trim("name") != "").withColumn("normalized", F.lower(F.trim("name")))
    new = insert(entities, low.select("normalized", "type", "name", "source"), "normalized", "type")
    pairs = low.select("id", "normalized", "type", F.lit(salience).alias("salience"), F.substring("text", 1, 200).alias("evidence"))
    return new, insert(bridge, pairs, "id", "normalized", "type")


def add_tags(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """(id, tag) with ``arriving`` (id, tags): lower case, trimmed, each pair once."""
    each = arriving.select("id", F.explode("tags").alias("tag")).select("id", F.lower(F.trim("tag")).alias("tag"))
    return stored.unionByName(each.where("tag <> ''")).distinct()


def replace_labels(stored: DataFrame, arriving: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Labels of the touched ids are those that arrive, which may be none; others stay."""
    ids = (touched if touched is not None else arriving).select("id").distinct()
    return stored.join(ids, "id", "left_anti").select(*stored.columns).unionByName(arriving.select(*stored.columns))


def update_analysis(items: DataFrame, results: DataFrame, columns: tuple[str, ...] = ("summary", "why_it_matters", "needs_review")) -> DataFrame:
    """``items`` with the results' columns where there are some. Review notes stay."""
    new = results.select("id", F.struct(*columns).alias("__r"))
    joined = items.join(new, "id", "left")
    return joined.select(*[(F.coalesce(F.col("__r")[c], F.col(c)) if c in columns else F.col(c)).alias(c) for c in items.columns])


def replace_derived(stored: DataFrame, computed: DataFrame, slug: str = "slug", keep: tuple[str, ...] = ("status",)) -> DataFrame:
    """Clusters or projects recomputed: rows of one slug become one (the most confident,
    then the largest), columns in ``keep`` stay as stored, and stale rows go."""
    rest = [c for c in computed.columns if c not in (slug, "confidence")]
    best = computed.groupBy(slug).agg(F.max(F.struct("confidence", *rest)).alias("__x")).select(slug, F.col("__x")["confidence"].alias("confidence"), *[F.col("__x")[c].alias(c) for c in rest])
    old = stored.select(slug, F.struct(*keep).alias("__k"))
    return best.join(old, slug, "left").select(*[(F.coalesce(F.col("__k")[c], F.col(c)) if c in keep else F.col(c)).alias(c) for c in best.columns])
