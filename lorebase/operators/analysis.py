"""The analysis run: what has changed is classified, searched for entities and embedded.

A row's stages are those whose content hash differs from the one in the state
table; rows without any are not touched. Every stage is a projection of the
pending rows, and its results are merged into new versions of the tables.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions import text as X
from lorebase.functions.taxonomy import DEFAULT, Taxonomy
from lorebase.operators import classify as C
from lorebase.operators import entities as E
from lorebase.operators import records as R
from lorebase.operators import writes as W

STAGES = ("classify", "entities", "embed")


class Archive(NamedTuple):
    """The tables that an analysis reads and writes."""

    items: DataFrame  # id, text, raw_text, links, summary, why_it_matters, needs_review, review_state, captured_at, is_deleted
    enrichments: DataFrame  # id, source_type, captured_at, content
    labels: DataFrame  # id, slug, confidence, rationale, is_primary
    tags: DataFrame  # id, tag
    entities: DataFrame  # normalized, type, name, source
    mentions: DataFrame  # id, normalized, type, salience, evidence
    embeddings: DataFrame  # id, provider, vector
    state: DataFrame  # id, stage, provider, content_hash


def selected(archive: Archive, include=(), exclude=(), needs_review: bool | None = None, review_state: str | None = None, limit: int | None = None) -> DataFrame:
    """Live rows by label, review and state, in order of identifier."""
    rows = R.include_exclude(R.live(archive.items), archive.labels, include, exclude)
    rows = R.listed(rows, needs_review=needs_review, review_state=review_state)
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def run_analysis(archive: Archive, stages: tuple[str, ...] = STAGES, provider: str = "local-hash", changed_only: bool = True, taxonomy: Taxonomy = DEFAULT, **which) -> tuple[Archive, DataFrame]:
    """(new versions, what was done: id, stage). Texts are analysed with their enrichments."""
    if unknown := set(stages) - set(STAGES):
        raise ValueError(f"unknown stage {sorted(unknown)}; there are {', '.join(STAGES)}")
    rows = selected(archive, **which)
    full = R.enriched_text(rows.select("id", F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("raw_text", F.lit(""))).alias("text")), archive.enrichments)
    hashed = full.withColumn("content_hash", F.sha2("text", 256)).join(rows.select("id", "links"), "id")
    provided = F.when(F.col("stage") == "embed", F.lit(provider)).otherwise(F.lit(""))
    asked = hashed.select("id", "content_hash", F.explode(F.array(*map(F.lit, stages))).alias("stage")).withColumn("provider", provided)
    key = ["id", "stage", "provider", "content_hash"]
    todo = asked.join(archive.state.select(*key), key, "left_anti") if changed_only else asked
    due = lambda stage: hashed.join(todo.where(F.col("stage") == stage).select("id"), "id", "left_semi")
    out = archive
    if "classify" in stages:
        c = C.classify(due("classify"), links="links", taxonomy=taxonomy)
        labels = c.select("id", F.posexplode("labels").alias("place", "x")).select("id", "x.slug", "x.confidence", "x.rationale", (F.col("place") == 0).alias("is_primary"))
        result = c.select("id", X.summarize(F.col("text")).alias("summary"), C.why_it_matters(F.col("text"), F.col("primary"), F.col("links")).alias("why_it_matters"), "needs_review")
        tags = c.select("id", C.tags(F.col("text"), F.col("primary"), F.col("links")).alias("tags"))
        out = out._replace(items=W.update_analysis(out.items, result), labels=W.replace_labels(out.labels, labels, c.select("id")), tags=W.add_tags(out.tags, tags))
    if "entities" in stages:
        d = due("entities")
        found = E.extract(d, links="links").join(d.select("id", "text"), "id")
        entities, mentions = W.add_entities(out.entities, out.mentions, found)
        out = out._replace(entities=entities, mentions=mentions)
    if "embed" in stages:
        vectors = due("embed").select("id", F.lit(provider).alias("provider"), X.hashed_vector(F.col("text")).alias("vector"))
        out = out._replace(embeddings=W.put(out.embeddings, vectors, "id", "provider"))
    out = out._replace(state=W.put(out.state, todo, "id", "stage", "provider"))
    return out, todo.select("id", "stage")
