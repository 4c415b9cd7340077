"""Tables of records: upserts, incremental state, review, enrichment and listings.

Parquet has no MERGE: an upsert is a full outer join of the stored and the
arriving rows by key, written as a new version by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import text as X

#: Source types of enrichments, best first (fixed values).
PRIORITY = ("x-article", "x-status", "x-conversation", "linked-page", "image-analysis")
ACTIONS = {"approve": "approved", "exclude": "excluded", "archive": "archived", "mark-project": "project-candidate", "unmark": "new"}


def row_hash(status_id: Column, text: Column, raw: Column, links: Column) -> Column:
    return X.content_hash(status_id, text, raw, F.to_json(F.array_distinct(links)))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, without a sort of all rows of a key in memory."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, arriving: DataFrame, key: str, hash_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The new version with ``change``: new, changed, unchanged or absent.

    Columns in ``keep`` (capture time, review, analysis) stay as stored on
    conflict; the others come from the arriving row if its hash differs."""
    s, a = stored.alias("s"), arriving.alias("a")
    joined = s.join(a, F.col(f"s.{key}") == F.col(f"a.{key}"), "full_outer")
    is_new, is_absent = F.col(f"s.{key}").isNull(), F.col(f"a.{key}").isNull()
    differs = ~F.col(f"s.{hash_col}").eqNullSafe(F.col(f"a.{hash_col}"))
    change = F.when(is_new, "new").when(is_absent, "absent").when(differs, "changed").otherwise("unchanged")
    take = is_new | (~is_absent & differs)
    columns = [F.coalesce(f"s.{key}", f"a.{key}").alias(key)]
    for c in stored.columns:
        if c != key:
            columns.append((F.when(is_new, F.col(f"a.{c}")).otherwise(F.col(f"s.{c}")) if c in keep else F.when(take, F.col(f"a.{c}")).otherwise(F.col(f"s.{c}"))).alias(c))
    return joined.select(*columns, change.alias("change"))


def pending(items: DataFrame, state: DataFrame, stages: tuple[str, ...] = ("classify", "entities", "embed")) -> DataFrame:
    """(id, stage) whose content hash differs from the stored one for that stage."""
    wanted = items.select("id", "content_hash").withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return wanted.join(state.select("id", "stage", "content_hash"), ["id", "stage", "content_hash"], "left_anti")


def live(items: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return items.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))


def point(items: DataFrame, **key) -> DataFrame:
    """Rows by identifier or any other column; the filter reaches the scan."""
    for name, value in key.items():
        items = items.where(F.col(name) == F.lit(value))
    return items


def listed(items: DataFrame, labels: DataFrame | None = None, category: str | None = None, needs_review: bool | None = None, review_state: str | None = None, hits: DataFrame | None = None, since=None) -> DataFrame:
    """Rows by any of: primary label (``labels``: id, slug, is_primary), need for review,
    review state, a search's ``hits`` (id) and the day of capture. All that are given hold."""
    if needs_review is not None:
        items = items.where(F.col("needs_review") == needs_review)
    if review_state:
        items = items.where(F.col("review_state") == review_state)
    if since is not None:
        items = items.where(F.to_date("captured_at") >= F.to_date(F.lit(since)))
    if category:
        items = items.join(labels.where((F.col("slug") == category) & F.col("is_primary")).select("id"), "id", "left_semi")
    if hits is not None:
        items = items.join(hits.select("id"), "id", "left_semi")
    return items


def include_exclude(items: DataFrame, labels: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Items with any label in ``include`` and none in ``exclude``; labels are (id, slug)."""
    if include:
        items = items.join(labels.where(F.col("slug").isin(*include)).select("id"), "id", "left_semi")
    if exclude:
        items = items.join(labels.where(F.col("slug").isin(*exclude)).select("id"), "id", "left_anti")
    return items


def missing_enrichment(items: DataFrame, enrichments: DataFrame, source_type: str | None = None) -> DataFrame:
    have = enrichments if source_type is None else enrichments.where(F.col("source_type") == source_type)
    return items.join(have.select("id"), "id", "left_anti")


def priority(source_type: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), source_type), F.lit(0)), F.lit(len(PRIORITY) + 1))


def best_enrichment(enrichments: DataFrame) -> DataFrame:
    """One row for each id: by source priority, then newest."""
    return latest(enrichments, ["id"], [priority(F.col("source_type")), F.col("captured_at").desc()])


def enriched_text(items: DataFrame, enrichments: DataFrame) -> DataFrame:
    """``items`` (id, text) with the enrichments' texts after it, in priority order; empty ones are skipped."""
    parts = enrichments.where(F.trim(F.coalesce("content", F.lit(""))) != "").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(priority(F.col("source_type")).alias("p"), F.col("captured_at").alias("at"), "content"))).alias("parts"))
    return items.join(parts, "id", "left").select("id", F.concat_ws("\n\n", "text", F.transform("parts", lambda p: p["content"])).alias("text"))


def apply_actions(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Review state after the last action of each id (action, at); any action ends the need for review."""
    last = actions.groupBy("id").agg(F.max_by("action", "at").alias("action"))
    state = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    out = items.join(last, "id", "left")
    return out.withColumn("review_state", F.coalesce(F.try_element_at(state, F.col("action")), F.col("review_state"))).withColumn("needs_review", F.when(F.col("action").isNotNull(), F.lit(False)).otherwise(F.col("needs_review"))).drop("action")


def first_last_seen(rows: DataFrame, key: str, at: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(name, at).alias("display_name"))


def page(items: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first; without a limit (None or 0) all rows."""
    ordered = items.orderBy(F.col("captured_at").desc(), F.col("id").desc())
    return ordered.offset(offset).limit(limit) if limit else ordered
