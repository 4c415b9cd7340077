"""Mixing sources to target weights along a time-varying curriculum.

Only DataFrame functions run here. Each source has a weight schedule over
training time t in [0, 1]; its integral is the number of words the source
gives in all (its target). A document takes a stretch of its source's word
demand, and inverting the cumulated schedule turns that stretch into a training
position. The result is range-sorted by position.

Prefix sums over a source are taken in two steps, so that a source with a
third of all rows is no single task: documents are dealt over ``blocks`` by a
hash, block totals are summed (one row for each source and block), and the
running sum within a block starts from its block's offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import WORD, shuffle_partitions, staged

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, tilt: float = 0.5) -> DataFrame:
    """``sizes`` (source, source_size) with ``target`` and the schedule's ``slope``.

    All targets together are ``share`` of all sizes, dealt by weight; none is
    above ``cap`` times its source's size, and what is cut off goes to the
    others by weight. With the sources in order of cap / weight, the capped
    ones are a prefix, so running sums find the level in one pass. There is a
    row for each source, so these windows hold one small partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(n)) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", w)
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward))
        .withColumn("capped", F.col("level") >= F.col("ratio"))
        .withColumn("order", F.row_number().over(by_ratio))
        .withColumn("at", F.min_by("level", F.when(~F.col("capped"), F.col("order"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", F.col("at") * F.col("w"))))
        # Heavier sources come earlier in training: the slope falls with the weight.
        .withColumn("slope", F.lit(float(tilt)) * (2 * F.col("w") / F.max("w").over(everything) - 1))
        .select("source", "source_size", "target", "slope")
    )


def training_position(nth=1):
    """Training time from 0 to 1 of the middle of a document's pass number ``nth``
    (a number or a column): its source's schedule target * (1 + slope * (1 - 2 t)),
    integrated up to t and inverted."""
    before = F.col("first_pass") + (F.lit(nth) - 1 if isinstance(nth, int) else nth - 1) * F.col("source_size")
    u = F.least(F.lit(1.0), (before + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0)))
    a = F.col("slope")
    return 2 * u / ((1 + a) + F.sqrt((1 + a) * (1 + a) - 4 * a * u))


def curriculum_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    tilt: float = 0.5,
    blocks: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``, range-sorted by training position:
    ``doc_id, size, source, source_size, target, taken, slope, first_pass, position, row_hash``.

    * ``size`` is the number of words of the whole text; null text has none.
    * ``taken``: with k the whole number of times the target covers the
      source, every document is taken k times, and the rest of the target is
      filled by whole documents in an order given by a hash of identifier and
      text; the one at the edge is taken in part. So a source's sum is its
      target rounded to a word, no document exceeds ``cap`` rounded up times
      its size, and reruns agree.
    * ``first_pass`` is the stretch of demand before the document, ``position``
      its training time by ``training_position`` in the first pass over the
      source. Documents that are not taken have none.
    * ``row_hash`` is xxhash64 of identifier and text.
    * A null source is a source of its own, last in order. Null identifiers
      and repeated rows are rows like any other; equal rows get equal sums up
      to the order among them. Empty documents have size and taken 0. An empty
      table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    blocks = blocks or 2 * shuffle_partitions(spark)
    base = staged(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)).alias("h"),
        ).withColumn("block", F.pmod("h", F.lit(blocks)))
    )
    per_block = base.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    targets = source_targets(per_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, cap, tilt)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn("offset", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    # One row for each source and block; the planner picks the join by its measured size.
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "block", "offset", "source_size", "target", "slope")
    within = Window.partitionBy("b.source", "b.block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        base.alias("b")
        .join(offsets.alias("o"), F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b.block") == F.col("o.block")))
        .select("doc_id", F.col("h").alias("row_hash"), F.col("b.source").alias("source"), "size", "source_size", "target", "slope", (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("before"))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("bigint")
    return (
        joined.withColumn("passes", passes.cast("bigint"))
        .withColumn("rest", rest)
        .withColumn("taken", F.col("passes") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), F.col("rest") - F.col("before"))))
        .withColumn("first_pass", F.when(F.col("taken") > 0, F.col("before")))
        .withColumn("position", training_position())
        .select("doc_id", "size", "source", "source_size", "target", "taken", "slope", "first_pass", "position", "row_hash")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )
