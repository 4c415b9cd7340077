"""The stages of the corpus pipeline: operators whose decisions take effect.

Decisions are taken by identifier and text, so rows that share an identifier go
their own ways. Texts are not shuffled to drop rows: a filter of a fixed size
clears nearly all rows where they lie (``divided``), and only the others meet
the decisions in a join. Columns that stages add bear names no table has.
Tables that an operator stages on the way are removed once its decisions are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.llm.common import divided, fresh, read, rows_per_batch, scratch, shuffle_partitions, staged, text_or_empty
from lorebase.llm.curriculum import curriculum_mix, training_position
from lorebase.llm.exact_dedup import exact_dedup
from lorebase.llm.jaccard_join import ngram_jaccard
from lorebase.llm.packing import pack_documents
from lorebase.llm.queries import tokenizer_file
from lorebase.llm.toxicity import TEXTS, fit_toxicity, scored

#: Rows that score this much or more are toxic.
TOXIC = 0.3


def with_verdict(docs: DataFrame, verdict: DataFrame, text_key: Column) -> DataFrame:
    """``docs`` without the rows that ``verdict`` (doc_id, key, kept) drops; of rows
    repeated with a kept identifier and key one stays. Rows without a verdict stay."""
    clear, rest = divided(docs, verdict, "doc_id")
    key, kept, nth, own = fresh("key"), fresh("kept"), fresh("nth"), fresh("id")
    told = verdict.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("kept").alias(kept))
    met = rest.join(told, F.col("doc_id").eqNullSafe(F.col(own)) & (text_key == F.col(key)), "left")
    order = [F.xxhash64(*[c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t and t != "variant"] or [F.lit(1)])]
    once = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(*order))
    none = F.col(kept).isNull()
    chosen = met.where(~none & F.col(kept)).withColumn(nth, once).where(F.col(nth) == 1)
    return clear.unionAll(met.where(none).select(*docs.columns)).unionAll(chosen.select(*docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold, row by row. Where labels of
    both classes are missing there is no model, and nothing is dropped."""
    with scratch(spark), rows_per_batch(spark, TEXTS):
        model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
        if not model.fitted:
            return docs
        toxic = scored(docs, model).where(F.col("score") >= TOXIC).select("doc_id", F.col("text_hash").alias("key"), F.lit(False).alias("kept")).distinct()
        toxic = staged(toxic, keep=True)
    return with_verdict(docs, toxic, F.xxhash64(text_or_empty("text")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text; null and empty texts are one text."""
    with scratch(spark):
        found = exact_dedup(docs).where("group_size > 1").withColumn("key", F.unhex("text_sha256"))
        verdict = found.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
        verdict = staged(verdict.where("NOT kept OR rows > 1").drop("rows"), keep=True)
    return with_verdict(docs, verdict, F.unhex(F.sha2(text_or_empty("text"), 256)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked over shingles of five words at 0.8: that
    with the smallest identifier (null last; of equal ones that with the smallest
    hash of its text). Documents without words stay."""
    with scratch(spark):
        found = ngram_jaccard(docs, words=5, percent=80).where("component_hash IS NOT NULL").select("doc_id", F.col("text_hash").alias("key"), "component_hash")
        rows = staged(found.groupBy("component_hash", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows")))
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
        stays = rows.groupBy("component_hash").agg(F.min(first).alias("first"), F.sum("rows").alias("all")).where("all > 1")
        verdict = rows.join(stays, "component_hash").withColumn("kept", first.eqNullSafe(F.col("first")))
        verdict = staged(verdict.where("NOT kept OR rows > 1").select("doc_id", "key", "kept"), keep=True)
    return with_verdict(docs, verdict, F.xxhash64(text_or_empty("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted by training position.

    A document taken in part (one a source at most) counts as a whole if at
    least half is taken. Documents without words are none of the mix's business
    and stay, at the end. Each pass over a source has positions of its own.
    Rows equal in identifier, text and source are taken equally often."""
    own, source, place = fresh("row"), fresh("source"), fresh("position")
    with scratch(spark):
        columns = ["size", "source_size", "target", "slope", "first_pass"]
        mix = curriculum_mix(docs).groupBy("row_hash", "source").agg(F.avg("taken").alias("taken"), *[F.min(c).alias(c) for c in columns])
        times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
        passes = mix.withColumn("times", times).where("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
        at = F.coalesce(training_position(F.col("nth")), F.lit(1.0))
        plan = staged(passes.select(F.col("row_hash").alias(own), F.col("source").alias(source), at.alias(place)), keep=True)
    # Positions spread over [0, 1] by the schedules, so equal ranges of them need no sample.
    n = shuffle_partitions(spark)
    same = (F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text")) == F.col(own)) & F.col("source").cast("string").eqNullSafe(F.col(source))
    ranged = docs.join(plan, same).repartitionById(n, F.least(F.floor(F.col(place) * n), F.lit(n - 1)).cast("int"))
    return ranged.sortWithinPartitions(place, "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All earlier stages have run in the same executors, so this one keeps to little
    memory: few texts at a time, which is why it runs here and not where its rows are read."""
    with rows_per_batch(spark, TEXTS):
        return staged(pack_documents(docs, tokenizer_file(), with_ids=False, units=1 << 16, piece=1 << 17), keep=True)
