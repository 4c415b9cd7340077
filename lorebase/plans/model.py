"""The library's tables as views of the test tables.

documents: bookmarks (doc_id, text; source is the author). labels: review
(quality 1 approved, toxic 1 excluded). conversations: enrichments and threads.
pages: links (page_id is the bookmark) and captured pages.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bookmarks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("author"), "lang", "n_chars")


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer splits than there are cores is dealt over them before work on
    its rows; a larger one stays as it lies."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def texts(spark, sf_dir) -> DataFrame:
    """Bookmarks for work on whole texts."""
    return spread(bookmarks(spark, sf_dir))


_local_root: list[str] = []


def shared_folder(spark) -> str:
    """A new folder name in ``spark.checkpoint.dir``, which driver and executors share; where that
    is unset in a local session, one in a temporary folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not _local_root:
            _local_root.append("file://" + tempfile.mkdtemp(prefix="lorebase-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/lorebase-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a shared folder: for what several later branches read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def links(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")


def enrichments(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("role") == "user", "x-status").when(F.col("role") == "assistant", "x-conversation").otherwise("linked-page")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), kind.alias("source_type"), F.col("turn").alias("captured_at"), F.col("text").alias("content"))


def review(spark, sf_dir) -> DataFrame:
    """(id, slug): approved, excluded."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    return l.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("approved").alias("slug")).unionByName(l.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("excluded").alias("slug")))
