"""Streams: captured items into a versioned table, and counts by event time.

The table is dealt into buckets by a hash of the key. A batch rewrites only the
buckets it touches, under its own number, then writes a manifest that names each
bucket's current version. Readers go by the newest manifest, so half-written
batches are never seen, and a batch that runs again starts from the manifest
before it. A missing manifest is an error, never an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.operators.records import upsert
from lorebase.sources.capture import ITEM, normalise

BUCKETS = 16


def items(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New files of a folder of JSON lines."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files).json(path)


def last_of(batch: DataFrame) -> DataFrame:
    """The last value of each status in a batch, by time of capture."""
    w = Window.partitionBy("status_id").orderBy(F.col("captured_at").desc_nulls_last(), "content_hash")
    return batch.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests there are."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{n}/_SUCCESS")))


def _read(spark: SparkSession, path: str, version: int, only: list[int] | None = None) -> DataFrame | None:
    rows = spark.read.parquet(f"{path}/manifest/v={version}").collect()  # a row per bucket
    paths = [f"{path}/v={r['version']}/bucket={r['bucket']}" for r in rows if only is None or r["bucket"] in only]
    return spark.read.parquet(*paths) if paths else None


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its newest manifest."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no manifest in {path}")
    return _read(spark, path, versions[-1])


class TableWriter:
    """A ``foreachBatch`` function: batch n gives version n of the table.

    ``state`` counts what was seen: batches, items and new items in all, batches in
    a row without a new item (``stagnant``) and without one that is not in ``known``
    (status_id; ``stagnant_known``). ``report`` is called with it after each batch."""

    def __init__(self, path: str, known: DataFrame | None = None, report: Callable[[dict], None] | None = None, buckets: int = BUCKETS):
        self.path, self.known, self.report, self.buckets = path, known, report, buckets
        self.state = {"batches": 0, "seen": 0, "new": 0, "stagnant": 0, "stagnant_known": 0}

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        versions = _versions(spark, self.path)
        if n and n - 1 not in versions or not n and any(versions):
            raise FileNotFoundError(f"batch {n} of {self.path} follows version {n - 1}, but the manifests are {versions}")
        arriving = last_of(normalise(batch)).withColumn("bucket", F.pmod(F.xxhash64("status_id"), F.lit(self.buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in arriving.select("bucket").distinct().collect()]  # at most so many buckets
            stored = _read(spark, self.path, n - 1, touched) if n else None
            plain = arriving.drop("bucket")
            new = upsert(stored if stored is not None else plain.limit(0), plain, "status_id", "content_hash", keep=("captured_at",))
            counts = Observation()
            new = new.observe(counts, F.count_if(F.col("change") != "absent").alias("seen"), F.count_if(F.col("change") == "new").alias("new"))
            placed = new.drop("change").withColumn("bucket", F.pmod(F.xxhash64("status_id"), F.lit(self.buckets)).cast("int"))
            placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={n}")
            fresh = arriving if self.known is None else arriving.join(self.known.select("status_id"), "status_id", "left_anti")
            unknown = fresh.count()
        finally:
            arriving.unpersist()
        rows = [(r["bucket"], r["version"]) for r in (spark.read.parquet(f"{self.path}/manifest/v={n - 1}").collect() if n else []) if r["bucket"] not in touched]
        manifest = spark.createDataFrame(rows + [(b, n) for b in touched], "bucket int, version int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={n}")
        got, s = counts.get if touched else {"seen": 0, "new": 0}, self.state
        s["batches"], s["seen"], s["new"] = s["batches"] + 1, s["seen"] + got["seen"], s["new"] + got["new"]
        s["stagnant"] = 0 if got["new"] else s["stagnant"] + 1
        s["stagnant_known"] = 0 if got["new"] and unknown else s["stagnant_known"] + 1
        if self.report:
            self.report(dict(s))


def start(spark: SparkSession, source: str, writer: TableWriter, checkpoint: str, files: int = 100, **trigger):
    """A running query; the checkpoint resumes where it stopped."""
    return items(spark, source, files).writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, known: DataFrame | None = None, stop_after: int | None = None, stop_at_known: int | None = None, report: Callable[[dict], None] | None = None, files: int = 100, writer=None) -> dict:
    """Everything there is now, in batches; ends earlier after ``stop_after`` batches in a
    row without a new item, or ``stop_at_known`` without one that isn't known. Returns the counts.
    ``writer`` is a ``TableWriter`` by default; a ``KeptTable`` writes no more than each batch brings."""
    writer = writer or TableWriter(table, known, report)
    query = start(spark, source, writer, checkpoint, files)
    done = False
    while not done:
        done = query.awaitTermination(0.2)
        s = writer.state
        if not done and (stop_after and s["stagnant"] >= stop_after or stop_at_known and s["stagnant_known"] >= stop_at_known):
            query.stop()
            done = True
    return writer.state


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", "user_id", "n")
