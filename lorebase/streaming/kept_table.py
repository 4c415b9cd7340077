"""Last value of each key of a stream, as a log of segments that is merged by size.

A batch writes one segment with what it changes, sorted by key, and a manifest that
names it; nothing that is stored is written again but by merges, which take in
only the youngest segments. So a batch's bytes grow with the batch, and a row is
written again only into a segment at least twice as large (``segmented``).

A value holds by time of capture, ties by content hash, whatever batch brings it:
items that come late or again change nothing that is younger than they are, and
any order of batches gives the table that one batch of all of them gives.

The manifest keeps the number of the last batch of each stream. A batch that runs
again after its version was made is left out; one that failed before left files
that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorebase.operators.segmented import Segmented, merge_from

KINDS = ("new", "changed", "restated")


class KeptTable(Segmented):
    """Rows of ``schema`` by ``key`` (text or whole numbers) in the folder ``path``; ``at``, then ``hashed``, orders the values of a key.

    Also a ``foreachBatch`` function. ``prepare`` makes a batch rows of ``schema``;
    ``change`` is called with the changes of each batch, ``report`` with the counts so far (``state``, as
    that of ``TableWriter``). Rows without a key are left out; a null time is the oldest.
    A batch without a change makes a version, so that its number is kept, but no segment."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str = "status_id", at: str = "captured_at", hashed: str = "content_hash", stream: str = "stream", known: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, change: Callable[[DataFrame], None] | None = None, report: Callable[[dict], None] | None = None):
        super().__init__(spark, path)
        self.schema, self.key, self.at, self.hashed, self.stream = schema, key, at, hashed, stream
        self.known, self.prepare, self.change, self.report = known, prepare, change, report
        self.columns = spark.createDataFrame([], schema).columns
        self.state = {"batches": 0, "seen": 0, "new": 0, "stagnant": 0, "stagnant_known": 0}

    def _order(self) -> Column:
        return F.struct(F.col(self.at).isNotNull(), self.at, self.hashed)

    def last_of(self, rows: DataFrame, *more: Column) -> DataFrame:
        """The row of each key that holds. An aggregate that starts where the rows lie, so a key
        that most rows have is no task's load."""
        best = rows.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("__key")).agg(F.max_by(F.struct(*self.columns), self._order()).alias("__row"), *more)
        return best.select("__row.*", *[c for c in best.columns if c not in ("__key", "__row")])

    def _rows(self, segments: list[dict]) -> DataFrame:
        """All rows of segments, values no longer held included."""
        paths = [f"{self.path}/{x['name']}" for x in segments]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """The table as of its newest version."""
        segments = self.manifest()["segments"]
        rows = self._rows(segments)
        return self.last_of(rows) if len(segments) > 1 else rows  # a segment has one row a key

    def _segment(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.select(*self.columns).repartitionByRange(self.key).sortWithinPartitions(self.key).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        n, first, last = self._rows([{"name": name}]).agg(F.count(F.lit(1)), F.min(self.key), F.max(self.key)).first()
        return {"name": name, "rows": n, "first": first, "last": last, "bytes": self._fs.getContentSummary(self._at(name)).getLength()}

    def _changes(self, last: DataFrame, segments: list[dict], low, high) -> DataFrame:
        """Rows of ``last`` that come to hold, with ``change``: new, changed, or restated (the same content,
        captured later). Of what is stored, only key, time and hash are read, in segments
        that may hold the batch's keys, and a semi join with these thins them before they are grouped."""
        own = [x for x in segments if low is not None and x["first"] <= high and x["last"] >= low]
        stored = self._rows(own).select(self.key, self.at, self.hashed)
        if low is not None:
            stored = stored.where(F.col(self.key).between(F.lit(low), F.lit(high)))
        thin = stored.join(last.select(self.key), self.key, "left_semi")
        held = thin.groupBy(self.key).agg(F.max(self._order()).alias("__held"), F.max_by(self.hashed, self._order()).alias("__hash"))
        kind = F.when(F.col("__held").isNull(), "new").when(F.col("__hash").eqNullSafe(F.col(self.hashed)), "restated").otherwise("changed")
        both = last.join(held, self.key, "left").where(F.col("__held").isNull() | (self._order() > F.col("__held")))
        return both.select(*self.columns, kind.alias("change"))

    def apply(self, batch: DataFrame, n: int | None = None) -> dict:
        """Take in one batch; ``n`` is its number in the stream. Returns its counts, and bytes written for it and by merges."""
        before = self.manifest()
        batches = dict(before.get("batches", {}))
        done = dict.fromkeys((*KINDS, "seen", "unknown", "bytes", "merged_bytes"), 0) | {"repeated": n is not None and batches.get(self.stream, -1) >= n}
        if done["repeated"]:
            return done
        segments = list(before["segments"])
        last = self.last_of(self.prepare(batch) if self.prepare else batch, F.count(F.lit(1)).alias("__n")).persist()
        try:
            low, high, seen = last.agg(F.min(self.key), F.max(self.key), F.sum("__n")).first()
            done["seen"] = seen or 0
            found = self._changes(last.drop("__n"), segments, low, high).persist()
            try:
                done |= {r["change"]: r["count"] for r in found.groupBy("change").count().collect()}  # three rows at most
                if any(done[k] for k in KINDS):
                    segments.append(self._segment(found))
                    done["bytes"] = segments[-1]["bytes"]
                fresh = found.where("change = 'new'")
                done["unknown"] = done["new"] if self.known is None else fresh.join(self.known.select(self.key), self.key, "left_anti").count()
                while (start := merge_from([x["rows"] for x in segments])) is not None:
                    segments[start:] = [self._segment(self.last_of(self._rows(segments[start:])))]
                    done["merged_bytes"] += segments[-1]["bytes"]
                if self.change:
                    self.change(found)  # before the version is there: at least once, and none is lost
            finally:
                found.unpersist()
        finally:
            last.unpersist()
        self._commit(before, segments, batches=batches if n is None else batches | {self.stream: n})
        return done

    def __call__(self, batch: DataFrame, n: int) -> None:
        done, s = self.apply(batch, n), self.state
        s["batches"], s["seen"], s["new"] = s["batches"] + 1, s["seen"] + done["seen"], s["new"] + done["new"]
        s["stagnant"] = 0 if done["new"] else s["stagnant"] + 1
        s["stagnant_known"] = 0 if done["unknown"] else s["stagnant_known"] + 1
        if self.report:
            self.report(dict(s))
