"""The most frequent runs of words, exactly, without a row for each run that occurs.

Two passes over the texts. The first adds up a sketch: counters of a fixed number, each of all runs whose
hash falls into it, so no run is more frequent than its counter. Meanwhile each task counts a bounded
number of runs that it meets often, which tells a frequency that ``k`` runs reach for certain. The second
pass counts the runs whose counters reach that, and no others.
Runs are told apart by 64-bit hashes within a task's batch, and by their words after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.plans.model import written

#: Counters of a sketch, and how many travel as one row.
BUCKETS, SLICE = 1 << 20, 1 << 14
#: Runs that a task knows as frequent, and runs counted at once.
KNOWN, COUNTED = 1 << 16, 1 << 20
#: Bytes of whole texts worked on at a time.
CHUNK = 1 << 20
U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, U)
    steps[:1] = 1
    return np.cumprod(steps)


_powers_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, CHUNK + (CHUNK >> 2))
    if size > CHUNK + (CHUNK >> 2):
        return _powers(_BASE, size), _powers(_INVERSE, size)
    if not _powers_of:
        _powers_of[0] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _powers_of[0]


def runs(raw: np.ndarray, offsets: np.ndarray, widths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(width, places of first words, hashes, starts and ends of all words) of runs of ``widths`` words a-z that lie in one text."""
    inner = np.zeros(len(raw) + 2, bool)
    inner[1:-1] = (raw >= 97) & (raw <= 122)
    starts_at, ends_at = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    both = cuts[inner[cuts] & inner[cuts + 1]]  # a word on each side of a text's end
    starts_at[both], ends_at[both - 1] = True, True
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    up, down = _both_powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(raw * up[: len(raw)], dtype=U)))
    words = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))
    text = np.searchsorted(offsets, starts, "right")
    for width in widths:
        n = max(len(words) - width + 1, 0)
        hashes = np.zeros(n, U)
        for i in range(width):
            hashes = hashes * U(_BASE) + words[i : i + n]
        at = np.flatnonzero(text[:n] == text[width - 1 : width - 1 + n])
        yield width, at, _mixed(hashes[at]), starts, ends


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of whole texts, about ``CHUNK`` bytes at a time; null counts as empty."""
    texts = pc.fill_null(batch.column(0), "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1))
        yield raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Known:
    """Hashes that a task meets more than once, and how often at least; memory is bounded."""

    def __init__(self):
        self.waiting, self.size = [], 0
        self.hashes, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size >= COUNTED:
            self.close()

    def close(self, least: int = 2) -> None:
        hashes, counts = np.unique(np.concatenate([np.zeros(0, U), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        often = counts >= least
        self.hashes, place = np.unique(np.concatenate((self.hashes, hashes[often])), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate((self.counts, counts[often])), len(self.hashes)).astype(np.int64)
        if len(self.hashes) > KNOWN:
            most = np.sort(np.argpartition(-self.counts, KNOWN)[:KNOWN])
            self.hashes, self.counts = self.hashes[most], self.counts[most]


def top_grams(items: DataFrame, text_col: str, widths: tuple[int, ...], k: int) -> DataFrame:
    """(width, gram, n): the ``k`` most frequent runs of each of ``widths`` words (letters a-z of the lower-cased
    text), ties by their words; runs do not cross texts. The sketch is made when this is called."""
    texts = items.select(F.lower(F.col(text_col)).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = {w: np.zeros(BUCKETS, np.int64) for w in widths}, {w: Known() for w in widths}
        for batch in batches:
            for raw, offsets in chunks(batch):
                for w, _, hashes, _, _ in runs(raw, offsets, widths):
                    sums[w] += np.bincount((hashes & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                    known[w].add(hashes)
        rows = []
        for w in widths:
            known[w].close(1)
            rows += [(w, i, sums[w][i * SLICE : (i + 1) * SLICE].tobytes(), None, None) for i in range(BUCKETS // SLICE) if sums[w][i * SLICE : (i + 1) * SLICE].any()]
            rows.append((w, None, None, known[w].hashes.view(np.int64), known[w].counts))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["width", "slice", "counts", "hashes", "least"])

    made = written(texts.mapInArrow(sketch, "width int, slice int, counts binary, hashes array<bigint>, least array<bigint>"))
    sure = made.where("hashes IS NOT NULL").select("width", F.inline(F.arrays_zip("hashes", "least"))).groupBy("width", "hashes").agg(F.sum("least").alias("least"))
    order = Window.partitionBy("width").orderBy(F.desc("least"), "hashes")
    reached = dict(sure.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("width", "least").collect())  # a row for each width

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def close():
            if key is not None and (marks := total >= reached.get(key[0], 1)).any():
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["width", "slice", "marks"])

        for batch in batches:
            for w, i, counts in zip(*(batch[c].to_pylist() for c in ("width", "slice", "counts"))):
                if key != (w, i):
                    yield from close()
                    key, total = (w, i), np.zeros(SLICE, np.int64)
                total += np.frombuffer(counts, np.int64)
        yield from close()

    slices = made.where("slice IS NOT NULL").select("width", "slice", "counts").repartition("width", "slice").sortWithinPartitions("width", "slice")
    marks = {w: np.zeros(BUCKETS, bool) for w in widths}
    for w, i, own in slices.mapInArrow(reaching, "width int, slice int, marks binary").collect():  # a bit for each counter
        marks[w][i * SLICE : (i + 1) * SLICE] = np.unpackbits(np.frombuffer(own, np.uint8)).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offsets in chunks(batch):
                for w, at, hashes, starts, ends in runs(raw, offsets, widths):
                    hit = marks[w][(hashes & U(BUCKETS - 1)).astype(np.int64)]
                    _, first, n = np.unique(hashes[hit], return_index=True, return_counts=True)
                    own = raw.tobytes()
                    said = [b" ".join(own[a:b] for a, b in zip(starts[i : i + w].tolist(), ends[i : i + w].tolist())).decode() for i in at[hit][first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(said), pa.int32()), pa.array(said, pa.string()), pa.array(n, pa.int64())], names=["width", "gram", "n"])

    found = texts.mapInArrow(count, "width int, gram string, n bigint").groupBy("width", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("width").orderBy(F.desc("n"), "gram")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
