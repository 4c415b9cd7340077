"""Counts of neighbouring bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are counted at a time, so that a long text takes no more memory than a short one.
CHUNK = 1 << 22


def byte_pairs(items: DataFrame, text_col: str) -> DataFrame:
    """(pair, n): how often each two bytes, as four hexadecimal digits, follow one another
    in a text's UTF-8. Pairs do not cross texts; null counts as empty.

    A task adds up its pairs in one array of 65,536 counters and hands on those above
    zero, so what is shuffled grows with the tasks and not with the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                if not value.is_valid:
                    continue
                own = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                for at in range(0, len(own) - 1, CHUNK):
                    part = own[at : at + CHUNK + 1].astype(np.uint16)
                    sums += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there])], ["place", "n"])

    found = items.select(F.col(text_col).cast("string")).mapInArrow(count, "place int, n bigint")
    return found.groupBy("place").agg(F.sum("n").alias("n")).select(F.lpad(F.hex("place"), 4, "0").alias("pair"), "n")
