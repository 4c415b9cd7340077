"""Exact deduplication by a tree-merge of sorted digest runs.

Every document becomes an entry (digest, identifier). The documents are dealt
over ``leaves`` by a hash of their identifier, and each leaf collapses its
entries to one sorted run with one entry for each digest. The runs then meet
in binomial rounds: in each round ``fan_in`` sibling nodes exchange their runs,
which are merged by digest (the exchange's external sort is the multiway
merge) and collapsed as they stream by; an entry keeps the identifier that
stays and the number of rows it stands for. A node's run is spread over tasks
by digest, so no task holds a whole run, and a digest enters a round at most
``fan_in`` times however many copies it has.

The decision goes down the same tree: the root's entries are joined to the
leaves' entries (one for each digest and leaf), and these to the documents of
the leaf, so a digest shared by a third of all rows is dealt over all leaves.

Entries merge only where SHA-256, byte length and a second, independent 64-bit
hash all agree, at every level; a collision of the first digest alone would
leave two entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import shuffle_partitions, staged, text_or_empty

KEY = ["sha", "n_bytes", "check"]
#: Stands for a null identifier, which never wins over another.
NO_ID = -(1 << 63)


def merge_sorted_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse neighbouring entries of one node and digest, keeping the largest
    identifier and the sum of the counts. Holds one batch and one entry."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table]).combine_chunks()
        n = table.num_rows
        if n == 0:
            continue
        new = np.ones(n, bool)
        if n > 1:
            same = np.ones(n - 1, bool)
            for name in ("node", "n_bytes", "check"):
                x = table[name].to_numpy()
                same &= x[1:] == x[:-1]
            sha = np.frombuffer(b"".join(table["sha"].to_pylist()), np.uint8).reshape(n, 32)
            same &= (sha[1:] == sha[:-1]).all(axis=1)
            new[1:] = ~same
        first = np.flatnonzero(new)
        out = table.take(pa.array(first))
        keep = np.maximum.reduceat(table["keep_id"].to_numpy(), first)
        rows = np.add.reduceat(table["group_size"].to_numpy(), first)
        out = out.set_column(out.schema.get_field_index("keep_id"), "keep_id", pa.array(keep, pa.int64()))
        out = out.set_column(out.schema.get_field_index("group_size"), "group_size", pa.array(rows, pa.int64()))
        yield from out.slice(0, out.num_rows - 1).to_batches()
        carry = out.slice(out.num_rows - 1)
    if carry is not None:
        yield from carry.to_batches()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, leaves: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * Texts are equal when identical; nothing is normalised. Null text counts
      as empty, so nulls and empty texts form one group.
    * Of equal texts the row with the largest identifier stays. A null
      identifier stays only if the group has no other. Of rows repeated with
      the same identifier and text exactly one is ``kept``.
    * Other columns of ``docs`` are not read, so their names can't clash.
    * An empty table gives an empty result. Texts of any length take constant
      space, as only digests are moved.
    """
    spark = docs.sparkSession
    leaves = leaves or shuffle_partitions(spark)
    rounds = 0
    while fan_in**rounds < leaves:
        rounds += 1
    text = text_or_empty(text_col)
    base = staged(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("t")).select(
            "doc_id",
            F.unhex(F.sha2("t", 256)).alias("sha"),
            F.octet_length("t").cast("bigint").alias("n_bytes"),
            F.xxhash64("t").alias("check"),
            F.pmod(F.xxhash64("doc_id"), F.lit(fan_in**rounds)).alias("leaf"),
        )
    )
    leaf_runs = staged(
        base.groupBy(F.col("leaf").alias("node"), *KEY).agg(
            F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
    )
    runs = leaf_runs
    for _ in range(rounds):
        runs = (
            runs.withColumn("node", F.floor(F.col("node") / F.lit(fan_in)))
            .repartition("node", "sha")
            .sortWithinPartitions("node", *KEY)
            .mapInArrow(merge_sorted_entries, runs.schema)
        )
    down = leaf_runs.select(F.col("node").alias("leaf"), *KEY).join(runs.drop("node"), KEY)
    once = Window.partitionBy("leaf", *KEY, "doc_id").orderBy(F.lit(1))
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return (
        base.join(down, ["leaf", *KEY])
        .withColumn("nth", F.row_number().over(once))
        .select(
            "doc_id",
            keep.alias("keep_id"),
            "group_size",
            (F.col("doc_id").eqNullSafe(keep) & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
