"""Best-two-fit packing of documents into as few sequences as it can.

One sequence is filled at a time. It takes the longest waiting piece that fits,
again and again; when none fits, its shortest piece is replaced by the two
waiting pieces whose sum fills the room so gained most tightly, if that is more
than before. Lengths are whole numbers up to the limit, so a table of waiting
pieces by length is all the state that the search needs.

Packing goes in rounds, and no text is shuffled:

* Each task cuts and packs the documents of its own input partition, ``window``
  pieces at a time. Sequences with at most ``slack`` tokens of room are closed.
* The pieces of the others, named by task and number, are dealt evenly over
  blocks of about ``block`` pieces and packed again; what is then closed leaves,
  and the rest goes on in fewer blocks. A round that has one block, or follows
  one that closed less than half of what it had, closes all of its sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import staged, text_or_empty
from lorebase.llm.kernel import chunks
from lorebase.llm.tokens import encoder

#: Pieces as they travel: ``nth`` is a name that no other piece has, ``closed`` tells whether ``sequence_id`` is final.
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, nth bigint, closed boolean"


def fill(sizes: np.ndarray, limit: int) -> Iterator[list[int]]:
    """Sequences as lists of places in ``sizes``, each size from 1 to ``limit``."""
    waiting: list[list[int]] = [[] for _ in range(limit + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        waiting[int(sizes[i])].append(i)
    counts = np.bincount(sizes, minlength=limit + 1) if len(sizes) else np.zeros(limit + 1, np.int64)
    up_to = [(2 << k) - 1 for k in range(limit + 1)]
    there = 0  # bit k is set where pieces of length k wait
    for k in np.flatnonzero(counts).tolist():
        there |= 1 << k

    def take(k: int) -> int:
        nonlocal there
        counts[k] -= 1
        if not counts[k]:
            there ^= 1 << k
        return waiting[k].pop()

    while there:
        own, room = [], limit
        while fits := there & up_to[room]:
            k = fits.bit_length() - 1
            own.append(take(k))
            room -= k
        if room and there and len(own) > 1:
            last = int(sizes[own[-1]])
            gap = room + last
            lengths = np.flatnonzero(counts[: gap + 1])
            first = lengths[: np.searchsorted(lengths, gap // 2, "right")]
            if len(first):
                second = lengths[np.searchsorted(lengths, gap - first, "right") - 1]
                both = np.where((first == second) & (counts[first] < 2), 0, first + second)
                best = int(np.argmax(both))
                if both[best] > last:
                    i = own.pop()
                    own += [take(int(second[best])), take(int(first[best]))]
                    if not counts[last]:
                        there |= 1 << last
                    counts[last] += 1
                    waiting[last].append(i)
        yield own


def best_two_fit(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = 4096,
    window: int = 1 << 15,
    block: int = 1 << 14,
    slack: int | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` and, unless ``with_ids`` is false, ``ids`` (little-endian unsigned
    32-bit integers).

    * ``tokenizer`` is a tokenizer file's path, on every machine; id 1 ends each
      document. Only documents of more than ``tokens`` ids are cut, into pieces of
      ``tokens`` ids, the last of which may be shorter. Very long texts are so
      many whole sequences and a rest.
    * Sequences hold at most ``tokens`` ids, without gaps from offset 0 on.
    * Null and empty texts are one id, the end id. A null identifier stays null.
      Repeated rows are packed like any other. An empty table gives an empty
      result. Other columns are not read, whatever their names.
    * ``slack`` is the room that a closed sequence may have before the last round
      (by default a 512th of ``tokens``). A task that runs again gives the same
      rows: pieces are put in order of their names before they are packed.
    """
    if tokens < 1:
        raise ValueError("a sequence has to hold a token at least")
    slack = tokens // 512 if slack is None else slack
    schema = SCHEMA + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.binary()][: len(names)]

    def packed(pieces: pa.RecordBatch, first: int, last: bool) -> pa.RecordBatch:
        """The pieces in sequences numbered from ``first``; those of loose ones are not closed, unless it is the last round."""
        sizes = pieces["length"].to_numpy()
        order, numbers, closed = [], [], []
        for n, own in enumerate(fill(sizes, tokens)):
            tight = last or tokens - int(sizes[own].sum()) <= slack
            order += own
            numbers += [first + n] * len(own)
            closed += [tight] * len(own)
        out, numbers = pieces.take(pa.array(order, pa.int64())), np.array(numbers, np.int64)
        lengths = out["length"].to_numpy()
        ends = np.cumsum(lengths)
        new = np.concatenate(([True], numbers[1:] != numbers[:-1]))
        offset = ends - lengths - np.repeat((ends - lengths)[new], np.diff(np.append(np.flatnonzero(new), len(new))))
        put = {"sequence_id": pa.array(numbers), "offset": pa.array(offset), "closed": pa.array(closed, pa.bool_())}
        return pa.RecordBatch.from_arrays([put.get(c, out[c]) for c in names], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, rows = TaskContext.get().partitionId(), 0, []

        def close():
            nonlocal count
            base = (part << 32) + count
            count += len(rows)
            columns = list(zip(*rows))
            none, nth = [None] * len(rows), range(base, base + len(rows))
            own = [*columns[:5], none, none, nth, none, *columns[5:]][: len(names)]
            rows.clear()
            return packed(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds)], names=names), base, False)

        for batch in batches:
            identifiers = batch["doc_id"].to_pylist()
            for a, b, raw, offs in chunks(batch["text"]):
                ids, ends = encoder(tokenizer).encode(raw, offs)
                ids = ids.astype("<u4")
                for i in range(a, b):
                    own = ids[ends[i - a] : ends[i - a + 1]]
                    for n, start in enumerate(range(0, len(own), tokens)):
                        piece = own[start : start + tokens].tobytes()
                        rows.append((identifiers[i], n, start, len(piece) // 4, zlib.crc32(piece), piece))
                if len(rows) >= window:
                    yield close()
        if rows:
            yield close()

    def again(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [x for x in batches if len(x)]
            if own:
                whole = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
                yield packed(whole, (number << 58) + (TaskContext.get().partitionId() << 32), last)

        return run

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    now = staged(plain.mapInArrow(cut, schema))
    result = [c for c in names if c not in ("nth", "closed")]
    done, before, number, last = [now.where("closed").select(*result)], 0, 0, False
    while not last and (loose := now.where("NOT closed").count()):
        number += 1
        blocks = -(-loose // block)
        last = blocks == 1 or number > 1 and 2 * loose > before or number == 31
        dealt = now.where("NOT closed").repartitionById(blocks, F.pmod(F.xxhash64("nth"), F.lit(blocks)).cast("int")).sortWithinPartitions("nth")
        now, before = staged(dealt.mapInArrow(again(number, last), schema)), loose
        done.append(now.where("closed").select(*result))
    out = done[0]
    for x in done[1:]:
        out = out.unionAll(x)
    return out
