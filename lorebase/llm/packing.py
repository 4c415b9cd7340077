"""Packing examples into training sequences by vector bin packing.

A sequence has limits on tokens, on segments (examples or parts of them) and
on loss-bearing tokens. An example asks for a vector of the three. Each task
packs the examples of its own input partition, so no text is shuffled:

* whole sequences are cut off examples that are longer than one;
* what is left goes to open sequences by the dot-product heuristic: of the
  examples that fit, the one whose demand has the largest dot product with the
  sequence's remaining room (both as shares of the limits) is placed next;
* where none fits, a piece of the largest waiting example fills the room.

Examples wait in a window of at most ``window`` examples; what can't fill a
sequence waits for the next ones. At a task's end, what is left is cut so that
its sequences are powers of two long, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import releasing, text_or_empty
from lorebase.llm.kernel import CHUNK, chunks
from lorebase.llm.tokens import MOST, encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"


class Packer:
    """Places examples one window at a time; yields pieces (example, start, length, sequence, offset)."""

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, window: int = 1024):
        if tokens & (tokens - 1):
            raise ValueError("the token limit has to be a power of two")
        self.limit = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.window = tokens, window
        self.wait: list[list] = []  # [example, start, tokens left, first token with loss]
        self.sequences = 0

    def _open(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    @staticmethod
    def _loss(item, length: int) -> int:
        _, start, _, prompt = item
        return max(0, start + length - max(start, prompt))

    def add(self, example, length: int, prompt: int = 0) -> Iterator[tuple]:
        """``prompt``: so many tokens at the start of the example bear no loss."""
        start = 0
        while length - start >= self.tokens and self.limit[2] >= self.tokens:
            yield example, start, self.tokens, self._open(), 0
            start += self.tokens
        if start < length:
            self.wait.append([example, start, length - start, prompt])
        if len(self.wait) >= self.window:
            yield from self._pack(False)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack(True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        items, self.wait = self.wait, []
        left = np.array([x[2] for x in items], float)
        demand = np.stack([left, np.ones(len(items)), np.array([self._loss(x, x[2]) for x in items], float)], 1) / self.limit
        alive = np.ones(len(items), bool)
        while alive.any():
            if not last and left[alive].sum() < self.tokens:
                break
            room, placed = np.ones(3), []
            while True:
                fits = np.flatnonzero(alive & (demand <= room + 1e-12).all(1))
                if not len(fits):
                    break
                best = fits[np.argmax(demand[fits] @ room)]
                placed.append((items[best], items[best][1], int(left[best])))
                alive[best] = False
                room = room - demand[best]
            free = round(room[0] * self.tokens)
            if free and alive.any() and round(room[1] * self.limit[1]) >= 1:
                best = int(np.argmax(np.where(alive, left, -1)))
                item = items[best]
                length = min(free, int(left[best]))
                spare = round(room[2] * self.limit[2])
                if self._loss(item, length) > spare:
                    length = max(0, item[3] - item[1]) + spare
                if length > 0:
                    placed.append((item, item[1], length))
                    item[1], item[2] = item[1] + length, item[2] - length
                    left[best] -= length
                    demand[best] = np.array([left[best], 1, self._loss(item, item[2])]) / self.limit
                    alive[best] = left[best] > 0
                    free -= length
            yield from self._lay(placed, self.tokens - free)
        self.wait = [x for x, a in zip(items, alive) if a]

    def _lay(self, placed: list, total: int) -> Iterator[tuple]:
        """One sequence, or one for each binary digit of a total that is no power of two."""
        room = offset = 0
        for item, start, length in placed:
            while length:
                if not room:
                    room, offset, at = 1 << (total.bit_length() - 1), 0, self._open()
                    total -= room
                take = min(room, length)
                yield item[0], start, take, at, offset
                start, length, offset, room = start + take, length - take, offset + take, room - take


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = 2048,
    segments: int = 64,
    loss: int | None = None,
    prompt_col: str | None = None,
    window: int = 1024,
    with_ids: bool = True,
    units: int = MOST,
    piece: int = CHUNK,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens`` and, unless ``with_ids`` is false, ``ids``
    (little-endian unsigned 32-bit integers).

    * ``tokenizer`` is a tokenizer file's path, on every machine; id 1 ends each document.
    * A piece starts at ``start`` of its document and lies at ``offset`` of its
      sequence; every id is in exactly one piece, and sequences have no gaps.
    * Null text counts as empty and is one token, the end id. A null identifier
      stays null. Repeated rows are packed like any other. An empty table gives
      an empty result. Long texts are cut into whole sequences first.
    * ``prompt_col``: tokens at the start of an example that bear no loss (null: none).
    * ``units`` of texts are kept encoded by a worker, and ``piece`` bytes of texts are
      worked on at once: smaller numbers take less memory and more time.
    * Identifiers of sequences are the task's number and a running number, so a
      task that runs again gives the same rows.
    """
    prompt = F.coalesce(F.col(prompt_col).cast("bigint"), F.lit(0)) if prompt_col else F.lit(0)
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = Packer(tokens, segments, loss, window), TaskContext.get().partitionId() << 40
        kept: dict[int, list] = {}  # of examples that wait: identifier, ids, tokens not yet placed
        out: list[tuple] = []

        def write(pieces):
            for n, start, length, sequence, offset in pieces:
                own = kept[n]
                raw = own[1][start : start + length].tobytes()
                bearing = max(0, start + length - max(start, own[3]))
                out.append((own[0], start, length, zlib.crc32(raw), len(own[1]), first + sequence, offset, bearing, *([raw] if with_ids else [])))
                own[2] -= length
                if not own[2]:
                    del kept[n]

        def rows():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 8 else pa.binary()) for i, c in enumerate(columns)], names=names)

        names = [x.split()[0] for x in schema.split(", ")]
        count = 0
        for batch in batches:
            identifiers, prompts = batch["doc_id"].to_pylist(), batch["prompt"].to_numpy()
            for a, b, raw, offs in chunks(batch["text"], piece):
                ids, ends = encoder(tokenizer, units).encode(raw, offs)
                ids = ids.astype("<u4")
                for i in range(a, b):
                    own = ids[ends[i - a] : ends[i - a + 1]]
                    kept[count] = [identifiers[i], own.copy(), len(own), int(prompts[i])]
                    write(packer.add(count, len(own), int(prompts[i])))
                    count += 1
                if len(out) >= 4096:
                    yield rows()
        write(packer.finish())
        if out:
            yield rows()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), prompt.alias("prompt"), text_or_empty(text_col).alias("text")).mapInArrow(releasing(pack), schema)
