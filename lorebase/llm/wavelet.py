"""Token ids as wavelet matrices, one compressed file for each run of documents.

A file holds the ids of consecutive documents as bit-planes, the highest bit
first; each plane is ordered by a stable partition on the plane before. Planes
are cut into chunks that are compressed one by one, and beside them lies a
directory: the ones before every 512th bit of each plane. Rank adds up within
one block of 512 bits, select searches the directory for the block. So a file
answers which id is at a place, how often an id occurs before a place, and where
its k-th occurrence is, and inflates one chunk or two a plane for it. Runs of
ids are read by the same steps, for many places at once.

Layout (little-endian): ``WMX2``, then unsigned 64-bit numbers of ids, documents
and planes, then zstd frames, each after its length as an unsigned 64-bit
number: identifiers (int64), null marks, lengths (uint64), the directory (uint32,
plane by plane) and the chunks' lengths (uint64, plane by plane); then the chunks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import shared_dir, shuffle_partitions, staged, text_or_empty
from lorebase.llm.kernel import chunks
from lorebase.llm.storage import create, open_file
from lorebase.llm.tokens import encoder

MAGIC = b"WMX2"
BLOCK = 512
#: Bytes of a plane that are compressed as one; a multiple of a block's.
CHUNK = 1 << 15
#: A file is closed at so many ids.
FILE_IDS = 1 << 22
#: Ids that are read from a file at once.
RUN = 1 << 18


class Plane:
    """Bits with rank and select. ``chunk(c)`` gives the bytes of a chunk, ``ones_before``
    the number of ones before every block, and of all."""

    def __init__(self, n: int, chunk, ones_before: np.ndarray):
        self.n, self.chunk, self.ones_before = n, chunk, ones_before
        self.zeros = n - int(ones_before[-1])
        self.have: dict[int, np.ndarray] = {}
        self.whole = None

    def block(self, b: int) -> np.ndarray:
        c, at = divmod(b * (BLOCK // 8), CHUNK)
        if c not in self.have:
            self.have[c] = self.chunk(c)
        return self.have[c][at : at + BLOCK // 8]

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def ones(self, i: int) -> int:
        """Ones before place ``i``."""
        b, rest = divmod(i, BLOCK)
        out = int(self.ones_before[b])
        return out + int(np.unpackbits(self.block(b)[: (rest + 7) // 8], count=rest).sum(dtype=np.int64)) if rest else out

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero."""
        before = self.ones_before if bit else np.minimum(np.arange(len(self.ones_before)) * BLOCK, self.n) - self.ones_before
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.block(b))[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def many(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bit, ones before) of many places."""
        if self.whole is None:
            data = np.concatenate([np.zeros(0, np.uint8)] + [self.have[c] if c in self.have else self.chunk(c) for c in range(-(-self.n // (8 * CHUNK)))])
            ones = np.zeros(len(data) + 1, np.uint32)
            np.cumsum(np.bitwise_count(data), out=ones[1:])
            self.whole = np.append(data, np.uint8(0)), ones
        data, ones = self.whole
        byte, rest = at >> 3, (at & 7).astype(np.uint8)
        own = data[byte]
        return (own >> (7 - rest) & 1).astype(bool), ones[byte].astype(np.int64) + np.bitwise_count(own & ~(np.uint8(255) >> rest))


class WaveletMatrix:
    """Bit-planes with rank and select over a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for k in reversed(range(bits)):
            bit = (row >> k & 1).astype(bool)
            data = np.packbits(bit)
            data = np.concatenate((data, np.zeros(-len(data) % (BLOCK // 8), np.uint8)))
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(data.reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)))).astype(np.uint32)
            planes.append(Plane(len(row), lambda c, data=data: data[c * CHUNK : (c + 1) * CHUNK], ones))
            row = np.concatenate((row[~bit], row[bit]))
        return cls(len(ids), planes)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in self.planes:
            bit, before = p.bit(i), p.ones(i)
            value = value << 1 | bit
            i = p.zeros + before if bit else i - before
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids from place ``a`` to ``b``."""
        at, value = np.arange(a, b), np.zeros(b - a, np.uint32)
        for p in self.planes:
            bit, before = p.many(at)
            value = value << np.uint32(1) | bit
            at = np.where(bit, p.zeros + before, at - before)
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``i`` lie in the order of the last plane."""
        a, b = 0, min(i, self.n)
        for k, p in enumerate(self.planes):
            x, y = p.ones(a), p.ones(b)
            a, b = (p.zeros + x, p.zeros + y) if value >> (len(self.planes) - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` before place ``i``."""
        if value >> len(self.planes):
            return 0
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the occurrence number ``k`` (from 0) of ``value``: up from the last plane."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, self.n)[0] + k
        for j, p in enumerate(reversed(self.planes)):
            bit = value >> j & 1
            at = p.select(bit, at - p.zeros if bit else at)
        return at

    def locate(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def dump(identifiers: list, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    press = zstandard.ZstdCompressor(level=1).compress
    null = np.array([x is None for x in identifiers], np.uint8)
    numbers = np.array([0 if x is None else x for x in identifiers], "<i8")
    n = -(-matrix.n // (8 * CHUNK))
    chunks_ = [press(p.chunk(c).tobytes()) for p in matrix.planes for c in range(n)]
    directory = np.concatenate([p.ones_before for p in matrix.planes]).astype("<u4")
    parts = [numbers.tobytes(), null.tobytes(), lengths.astype("<u8").tobytes(), directory.tobytes(), np.array([len(x) for x in chunks_], "<u8").tobytes()]
    out = [MAGIC, struct.pack("<3Q", matrix.n, len(identifiers), len(matrix.planes))]
    for x in map(press, parts):
        out += [struct.pack("<Q", len(x)), x]
    return b"".join(out + chunks_)


def load(read_at) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Of a file read by ``read_at(size, place)``; chunks are read when they are asked for."""
    if bytes(read_at(4, 0)) != MAGIC:
        raise ValueError("not a wavelet matrix file")
    n, documents, planes = struct.unpack("<3Q", read_at(24, 4))
    at, parts = 28, []
    expand = lambda x: zstandard.ZstdDecompressor().decompress(x)
    for _ in range(5):
        (size,) = struct.unpack("<Q", read_at(8, at))
        parts.append(expand(read_at(size, at + 8)))
        at += 8 + size
    identifiers = np.frombuffer(parts[0], "<i8").tolist()
    identifiers = [None if z else x for x, z in zip(identifiers, parts[1])]
    lengths = np.frombuffer(parts[2], "<u8").astype(np.int64)
    if len(identifiers) != documents or lengths.sum() != n:
        raise ValueError("a damaged wavelet matrix file")
    directory = np.frombuffer(parts[3], "<u4").reshape(planes, -1)
    sizes = np.frombuffer(parts[4], "<u8").astype(np.int64)
    starts = (at + np.cumsum(sizes) - sizes).reshape(planes, -1)
    sizes = sizes.reshape(planes, -1)

    def chunk(k: int):
        return lambda c: np.frombuffer(expand(read_at(int(sizes[k, c]), int(starts[k, c]))), np.uint8)

    return identifiers, lengths, WaveletMatrix(n, [Plane(n, chunk(k), directory[k]) for k in range(planes)])


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the ids of all documents; a row per file: ``shard, part, path, documents, ids, base``.

    Shards are ranges of the identifier (nulls first) found by quantiles over
    all rows; files in order of (shard, part) hold the documents in ascending
    order of identifier, equal identifiers in order of their ids. ``base`` is
    the number of ids in earlier files. Null texts count as empty and are the
    end id alone. An empty table writes no file. Files close at ``FILE_IDS``
    ids, so a task holds one file's ids and one document.
    """
    spark = docs.sparkSession
    shards = shards or shuffle_partitions(spark)
    folder = folder or shared_dir(spark)
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    cuts = [i / shards for i in range(1, shards)]
    bounds = (plain.agg(F.percentile_approx("doc_id", cuts, 10_000).alias("q")).first()["q"] or []) if cuts else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bounds, np.int64)
        for batch in batches:
            for a, b, raw, offs in chunks(batch["text"]):
                ids, ends = encoder(tokenizer).encode(raw, offs)
                own = batch["doc_id"].slice(a, b - a)
                shard = np.searchsorted(edges, own.fill_null(0).to_numpy(zero_copy_only=False), "left")
                shard[own.is_null().to_numpy(zero_copy_only=False)] = 0
                small = np.ascontiguousarray(ids.astype("<u4" if ids.max(initial=0) > 65535 else "<u2"))
                width = small.itemsize
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays([own, pa.array(shard, pa.int32()), pa.array(np.full(b - a, width, np.int32)), packed], names=["doc_id", "shard", "width", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, size, shard, part = [], [], 0, None, 0

        def close():
            nonlocal held, size, part
            identifiers, ids = [x for x, _ in held], [y for _, y in held]
            path, stream = create(folder, ".wmx")
            with stream:
                stream.write(dump(identifiers, np.array([len(y) for y in ids]), WaveletMatrix.of(np.concatenate(ids))))
            rows.append((shard, part, path, len(held), size))
            held, size, part = [], 0, part + 1

        for batch in batches:
            for x, s, width, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "shard", "width", "ids"))):
                if held and (s != shard or size >= FILE_IDS):
                    close()
                if s != shard:
                    shard, part = s, 0
                held.append((x, np.frombuffer(ids, f"<u{width}")))
                size += len(held[-1][1])
        if held:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "part", "path", "documents", "ids"), r)) for r in rows], schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    files = staged(
        plain.mapInArrow(encode, "doc_id bigint, shard int, width int, ids binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", "ids")
        .mapInArrow(write, "shard int, part int, path string, documents bigint, ids bigint")
    )
    # A row for each file: the running sum needs them in one place.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame) -> DataFrame:
    """A row per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                with open_file(path) as file:
                    identifiers, lengths, matrix = load(file.read_at)
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    first = 0
                    while first < len(lengths):  # runs of whole documents
                        last = max(first + 1, int(np.searchsorted(ends, starts[first] + RUN, "right")))
                        ids = matrix.tokens(int(starts[first]), int(ends[last - 1])).astype("<u4")
                        a, b = starts[first:last], ends[first:last]
                        crc = [zlib.crc32(ids[x:y]) for x, y in zip((a - a[0]).tolist(), (b - a[0]).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(identifiers[first:last], pa.int64()), pa.array(a + base), pa.array(lengths[first:last]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    return files.select("path", "base").repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
