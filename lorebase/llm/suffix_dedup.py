"""Repeated substrings by bucket-pointer refinement of sampled suffixes.

A byte is removed if a string of ``width`` bytes that covers it also starts
elsewhere, in any document. Suffixes are put into buckets by their first bytes;
buckets are refined by the identifiers of the buckets at later offsets, and the
refined identifiers are used again in the next round. Only members whose bucket
has others go on.

* Suffixes are sampled. Of the ``width - Q + 1`` positions whose q-grams lie in a
  string of ``width`` bytes, the one with the least bucket is its anchor. Equal
  strings have their anchors at equal places, so only suffixes at anchors need a
  common bucket: about one in 85. A string is told by its anchor and its
  distance, the bytes from its start to the anchor.
* Initial buckets: the q-gram at the anchor. An anchor stands for a range of
  distances, all strings that it is the anchor of.
* A round. The strings of a member's range have some bytes in common (at first
  just the q-gram). Members alone in their bucket are done: their strings occur
  once. Members that agree on all bytes of their range are done, too: all their
  strings are repeated; one of them goes on for the others. The ranges of what
  is left are cut into cells of fewer distances (``CELLS``), so their strings have
  more bytes in common, and each cell's bucket is refined: its new identifier is
  made of the old one and the identifiers of the 128-byte buckets at the offsets
  that tile the common bytes.
* With cells of one distance the common bytes are the string, and all is told.

An edge of a copied passage costs a cell or two a round, so the rows of all
rounds grow with the number of edges, however many members a bucket has. No
bucket meets in one task: members are counted in their buckets, combined before
the shuffle, and joined to the counts, where skewed buckets are split.

Identifiers are 64-bit hashes, so every task finds the same ones by itself
(bytes double in depth: a position's bucket of 2q bytes is named by its own
bucket of q bytes and that at the offset q further on). Members agree only where
bucket and string name both do: 128 bits. Texts travel twice, compressed row by
row, and nothing else that is as large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import discard, staged, text_or_empty
from lorebase.llm.kernel import CHUNK, CODES, U, chunks, flat, mix64

Q = 32
_TURN = U(0xA0761D6478BD642F)


def names(data: np.ndarray, depth: int) -> list[np.ndarray]:
    """Bucket names of the 1, 2, 4 .. ``depth`` bytes from each position on."""
    out = [CODES[data]]
    step = 1
    while step < depth:
        x = out[-1]
        y = (x[:-step] ^ (x[:-step] >> U(29))) * _TURN + x[step:] if len(x) > step else x[:0]
        out.append(y)
        step *= 2
    return out


def tiled(levels: list[np.ndarray], starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """A name of ``length`` bytes from each start, from the deepest buckets that tile them."""
    x, size = levels[-1], 1 << (len(levels) - 1)
    length = np.broadcast_to(length, starts.shape)
    name = mix64(length.astype(U) + U(1))
    at = 0
    while len(starts) and at < int(length.max()):
        place = starts + np.minimum(at, length - size)  # the last tile ends where the stretch ends
        name = np.where(at < length, mix64((name + x[place]) * _TURN), name)
        at += size
    return name


def anchors(level: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last) of runs of string starts with the same anchor."""
    n = len(level) - window + 1
    key = (mix64(level) & ~U((1 << 24) - 1)) | np.arange(len(level), dtype=U)
    span, least = 1, key
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[window - span : window - span + n])
    at = (least & U((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], first, np.append(first[1:], n) - 1


#: Distances of a cell in each round after the first.
CELLS = (25, 5, 1)
#: A member's range in one number: distances of its first and of its last string.
SPAN = 20
#: Texts are worked on in pieces of so many bytes, overlapping by width - 1.
PIECE = 1 << 20


def pieces(data: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    at = 0
    while len(data) - at >= width:
        yield at, data[at : at + PIECE + width - 1]
        at += PIECE


def stretches(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(bucket, name of all bytes, anchor, range) of the anchors of one text of at least
    ``width`` bytes. Strings of a piece start in it, so pieces share none."""
    found = []
    for base, part in pieces(data, width):
        levels = names(part, 128)
        gram = levels[Q.bit_length() - 1]
        at, first, last = anchors(gram, width - Q + 1)
        name = tiled(levels, first, last - first + width) ^ mix64((at - first).astype(U))
        found.append((mix64(gram[at]), name, at + base, (at - first) << SPAN | (at - last)))
    return tuple(np.concatenate(x) for x in zip(*found))


def refined(parts: list[bytes], origin: np.ndarray, at: np.ndarray, owner: np.ndarray, bucket: np.ndarray, span: np.ndarray, width: int, cell: int) -> tuple[np.ndarray, ...]:
    """(member, bucket, name, range) of the cells of members.

    ``parts`` are the bytes of texts from ``origin`` on and ``at`` their anchors;
    ``owner`` gives each member's part, ``bucket`` its bucket and ``span`` its range."""
    levels = names(np.frombuffer(b"".join(parts), np.uint8), 128)
    begins = np.cumsum([0, *map(len, parts)])[:-1] + at - origin  # places of the anchors
    far, near = span >> SPAN, span & ((1 << SPAN) - 1)
    low = near // cell
    n = far // cell - low + 1
    own = np.repeat(np.arange(len(owner)), n)
    c = low[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    place = begins[owner[own]]
    common = tiled(levels, place - c * cell, width - cell + 1)
    far, near = np.minimum(far[own], c * cell + cell - 1), np.maximum(near[own], c * cell)
    name = tiled(levels, place - far, far - near + width) ^ mix64(far.astype(U))
    return own, mix64(mix64(bucket[own]) + common * _TURN + c.astype(U)), name, far << SPAN | near


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and, unless ``with_text`` is false, ``spans`` (byte ranges that
    go) and ``kept`` (the remaining bytes).

    Matches are judged on the input, so both copies of a passage go; strings
    never cross documents; strings that overlap each other count. Null text
    counts as empty. Texts shorter than ``width`` lose nothing. Rows are told
    apart by identifier and text, so repeated rows remove each other's text, and
    null identifiers are rows like any other. An empty table gives an empty
    result; other columns are not read. ``width`` is at least 160.
    """
    if width < Q + 128:
        raise ValueError("width has to be at least 160")
    # Rows are told apart by a key of identifier and text; equal rows share it.
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    plain = plain.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("key", F.xxhash64("id", "text"))
    own_key = ["id", "key"]

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["bucket", "name", "id", "key", "at", "span"]
        for batch in batches:
            for a, b, raw, offs in chunks(batch["text"], CHUNK):
                identifiers, keys, rows = batch["id"].slice(a, b - a).to_numpy(), batch["key"].slice(a, b - a).to_numpy(), []
                for i in range(b - a):
                    if offs[i + 1] - offs[i] >= width:
                        bucket, name, at, span = stretches(raw[offs[i] : offs[i + 1]], width)
                        rows.append((bucket, name, np.full(len(bucket), identifiers[i]), np.full(len(bucket), keys[i]), at, span))
                if rows:
                    bucket, name, *rest = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([_signed(bucket), _signed(name), *map(pa.array, rest)], names=columns)

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw, offs = flat(batch["text"])
            small = [squeeze(raw[x:y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["id"], batch["key"], pa.array(small, pa.binary())], names=["doc_id", "id", "key", "text"])

    pressed = plain.mapInArrow(press, "doc_id bigint, id bigint, key bigint, text binary")

    def refine(found: DataFrame, member: list[str]) -> tuple[DataFrame, DataFrame]:
        """(members whose strings are all repeated, members that go on) of one round's buckets.

        Counts are combined before they are dealt out."""
        buckets = staged(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("bucket"))
        hits = staged(found.join(buckets, "bucket"))
        same = hits.groupBy("bucket", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*member)).alias("x"))
        sizes = same.groupBy("bucket").agg(F.count(F.lit(1)).alias("names"))
        told = staged(same.join(sizes, "bucket").where("n > 1 OR names > 1"))
        discard(buckets)
        return hits.join(told.where("n > 1").select("bucket", "name"), ["bucket", "name"]).select(*member), told.where("names > 1").select("bucket", "x.*")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of each member's strings."""
        kinds = {"id": pa.int64(), "key": pa.int64(), "at": pa.int64(), "origin": pa.int64(), "bucket": pa.int64(), "span": pa.int64(), "part": pa.binary()}
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[tuple] = []
            for identifier, own, text, members in zip(batch["id"].to_pylist(), batch["key"].to_pylist(), batch["text"], batch["members"]):
                data, members = expand(text.as_py()), members.values
                for bucket, at, span in zip(*(members.field(c).to_pylist() for c in ("bucket", "at", "span"))):
                    origin = at - (span >> SPAN)
                    rows.append((identifier, own, at, origin, bucket, span, data[origin : at - (span & ((1 << SPAN) - 1)) + width]))
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def cells(cell: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = batch["part"].to_pylist()
                sizes = np.cumsum([len(x) for x in parts])
                item, origin, at = (batch[c].to_numpy() for c in ("item", "origin", "at"))
                a = 0
                while a < len(parts):
                    b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, "right")))
                    lists = batch["members"].slice(a, b - a)
                    owner = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                    own = lists.flatten()
                    of, bucket, name, span = refined(parts[a:b], origin[a:b], at[a:b], owner, own.field("bucket").to_numpy().view(U), own.field("span").to_numpy(), width, cell)
                    yield pa.RecordBatch.from_arrays([_signed(bucket), _signed(name), pa.array(item[a:b][owner[of]]), pa.array(span)], names=["bucket", "name", "item", "span"])
                    a = b

        return work

    # Initial buckets: the q-grams of the anchors.
    found = plain.mapInArrow(initial, "bucket bigint, name bigint, id bigint, key bigint, at bigint, span bigint")
    whole, left = refine(found, [*own_key, "at", "span"])
    per_text = left.groupBy(*own_key).agg(F.collect_list(F.struct("bucket", "at", "span")).alias("members"))
    parts = pressed.join(per_text, own_key).select(*own_key, "text", "members").mapInArrow(contexts, "id bigint, key bigint, at bigint, origin bigint, bucket bigint, span bigint, part binary")
    parts = staged(parts.withColumn("item", F.monotonically_increasing_id()))
    work = parts.select("item", "origin", "at", "part", F.array(F.struct("bucket", "span")).alias("members"))
    marks = whole
    for cell in CELLS:
        found = staged(work.select("item", "origin", "at", "part", "members").mapInArrow(cells(cell), "bucket bigint, name bigint, item bigint, span bigint"))
        repeated, left = refine(found, ["item", "span"])
        marks = marks.unionByName(repeated.join(parts.select("item", *own_key, "at"), "item").drop("item"))
        discard(found)
        work = parts.drop("bucket", "span").join(left.groupBy("item").agg(F.collect_list(F.struct("bucket", "span")).alias("members")), "item")
    far, near = F.shiftright("span", SPAN), F.col("span").bitwiseAND(F.lit((1 << SPAN) - 1))
    marks = marks.groupBy(*own_key).agg(F.collect_set(F.struct((F.col("at") - far).alias("a"), (F.col("at") - near).alias("b"))).alias("marks"))

    out_type = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", spans array<struct<a:bigint,b:bigint>>, kept binary" if with_text else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split()[0] for x in out_type.split(", ")][: 7 if with_text else 5]
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, marks, rows = batch["text"], batch["marks"], []
            valid = marks.is_valid().to_pylist()
            for i, identifier in enumerate(batch["doc_id"].to_pylist()):
                data = np.frombuffer(expand(texts[i].as_py()), np.uint8)
                a = b = np.zeros(0, np.int64)
                if valid[i]:
                    own = marks[i].values
                    a, b = own.field("a").to_numpy(), own.field("b").to_numpy() + width
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    new = np.concatenate(([True], a[1:] > b[:-1]))
                    a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
                keep = np.ones(len(data), bool)
                for x, y in zip(a.tolist(), b.tolist()):
                    keep[x:y] = False
                kept = (data[keep] if len(a) else data).tobytes()
                row = (identifier, len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
                rows.append(row + (([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist())], kept) if with_text else ()))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(columns), kinds)], names=columns)

    return pressed.join(marks, own_key, "left").select("doc_id", "text", "marks").mapInArrow(cut, out_type)
