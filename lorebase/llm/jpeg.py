"""Media columns: baseline JPEG, read for its DC luminance thumbnail.

``thumbnails`` parses the markers of a baseline JPEG, decodes its Huffman-coded
scan and rebuilds the luminance DC coefficients: one sample for every block of
8 x 8 pixels. Two decoders share the parser. ``_scalar`` takes any baseline
scan (several components, sampling factors, AC coefficients, with or without
restarts). ``_lanes`` decodes all restart intervals of many grey DC-only scans
at once, one numpy step for each block of an interval, and hands over to the
other where it meets anything else.

``dc_image`` stores bytes without loss: each byte is the DC coefficient of one
block (all quantisers 1, so the coefficient is eight times the mean grey level
less 128, divided by eight). Rows of 64 blocks are restart intervals. Images
have at most ``MOST_ROWS`` rows of blocks; longer payloads give several images,
one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import text_or_empty
from lorebase.llm.kernel import CHUNK, chunks

WIDTH = 64
MOST_ROWS = 8191
#: Code lengths of the DC categories 0 to 8 (a difference of two bytes needs no more).
DC_LENGTHS = [4] * 3 + [3] * 4 + [4, 5]


def _canonical(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, as the standard gives codes from counts by length."""
    codes, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return codes


def _table(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(x == n for x in lengths.values()) for n in range(1, 17)]
    return counts, symbols, {s: (n, c) for (n, c), s in _canonical(counts, symbols).items()}


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = _table(dict(enumerate(DC_LENGTHS)))
_EOB_COUNTS, _EOB_SYMBOLS = [1] + [0] * 15, [0]  # end of block is the single bit 0


def _writer() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255 the bits of its whole block, and how many."""
    bits, sizes = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        n, code = _DC_CODES[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255] = ((code << category) | extra) << 1
        sizes[d + 255] = n + category + 1
    return bits, sizes


_BITS, _SIZES = _writer()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDTH * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(_EOB_COUNTS) + bytes(_EOB_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0x00, 0, 63, 0)),
    ))


def entropy_rows(samples: np.ndarray) -> list[bytes]:
    """The stuffed entropy-coded bytes of each row (``samples``: n x 64 bytes)."""
    n = len(samples)
    level = samples.astype(np.int16) - 128
    d = np.diff(level, axis=1, prepend=np.zeros((n, 1), np.int16)) + 255
    bits, sizes = _BITS[d], _SIZES[d]
    while bits.shape[1] > 16:  # join neighbours: 4 blocks have at most 4 * 14 bits
        bits = bits[:, ::2] << sizes[:, 1::2].astype(np.uint64) | bits[:, 1::2]
        sizes = sizes[:, ::2] + sizes[:, 1::2]
    total = sizes.sum(1)
    words = np.zeros((n, 16), np.uint64)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    for j in range(16):
        size, value = sizes[:, j], bits[:, j]
        word, room = at >> 6, 64 - (at & 63)
        over = size - room  # bits beyond this word
        inside = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
        words[rows, word] |= inside
        spill = over > 0
        words[rows[spill], word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
        at += size
    fill = -total % 8  # the last byte is filled with ones
    word, room = at >> 6, 64 - (at & 63)
    some = fill > 0
    words[rows[some], word[some]] |= ((np.uint64(1) << fill[some].astype(np.uint64)) - np.uint64(1)) << (room[some] - fill[some]).astype(np.uint64)
    raw = words.astype(">u8").view(np.uint8).reshape(n, 128)
    lengths = (total + 7) >> 3
    flat = raw[np.arange(128) < lengths[:, None]]
    full = flat == 0xFF
    ends = np.cumsum(lengths)
    stuffed_ends = ends + np.concatenate(([0], np.cumsum(full)))[ends]
    out = np.zeros(int(stuffed_ends[-1]) if n else 0, np.uint8)
    out[np.arange(len(flat)) + np.cumsum(full) - full] = flat
    data, edges = out.tobytes(), [0, *stuffed_ends.tolist()]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


_RST = [bytes((0xFF, 0xD0 + i)) for i in range(8)]


def _images(rows: list[bytes]) -> bytes:
    out = []
    for a in range(0, len(rows), MOST_ROWS):
        own = rows[a : a + MOST_ROWS]
        out.append(_head(len(own)))
        for i, x in enumerate(own[:-1]):
            out += (x, _RST[i & 7])
        out += (own[-1], b"\xff\xd9")
    return b"".join(out)


def dc_image(payload: bytes) -> bytes:
    """The payload (a positive multiple of 64 bytes) as one or more grey JPEGs."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload has to be a positive multiple of 64 bytes")
    return _images(entropy_rows(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))


class Frame:
    """What the markers of one image say, and where its scan's bytes lie."""

    def __init__(self) -> None:
        self.quant: dict[int, list[int]] = {}
        self.huffman: dict[int, dict] = {}
        self.restart = 0
        self.height = self.width = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.scan: list[tuple[int, int, int]] = []  # component's index, DC table, AC table
        self.data = (0, 0)


def parse(raw: bytes, at: int = 0) -> tuple[Frame, int]:
    """The image that starts at ``at``, and where it ends."""
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), at + 2
    while True:
        if raw[at] != 0xFF:
            raise ValueError("no marker where one is due")
        while raw[at + 1] == 0xFF:
            at += 1
        marker = raw[at + 1]
        if marker == 0xD9:
            raise ValueError("an image without a scan")
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 1 + 64 * (1 + wide)
                f.quant[body[0] & 15] = list(struct.unpack(">64H" if wide else ">64B", body[1:n]))
                body = body[n:]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                f.huffman[body[0]] = _canonical(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            depth, f.height, f.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only samples of 8 bits are baseline")
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            f.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            index = {c[0]: i for i, c in enumerate(f.components)}
            f.scan = [(index[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:  # the scan ends at a marker that is no restart and no stuffed byte
                end = raw.index(b"\xff", end)
                if raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7:
                    end += 2
                else:
                    break
            f.data = (at, end)
            close = raw.find(b"\xff\xd9", end)
            if close < 0:
                raise ValueError("no end of image")
            return f, close + 2


def _lut(codes: dict[tuple[int, int], int]) -> np.ndarray:
    """For each 16 bits: symbol * 32 + length of the code they start with, or -1."""
    out = np.full(1 << 16, -1, np.int32)
    for (n, code), symbol in codes.items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = symbol * 32 + n
    return out


_block_luts: dict[tuple, np.ndarray] = {}


def _block_lut(dc: dict, ac: dict) -> np.ndarray:
    """For each 16 bits: (difference + 32768) * 32 + length of a whole block made of
    a DC code, its bits and an end of block; -1 where that is not what they hold."""
    key = (tuple(sorted(dc.items())), tuple(sorted(ac.items())))
    if key not in _block_luts:
        first = _lut(dc).astype(np.int64)
        i = np.arange(1 << 16)
        n, category = first & 31, first >> 5
        ok = (first >= 0) & (n + category <= 16)
        n, category = np.where(ok, n, 0), np.where(ok, category, 0)
        extra = (i >> (16 - n - category)) & ((1 << category) - 1)
        d = np.where((category > 0) & (extra < (1 << np.maximum(category - 1, 0))), extra - (1 << category) + 1, extra)
        used, good = n + category, np.zeros(1 << 16, bool)
        total = np.zeros(1 << 16, np.int64)
        for (m, code), symbol in ac.items():
            if symbol == 0:
                fits = ok & (used + m <= 16)
                match = fits & (((i >> np.maximum(16 - used - m, 0)) & ((1 << m) - 1)) == code)
                good |= match
                total[match] = used[match] + m
        _block_luts.clear()
        _block_luts[key] = np.where(good, (d + 32768) * 32 + total, -1).astype(np.int32)
    return _block_luts[key]


def _key(f: Frame) -> tuple | None:
    """What images decoded together have to share; None if ``_lanes`` can't take them."""
    if len(f.components) != 1 or not f.restart or -(-f.width // 8) * -(-f.height // 8) % f.restart:
        return None
    _, dc, ac = f.scan[0]
    if dc not in f.huffman or 16 + ac not in f.huffman:
        return None
    return f.restart, tuple(f.huffman[dc].items()), tuple(f.huffman[16 + ac].items())


def _lanes(frames: list[tuple[Frame, np.ndarray]]) -> list[np.ndarray] | None:
    """DC coefficients of grey scans with equal tables whose blocks end after DC and
    fill whole restart intervals: one lane for each interval of all images. None
    if anything else comes up."""
    first = frames[0][0]
    _, dc, ac = first.scan[0]
    lut = _block_lut(first.huffman[dc], first.huffman[16 + ac])
    gap = np.zeros(4, np.uint8)
    data = np.concatenate([x for f, raw in frames for x in (raw[f.data[0] : f.data[1]], gap)])
    sizes = np.array([f.data[1] - f.data[0] + 4 for f, _ in frames])
    begins = np.cumsum(sizes) - sizes
    mark = np.flatnonzero(data[:-1] == 0xFF)
    restart = mark[(data[mark + 1] & 0xF8) == 0xD0]
    stuffed = mark[data[mark + 1] == 0]
    lanes = np.array([-(-f.width // 8) * -(-f.height // 8) // f.restart for f, _ in frames])
    if (np.diff(np.searchsorted(restart, np.append(begins, len(data)))) != lanes - 1).any():
        return None
    drop = np.sort(np.concatenate((restart, restart + 1, stuffed + 1)))
    keep = np.ones(len(data), bool)
    keep[drop] = False
    clean = data[keep]
    starts = np.sort(np.concatenate((begins, restart + 2)))
    starts = starts - np.searchsorted(drop, starts)  # places after the dropped bytes
    ends = np.append(starts[1:], len(clean)) * 8
    window = clean[:-2].astype(np.int32) << 16 | clean[1:-1].astype(np.int32) << 8 | clean[2:]
    at = starts * 8
    out = np.empty((first.restart, len(at)), np.int32)
    least = np.zeros(len(at), np.int32)
    for k in range(first.restart):
        got = lut[window[np.minimum(at >> 3, len(window) - 1)] >> (8 - (at & 7)) & 0xFFFF]
        np.minimum(least, got, out=least)
        np.subtract(got >> 5, 32768, out=out[k])
        at += got & 31
    if (least < 0).any() or (at > ends).any():
        return None
    flat = np.cumsum(out, axis=0).T
    edges = np.append(0, np.cumsum(lanes))
    return [flat[a:b].reshape(-(-f.height // 8), -(-f.width // 8)) for (f, _), a, b in zip(frames, edges, edges[1:])]


def _scalar(f: Frame, raw: bytes) -> np.ndarray:
    """DC coefficients of the first component, block by block."""
    data, position, held, count = raw[f.data[0] : f.data[1]], 0, 0, 0
    luts = {k: _lut(v) for k, v in f.huffman.items()}

    def need(n: int) -> None:
        nonlocal position, held, count
        while count < n:
            byte = 0
            if position < len(data) and not (data[position] == 0xFF and data[position + 1 : position + 2] != b"\x00"):
                byte = data[position]
                position += 2 if byte == 0xFF else 1
            held, count = (held << 8 | byte) & 0xFFFFFFFF, count + 8

    def bits(n: int) -> int:
        nonlocal count
        need(n)
        count -= n
        return held >> count & ((1 << n) - 1)

    def symbol(lut: np.ndarray) -> int:
        nonlocal count
        need(16)
        got = int(lut[held >> (count - 16) & 0xFFFF])
        if got < 0:
            raise ValueError("a code that the table doesn't have")
        count -= got & 31
        return got >> 5

    most_h, most_v = max(c[1] for c in f.components), max(c[2] for c in f.components)
    alone = len(f.scan) == 1
    _, h0, v0, _ = f.components[0]
    if f.scan[0][0] != 0:
        raise ValueError("the first scan has to hold the luminance")
    across = lambda size, s, most: -(-(-(-size * s // most)) // 8)
    wide, high = across(f.width, h0, most_h), across(f.height, v0, most_v)
    if alone:
        columns, lines, plan = wide, high, [(0, 1, 1, *f.scan[0][1:])]
    else:
        columns, lines = -(-f.width // (8 * most_h)), -(-f.height // (8 * most_v))
        plan = [(i, f.components[i][1], f.components[i][2], d, a) for i, d, a in f.scan]
    out = np.zeros((lines * (1 if alone else v0), columns * (1 if alone else h0)), np.int32)
    before = dict.fromkeys(range(len(f.components)), 0)
    for n in range(columns * lines):
        if f.restart and n and n % f.restart == 0:
            count = held = 0
            while not (data[position] == 0xFF and 0xD0 <= data[position + 1] <= 0xD7):
                position += 1
            position += 2
            before = dict.fromkeys(before, 0)
        y, x = divmod(n, columns)
        for i, h, v, d, a in plan:
            for block in range(h * v):
                category = symbol(luts[d])
                extra = bits(category) if category else 0
                before[i] += extra - (1 << category) + 1 if category and extra < 1 << (category - 1) else extra
                k = 1
                while k < 64:
                    run = symbol(luts[16 + a])
                    if run == 0:
                        break
                    k += (run >> 4) + 1
                    if run & 15:
                        bits(run & 15)
                if i == 0:
                    out[y * v + block // h, x * h + block % h] = before[0]
    return out[:high, :wide]


def dc_levels(images: list[tuple[Frame, bytes]]) -> list[np.ndarray]:
    """DC coefficients of the luminance blocks of each image."""
    found: list = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for i, (f, _) in enumerate(images):
        if (key := _key(f)) is not None:
            alike.setdefault(key, []).append(i)
    for own in alike.values():
        for i, levels in zip(own, _lanes([(images[i][0], np.frombuffer(images[i][1], np.uint8)) for i in own]) or [None] * len(own)):
            found[i] = levels
    return [_scalar(f, raw) if x is None else x for x, (f, raw) in zip(found, images)]


def thumbnails(media: list[bytes]) -> list[list[tuple[np.ndarray, Frame]]]:
    """For each media value its images: (grey levels of the blocks as bytes, frame)."""
    images, owners = [], []
    for n, raw in enumerate(media):
        at = 0
        while at < len(raw):
            f, at = parse(raw, at)
            images.append((f, raw))
            owners.append(n)
    out: list = [[] for _ in media]
    for n, (f, _), dc in zip(owners, images, dc_levels(images)):
        # The mean of a block is an eighth of its dequantised DC. A plane of data
        # (see dc_image) counts in whole levels instead.
        quant = f.quant[f.components[0][3]]
        grey = dc if set(quant) == {1} and f.restart == WIDTH == f.width // 8 else np.round(dc * quant[0] / 8)
        out[n].append((np.clip(grey + 128, 0, 255).astype(np.uint8), f))
    return out


def average_hash(grey: np.ndarray) -> str:
    """16 hexadecimal digits: which of 8 x 8 areas are lighter than their mean."""
    y = np.arange(8) * grey.shape[0] // 8
    x = np.arange(8) * grey.shape[1] // 8
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), np.minimum(y, grey.shape[0] - 1), 0), np.minimum(x, grey.shape[1] - 1), 1)
    rows = np.maximum(np.diff(np.append(y, grey.shape[0])), 1)
    columns = np.maximum(np.diff(np.append(x, grey.shape[1])), 1)
    mean = sums / np.outer(rows, columns)
    return np.packbits(mean > mean.mean()).tobytes().hex()


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, images int, feature string"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """One row per row of ``docs``: the text as a JPEG and what is read back from it:
    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, width, height, images, feature`` and, unless ``with_media`` is
    false, ``media``.

    The text in UTF-8, with bytes 0 up to a positive multiple of 64, is the DC
    plane of the image; digests and checksums are of the decoded plane.
    ``feature`` is the size in blocks of the first image and the average hash of
    the first thumbnail (of the whole plane where there are several images).
    Null text counts as empty (64 zeros). Null identifiers stay null; repeated
    rows and equal texts give equal values; other columns are not read; an empty
    table gives an empty result.
    """
    schema = SCHEMA + (", media binary" if with_media else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identifiers = batch["doc_id"].to_pylist()
            for a, b, raw, offs in chunks(batch["text"], CHUNK):
                sizes = np.diff(offs)
                padded = np.maximum(-(-sizes // WIDTH), 1) * WIDTH
                ends = np.cumsum(padded)
                plane = np.zeros(int(ends[-1]), np.uint8)
                plane[np.arange(len(raw)) + np.repeat(ends - padded - offs[:-1], sizes)] = raw
                coded, out = entropy_rows(plane.reshape(-1, WIDTH)), []
                lines = (ends // WIDTH).tolist()
                stored = [_images(coded[x:y]) for x, y in zip([0, *lines], lines)]
                for identifier, n, media, grids in zip(identifiers[a:b], sizes.tolist(), stored, thumbnails(stored)):
                    grey = grids[0][0] if len(grids) == 1 else np.concatenate([g for g, _ in grids])
                    payload = grey.tobytes()
                    f = grids[0][1]
                    feature = f"{f.width // 8}x{sum(x.height for _, x in grids) // 8}:{average_hash(grey)}"
                    out.append((identifier, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f.width, f.height, len(grids), feature, *([media] if with_media else [])))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(work, schema)
