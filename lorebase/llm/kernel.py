"""Vectorised work on the bytes of a batch of texts.

A batch's texts lie one after the other in one byte array, as Arrow holds them;
the functions here work on the whole array at once. Hashes are 64 bits wide:
prefix sums of a polynomial over a table of byte codes, modulo 2**64, finished
by a mixing step. Work goes in chunks of about ``CHUNK`` bytes of whole texts,
so memory is bounded by the chunk or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Codes of the 256 bytes, by rule.
with np.errstate(over="ignore"):
    CODES = mix64(np.arange(1, 257, dtype=U) * U(_STEP))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        steps = np.full(size, base, U)
        steps[0] = 1
        have = np.cumprod(steps)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial; one longer than ``data``."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(CODES[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whatever its place."""
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix64(h + (ends - starts).astype(U) * U(_STEP))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    raw, offs = flat(texts)
    at, n = 0, len(offs) - 1
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's first word (one more at the end)."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~SPACE[data]
    starts_at = inner[1:-1] & ~inner[:-2]
    ends_at = inner[1:-1] & ~inner[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = inner[cuts] & inner[cuts + 1]  # a word on each side of a text's end
    starts_at[cuts[both]] = True
    ends_at[cuts[both] - 1] = True
    starts = np.flatnonzero(starts_at)
    return starts, np.flatnonzero(ends_at) + 1, np.searchsorted(starts, offs)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width``
    lower-cased (A-Z) words; a shorter text's whole sequence is its only one,
    and a text without words has none."""
    starts, ends, first = word_spans(data, offs)
    h = spans_hash(prefix(LOWER[data]), starts, ends)
    n = len(h)
    rolled = np.zeros(max(n - width + 1, 0), U)
    factor = 1
    for i in range(width):
        factor = factor * _BASE % (1 << 64)
        rolled += h[i : i + len(rolled)] * U(factor)
    rolled = mix64(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        elif b > a:
            factors = powers(_BASE, width + 1)[1 : b - a + 1]
            yield mix64(np.array([(h[a:b] * factors).sum(dtype=U) + U(b - a)], U) * U(_STEP))
        else:
            yield np.zeros(0, U)
