"""Token ids of whole texts from a tokenizer file, with a cache of text units.

The library encodes each distinct unit once for each worker; the units' ids are
then put together by numpy. A unit is a part of a text that the tokenizer
never joins with its neighbours:

* Texts are cut at blanks, tabs and line ends, which the pre-tokenizer drops.
* Within such a word, runs of letters, digits and other ASCII signs are units,
  as the pre-tokenizer cuts there as well. This holds for words made of ASCII
  (without ``'``, which starts contractions, and ``<``, which starts special
  tokens) and of the letters from U+00C0 to U+024F, which normalisation keeps
  apart. Any other word is one unit.

These rules fit ``word_bpe_49k.json``; a test compares with whole texts. The
cache starts anew beyond ``MOST`` units, so it stays bounded.
"""

from __future__ import annotations

import numpy as np
import xxhash

from lorebase.llm.kernel import LOWER, prefix, spans_hash

MOST = 1_500_000
SLOTS = 1 << 21
END_ID = 1

_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[ord("'"), ord("<"), 0x7F, *(x for x in range(32) if x not in (9, 10, 13))]] = True
_ODD[[0xC0, 0xC1, 0xC2, *range(0xCA, 0x100)]] = True


class Encoder:
    """``most``: so many units are kept; a table has twice as many slots or more."""

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.most, self.slots = most, min(SLOTS, 2 << (most - 1).bit_length())

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.of: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.keys = np.zeros((2, self.slots), np.uint64)
        self.values = np.full((2, self.slots), -1, np.int32)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, the end id after each, and their offsets."""
        n = len(offs) - 1
        if len(data) == 0:
            return np.full(n, END_ID, np.int32), np.arange(n + 1)
        starts, ends, odd = self._units(data, offs)
        lowered = LOWER[data]
        keys = spans_hash(prefix(lowered), starts, ends)
        for i in np.flatnonzero(odd).tolist():
            keys[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
        units = self._find(keys, lowered, data, starts, ends, odd)
        # each text's end id comes as a unit of its own
        first = np.searchsorted(starts, offs)
        sizes = np.insert(self.size[units], first[1:], 1)
        places = np.insert(self.at[units], first[1:], -1)
        stops = np.cumsum(sizes)
        ids = self.pool[np.repeat(places - stops + sizes, sizes) + np.arange(stops[-1])] if len(stops) else np.zeros(0, np.int32)
        ends_at = first[1:] + np.arange(n)
        ids[stops[ends_at] - 1] = END_ID
        return ids, np.concatenate(([0], stops[ends_at]))

    @staticmethod
    def _units(data, offs):
        kind = _KIND[data]
        odd = _ODD[data]
        pair = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        odd[:-1] |= pair
        ends_text = np.zeros(len(data) + 1, bool)
        ends_text[offs] = True
        edge = np.ones(len(data) + 1, bool)  # between bytes i - 1 and i
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge |= ends_text
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        kinds = kind[starts]
        inner = kinds != 0
        if odd.any():
            # join the units of odd words
            opens = inner & (np.concatenate(([True], kinds[:-1] == 0)) | ends_text[starts])
            word = np.cumsum(opens) - 1
            bad = np.zeros(max(int(word[-1]) + 1, 1), bool)
            bad[word[np.searchsorted(ends, np.flatnonzero(odd), "right")]] = True
            is_odd = inner & bad[np.maximum(word, 0)]
            keep = inner & (~is_odd | opens)
            # a kept odd unit reaches to its word's last unit
            groups = np.flatnonzero(keep)
            last = np.maximum.reduceat(np.where(inner, ends, 0), groups) if len(groups) else groups
            return starts[groups], last, is_odd[groups]
        return starts[inner], ends[inner], np.zeros(int(inner.sum()), bool)

    def _find(self, keys, lowered, data, starts, ends, odd) -> np.ndarray:
        """The number of each unit in the cache, after adding those that are new."""
        if len(self.of) > self.most:
            self.clear()
        units = np.full(len(keys), -1, np.int32)
        rest = np.arange(len(keys))
        for way in (0, 1):
            slot = ((keys[rest] >> np.uint64(20 * way)) & np.uint64(self.slots - 1)).astype(np.int64)
            value = self.values[way][slot]
            hit = (self.keys[way][slot] == keys[rest]) & (value >= 0)
            units[rest[hit]] = value[hit]
            rest = rest[~hit]
        if len(rest):
            distinct, example, where = np.unique(keys[rest], return_index=True, return_inverse=True)
            value = np.array([self.of.get(k, -1) for k in distinct.tolist()], np.int32)
            new = value < 0
            new_odd = odd[rest[example]]
            for pick, encode, raw in ((new & ~new_odd, self._encode_plain, lowered), (new & new_odd, self._encode_odd, data)):
                if pick.any():
                    some = rest[example[pick]]
                    value[pick] = self._keep(distinct[pick], *encode(raw, starts[some], ends[some]))
            units[rest] = value[where]
            for way in (1, 0):
                slot = ((distinct >> np.uint64(20 * way)) & np.uint64(self.slots - 1)).astype(np.int64)
                free = self.values[way][slot] < 0 if way == 0 else np.ones(len(slot), bool)
                self.keys[way][slot[free]] = distinct[free]
                self.values[way][slot[free]] = value[free]
        return units

    def _encode_plain(self, data, starts, ends):
        """Ids and sizes of plain units: joined by blanks, the library sees them as
        one text, and their words' closing tokens tell them apart again."""
        sizes = ends - starts
        stops = np.cumsum(sizes + 1)
        joined = data[np.minimum(np.repeat(starts - stops + sizes + 1, sizes + 1) + np.arange(stops[-1]), len(data) - 1)]
        joined[stops - 1] = 0x20
        ids = np.array(self._ids(joined.tobytes().decode()), np.int32)
        words = np.cumsum(np.where(_KIND[data[starts]] == 2, sizes, 1))
        closed = np.flatnonzero(self.closes[ids]) + 1
        if len(closed) != words[-1] or closed[-1] != len(ids):
            raise ValueError("this tokenizer doesn't close its words as word_bpe_49k.json does")
        return ids, np.diff(closed[words - 1], prepend=0)

    def _encode_odd(self, data, starts, ends):
        found = [np.array(self._ids(data[a:b].tobytes().decode()), np.int32) for a, b in zip(starts.tolist(), ends.tolist())]
        return np.concatenate(found), np.array([len(x) for x in found])

    def _keep(self, keys, ids, sizes) -> np.ndarray:
        base, most = len(self.of), len(self.of) + len(keys)
        while most > len(self.at):
            self.at, self.size = np.concatenate((self.at, self.at)), np.concatenate((self.size, self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[base:most], self.size[base:most] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.of.update(zip(keys.tolist(), range(base, most)))
        return np.arange(base, most, dtype=np.int32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = MOST) -> Encoder:
    """The worker's encoder for that file; it lives as long as the worker."""
    if (path, most) not in _encoders:
        _encoders.clear()
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
