"""Which of many strings a text holds, found in one pass over it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Automata of this worker, by the strings that they find. A few stay.
_built: dict[tuple, tuple] = {}


def _automaton(strings: tuple[str, ...]):
    """(automaton, places that each of its values stands for, places of empty strings)."""
    if strings not in _built:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for i, s in enumerate(strings):
            places.setdefault(s, []).append(i)
        always = places.pop("", [])
        found = ahocorasick.Automaton()
        for n, s in enumerate(places):
            found.add_word(s, n)
        if places:
            found.make_automaton()
        if len(_built) >= 8:
            _built.clear()
        _built[strings] = found if places else None, list(places.values()), always
    return _built[strings]


#: Texts that become Python's own at a time: a batch may be 64 MB, which are several times as much as strings.
TEXTS = 256


def in_slices(column: pa.Array, work: Callable[[list], pa.Array]) -> pa.Array:
    """``work`` of the values, ``TEXTS`` at a time. A worker lives on after its batches, so it hands back what they freed."""
    done = pa.concat_arrays([work(column.slice(i, TEXTS).to_pylist()) for i in range(0, len(column), TEXTS) or (0,)])
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    return done


def places_held(texts: Sequence[str], strings: tuple[str, ...]) -> list[list[int]]:
    """For each text the places of the strings it holds, ascending."""
    automaton, places, always = _automaton(strings)
    single = all(len(p) == 1 for p in places)
    out = []
    for t in texts:
        values = {v for _, v in automaton.iter(t)} if automaton is not None and t else ()
        own = [places[v][0] for v in values] if single else [i for v in values for i in places[v]]
        out.append(sorted([*own, *always]))
    return out


def held(text: Column, strings: Sequence[str], rows: pa.StructArray, schema: str) -> Column:
    """An array of the ``rows`` (of type ``schema``) whose strings are substrings of the
    text, in their order. Null text holds the empty string only.

    The strings become one automaton, built once a worker, so the work is that of
    reading the text, however many strings there are."""
    strings = tuple(strings)

    @F.arrow_udf(f"array<{schema}>")
    def find(texts: pa.Array) -> pa.Array:
        def some(own: list) -> pa.Array:
            places = places_held(["" if t is None else t for t in own], strings)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in places]))).astype(np.int32)
            flat = np.array([i for x in places for i in x], np.int64)
            return pa.ListArray.from_arrays(pa.array(offsets), rows.take(pa.array(flat)))

        return in_slices(texts, some)

    return find(text)
