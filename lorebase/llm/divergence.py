"""Audit of how far the sources of a language differ in the terms they use.

Which terms are counted at all is decided by a count-min sketch:

1. Each task counts in how many documents a (language, term) occurs, in a
   sketch of ``ROWS`` rows of counters that stop at the number of documents
   asked for. Sketches are merged by adding, in two steps. A counter is never
   below the true number, so a term with a counter that stays below is none.
2. Each task reads its documents again and counts, by source, only terms whose
   counters all reach that number. These alone are shuffled. Their exact numbers
   of documents decide which terms are kept.
3. Pairs of sources meet in joins on terms that both have. Terms that one or
   both lack have that source's least probability, so sums over them are made
   from a table of how many terms a source has of each count. The sum over all
   terms is put together from these.

All numbers are whole: products that may pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import releasing, rows_per_batch, shuffle_partitions, staged, text_or_empty
from lorebase.llm.kernel import LOWER, U, chunks, mix64, prefix, spans_hash

#: Rows of the sketch, and the least and largest logarithm of a row's counters. The
#: largest bounds what a task holds (a byte a counter) and what is broadcast (a bit).
ROWS, NARROW, WIDE = 3, 18, 25
#: Bytes of text to a counter, up to that bound, and counters that travel together.
TEXT_PER_COUNTER, CELLS = 256, 1 << 16
#: (source, term) pairs that a task counts before it hands them on, and that it hands on at once.
HELD, ROWS_OUT = 1 << 17, 1 << 15
#: Texts handed to Python at a time.
TEXTS = 2000
#: Terms longer than this get their name from a library hash of their bytes.
LONG = 128

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def term_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms of texts laid end to end, and each term's text."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = _TERM[data]
    starts_at, ends_at = inner[1:-1] & ~inner[:-2], inner[1:-1] & ~inner[2:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = inner[cuts] & inner[cuts + 1]  # a term on each side of a text's end
    starts_at[cuts[both]] = True
    ends_at[cuts[both] - 1] = True
    starts = np.flatnonzero(starts_at)
    return starts, np.flatnonzero(ends_at) + 1, np.searchsorted(offs, starts, "right") - 1


def term_names(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """64-bit names of terms; ``salt`` is that of each term's language."""
    h = spans_hash(prefix(lowered), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(lowered[starts[i] : ends[i]].tobytes())
    return mix64(h ^ salt)


def by_document(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (name, text), the place of one of each, and how many there are."""
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    new = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (text[1:] != text[:-1]))))
    return names[new], text[new], order[new], np.diff(np.append(new, len(names)))


def places(names: np.ndarray, width: int):
    """For each row of the sketch the counters of the names."""
    for row in range(ROWS):
        yield row * width + (mix64(names + U(row * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & U(width - 1)).astype(np.int64)


def _salts(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], U)


def document_sketch(base: DataFrame, width: int, least: int) -> np.ndarray:
    """A bit for each counter: whether ``least`` documents or more may stand behind it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            salts = _salts(batch["lang"].to_pylist())
            for a, b, raw, offs in chunks(batch["text"]):
                starts, ends, text = term_spans(raw, offs)
                if not len(starts):
                    continue
                names, _, _, _ = by_document(term_names(LOWER[raw], starts, ends, salts[a:b][text]), text)
                for at in places(names, width):
                    cells, n = np.unique(at, return_counts=True)
                    sketch[cells] = np.minimum(sketch[cells] + np.minimum(n, least), least).astype(np.uint8)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        own = [k for k in range(len(sketch) // CELLS) if sketch[k * CELLS : (k + 1) * CELLS].any()]
        task = pa.array([TaskContext.get().partitionId()] * len(own), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), task, pa.array([squeeze(sketch[k * CELLS : (k + 1) * CELLS]) for k in own], pa.binary())], names=["chunk", "task", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows in order of ``chunk``, one chunk in memory at a time."""
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

        def out(chunk, task, cells):
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([task], pa.int32()), pa.array([squeeze(cells)], pa.binary())], names=["chunk", "task", "cells"])

        key, total = None, None
        for batch in batches:
            for chunk, task, cells in zip(*(batch[c].to_pylist() for c in ("chunk", "task", "cells"))):
                cells = np.frombuffer(expand(cells), np.uint8)
                if (chunk, task) != key:
                    if key is not None:
                        yield out(*key, total)
                    key, total = (chunk, task), cells.copy()
                else:
                    total = np.minimum(total.astype(np.uint16) + cells, least).astype(np.uint8)
        if key is not None:
            yield out(*key, total)

    schema = "chunk int, task int, cells binary"
    rows = base.select("lang", "text").mapInArrow(releasing(count), schema)
    n = shuffle_partitions(base.sparkSession)
    for task in (F.pmod("task", F.lit(16)), F.lit(0)):
        rows = rows.withColumn("task", task.cast("int")).repartition(n, "chunk", "task").sortWithinPartitions("chunk", "task").mapInArrow(add, schema)
    bits = np.zeros(ROWS * width, bool)
    for chunk, cells in rows.select("chunk", "cells").toLocalIterator():
        bits[chunk * CELLS : (chunk + 1) * CELLS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(cells)), np.uint8) >= least
    return np.packbits(bits, bitorder="little")


def surviving_counts(base: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """(lang, source, term, count, docs) of terms that the sketch can't rule out; a
    row for each task at least, so numbers have to be added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        words: dict[int, bytes] = {}
        waiting: list[tuple] = []  # group, name, count, documents
        size = 0

        def added():
            """What waits, with equal (group, name) made one."""
            group, name, n, docs = (np.concatenate(x) for x in zip(*waiting))
            order = np.lexsort((name, group))
            group, name = group[order], name[order]
            new = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (name[1:] != name[:-1]))))
            return group[new], name[new], np.add.reduceat(n[order], new), np.add.reduceat(docs[order], new)

        def rows(group, name, n, docs):
            langs, sources = (pa.array(x, pa.string()) for x in zip(*groups))
            for a in range(0, len(group), ROWS_OUT):
                some = slice(a, a + ROWS_OUT)
                at = pa.array(group[some])
                terms = pa.array([words[x] for x in name[some].tolist()], pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), terms, pa.array(n[some]), pa.array(docs[some])], names=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
            salts, of = _salts(langs), np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources)], np.int64)
            for a, b, raw, offs in chunks(batch["text"]):
                starts, ends, text = term_spans(raw, offs)
                if not len(starts):
                    continue
                lowered = LOWER[raw]
                names = term_names(lowered, starts, ends, salts[a:b][text])
                names, text, spans, n = by_document(names, text)
                may = np.ones(len(names), bool)
                for at in places(names, width):
                    may &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                names, text, spans, n = names[may], text[may], spans[may], n[may]
                fresh, example = np.unique(names, return_index=True)
                for x, i in zip(fresh.tolist(), spans[example].tolist()):
                    if x not in words:
                        words[x] = lowered[starts[i] : ends[i]].tobytes()
                waiting.append((of[a:b][text], names, n, np.ones(len(n), np.int64)))
                size += len(n)
                if size >= 2 * HELD:
                    waiting[:] = [added()]
                    size = len(waiting[0][0])
                    if size >= HELD:
                        yield from rows(*waiting.pop())
                        words.clear()
                        size = 0
        if waiting:
            yield from rows(*added())

    return base.mapInArrow(releasing(count), "lang string, source string, term string, count bigint, docs bigint")


def probability(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 1) / (total + terms)), exact for any 64-bit numbers."""
    above = (count.cast("decimal(19,0)") + 1) * F.lit(scale).cast("decimal(11,0)")
    return F.call_function("div", above, total.cast("decimal(19,0)") + terms.cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most ``scale`` + 1, so this fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Staged tables of the groups (lang, source) that occur, and of the kept terms'
    counts: lang, source, term, count, lang_count, and ``first`` on one row of each term."""
    spark = docs.sparkSession
    groups = staged(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")))
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    width = 1 << min(max((size // TEXT_PER_COUNTER).bit_length(), NARROW), WIDE)
    with rows_per_batch(spark, TEXTS):
        bits = document_sketch(docs, width, least)
    # Dealt by term, so that sums by source and by language need no further exchange.
    dealt = surviving_counts(docs, bits, width).repartition(shuffle_partitions(spark), "lang", "term")
    counts = dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang", "source", "term", "count", F.sum("docs").over(term).alias("in_docs"), F.sum("count").over(term).alias("lang_count"), (F.col("source") == F.min("source").over(term)).alias("first")
    )
    with rows_per_batch(spark, TEXTS):
        return groups, staged(kept.where(F.col("in_docs") >= least).drop("in_docs"))


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """One row per finding: ``lang, source, part, item, value, rank``.

    Terms are runs of ASCII letters and characters beyond ASCII in the whole
    text, A-Z lower-cased. A language keeps the V terms that at least ``least`` of its
    documents (rows) hold. A group (lang, source) and a language give a kept
    term with count occurrences p = 1 + floor(scale * (count + 1) / (N + V)), N being
    the sum of its counts. The gap of p from q is floor((p - q)^2 / q).

    * Part ``pair``: ``item`` is each other source of the language, ``value`` the sum
      of gaps of the group's p from that source's over all kept terms (0 if none).
    * Part ``term``: ``item`` is a kept term that the group has and whose p is above
      the language's; ``value`` is its gap from that, and ``top`` of these are listed.
    * ``rank`` counts from 1 in each group and part, by falling value, then by item.

    Null text, language and source are ''. Repeated rows are documents like any
    other, and identifiers aren't read. A group without terms is a group; a
    language with one source has no pairs. An empty table gives an empty result.
    Very long texts are held whole in a task. Other columns are not read. Terms
    are told apart by 64-bit hashes within a task, and by their text after it.
    """
    if not 0 < scale <= 1_000_000_000:
        raise ValueError("scale has to be from 1 to 1,000,000,000")
    base = docs.select(text_or_empty(F.col(lang_col).cast("string")).alias("lang"), text_or_empty(F.col(source_col).cast("string")).alias("source"), text_or_empty(text_col).alias("text"))
    groups, kept = kept_terms(base, least)
    # One row for each group and each language; joins with these are planned by their size.
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("held"))
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_if("first").alias("terms"))
    known = groups.select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    zero = F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"), scale))
    known = staged(known.withColumn("zero", zero))
    here = staged(
        kept.join(known, ["lang", "source"]).select(
            "lang", "source", "term", "zero", probability(F.col("count"), F.col("total"), F.col("terms"), scale).alias("p"), probability(F.col("lang_count"), F.col("lang_total"), F.col("terms"), scale).alias("q")
        )
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = here.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # Terms that both sources of a pair have, each pair once. What the sums of single
    # sources below take for granted (that the other has none) is taken off again.
    x = here.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    y = here.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    pa_, pb, za, zb = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    more = lambda p, q, z, w: F.sum(gap(p, q) - gap(p, w) - gap(z, q) + gap(z, w))
    met = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(more(pa_, pb, za, zb).alias("ab"), more(pb, pa_, zb, za).alias("ba"))
    met = met.selectExpr("lang", "stack(2, a, b, ab, b, a, ba) AS (source, item, both)")
    # A source's terms of one probability against each other source that has none of them.
    level = staged(here.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("n")))
    other = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("w"), F.col("held").alias("item_held"))
    n, p, z, w = (F.col(c) for c in ("n", "p", "zero", "w"))
    against = level.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(n * gap(p, w)).alias("mine"), F.sum(n * gap(w, p)).alias("theirs"))
    pairs = known.join(other, "lang").where("source <> item").join(met, ["lang", "source", "item"], "left")
    pairs = pairs.join(against.drop("theirs"), ["lang", "source", "item"], "left")
    pairs = pairs.join(against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "theirs"), ["lang", "source", "item"], "left")
    value = (F.col("terms") - F.col("held") - F.col("item_held")) * gap(z, w)
    value = sum((F.coalesce(c, F.lit(0)) for c in (value, F.col("both"), F.col("mine"), F.col("theirs"))), F.lit(0).cast("bigint"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    return pairs.unionAll(terms)
