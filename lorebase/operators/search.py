"""Full-text search: expressions over the words of several columns.

Words are lower-cased, without accents, split at anything but letters and
digits. An expression has words, ``"phrases"``, ``prefixes*``, ``column:`` before
any of these, brackets, and AND (or nothing), OR and NOT (``a NOT b``); NOT binds
tightest, then AND, then OR. It is evaluated in one of two ways:

* ``matching`` tests rows where they lie: a row's words, joined by blanks, are
  searched for each part of the expression. Nothing is exploded or shuffled.
* ``lookup`` asks an index kept by ``write_index``: postings sorted by word, so a
  scan reads only the row groups of the words asked for, and one aggregation by
  row decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with accents and their plain forms (fixed values).
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: Texts whose postings are made at a time.
TEXTS = 256
#: Positions of a row's columns lie so far apart that no phrase crosses them.
GAP = 1 << 40


class Part(NamedTuple):
    """Words that follow one another, the last perhaps a prefix, in one column or any."""

    words: tuple[str, ...]
    prefix: bool
    column: str | None


def fold(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")


def spaced(text: Column) -> Column:
    """The words with one blank before and after each."""
    return F.regexp_replace(F.concat(F.lit(" "), fold(text), F.lit(" ")), "[^a-z0-9]+", " ")


def parse(expression: str):
    """A tree of ("and" | "or" | "not", left, right) with ``Part`` leaves; ValueError for anything else."""
    found = re.findall(r'\(|\)|(?:\w+:)?"[^"]*"\*?|[^\s()"]+', expression)
    at = 0

    def peek():
        return found[at] if at < len(found) else None

    def take():
        nonlocal at
        at += 1
        return found[at - 1]

    def leaf():
        x = peek()
        if x is None or x in (")", "AND", "OR", "NOT"):
            raise ValueError(f"a term is missing in {expression!r}")
        take()
        if x == "(":
            inner = level(0)
            if peek() != ")":
                raise ValueError(f"a bracket is missing in {expression!r}")
            take()
            return inner
        column, _, rest = x.partition(":") if re.match(r"\w+:", x) else (None, "", x)
        words = tuple(re.sub("[^a-z0-9]+", " ", rest.lower().translate(str.maketrans(*ACCENTS))).split())
        if not words:
            raise ValueError(f"no word in {x!r}")
        return Part(words, rest.endswith("*"), column)

    def level(n: int):
        name = ("or", "and", "not")[n]
        below = (lambda: level(n + 1)) if n < 2 else leaf
        tree = below()
        while (x := peek()) is not None and x != ")":
            if x == name.upper():
                take()
            elif name != "and" or x in ("OR", "NOT"):
                break
            tree = (name, tree, below())
        return tree

    tree = level(0)
    if at < len(found):
        raise ValueError(f"{found[at]!r} is out of place in {expression!r}")
    return tree


def parts_of(tree) -> list[Part]:
    return [tree] if isinstance(tree, Part) else list(dict.fromkeys(parts_of(tree[1]) + parts_of(tree[2])))


def _decide(tree, test) -> Column:
    if isinstance(tree, Part):
        return test(tree)
    a, b = _decide(tree[1], test), _decide(tree[2], test)
    return {"and": a & b, "or": a | b, "not": a & ~b}[tree[0]]


def matching(items: DataFrame, expression: str, *columns: str) -> DataFrame:
    """Rows of ``items`` that match."""
    tree = parse(expression)
    lines = {c: f"__words_{i}" for i, c in enumerate(columns)}

    def test(p: Part) -> Column:
        if p.column is not None and p.column not in columns:
            raise ValueError(f"no column {p.column!r}; there are {', '.join(columns)}")
        said = F.lit(" " + " ".join(p.words) + ("" if p.prefix else " "))
        found = [F.contains(F.col(lines[c]), said) for c in ([p.column] if p.column else columns)]
        out = found[0]
        for x in found[1:]:
            out = out | x
        return out

    return items.withColumns({lines[c]: spaced(F.col(c)) for c in columns}).where(_decide(tree, test)).select(*items.columns)


def index(items: DataFrame, *columns: str) -> DataFrame:
    """Postings (token, id, column, places): a row for each word of each row and column.

    A row's words are put together where the row lies, so words are not shuffled one by one."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                tokens, owners, named, places, ends = [], [], [], [], [0]
                for i, column, line in zip(*(batch[c].slice(at, TEXTS).to_pylist() for c in ("id", "column", "line"))):
                    own: dict[str, list[int]] = {}
                    for place, token in enumerate(line.split()):
                        own.setdefault(token, []).append(place)
                    for token, found in own.items():
                        tokens.append(token)
                        places += found
                        ends.append(len(places))
                    owners += [i] * len(own)
                    named += [column] * len(own)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(owners, pa.int64()), pa.array(named, pa.string()), lists], names=["token", "id", "column", "places"])

    each = items.select(F.col("id").cast("bigint").alias("id"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), spaced(F.col(c)).alias("line")) for c in columns])))
    return each.mapInArrow(post, "token string, id bigint, column string, places array<bigint>")


def write_index(items: DataFrame, path: str, *columns: str) -> None:
    index(items, *columns).repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def lookup(postings: DataFrame, expression: str) -> DataFrame:
    """(id) of the rows that match, from postings."""
    tree = parse(expression)
    parts = parts_of(tree)

    def word(w: str, prefix: bool) -> Column:
        return F.col("token").startswith(w) if prefix else F.col("token") == w

    asked = F.lit(False)
    for w, prefix in dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in parts for i, w in enumerate(p.words)):
        asked = asked | word(w, prefix)
    here = lambda p: F.lit(True) if p.column is None else F.col("column") == p.column
    found = []
    for i, p in enumerate(parts):
        if len(p.words) == 1:
            found.append(F.max(F.when(word(p.words[0], p.prefix) & here(p), True)).alias(f"p{i}"))
        else:
            # Starts of the phrase that each of its words allows; columns are kept apart by a gap.
            base = F.pmod(F.xxhash64("column"), F.lit(1 << 20)) * GAP
            for k, w in enumerate(p.words):
                starts = F.transform("places", (lambda k: lambda x: base + x - k)(k))
                found.append(F.flatten(F.collect_list(F.when(word(w, p.prefix and k == len(p.words) - 1) & here(p), starts))).alias(f"p{i}_{k}"))

    def test(p: Part) -> Column:
        i = parts.index(p)
        if len(p.words) == 1:
            return F.coalesce(F.col(f"p{i}"), F.lit(False))
        common = F.col(f"p{i}_0")
        for k in range(1, len(p.words)):
            common = F.array_intersect(common, F.col(f"p{i}_{k}"))
        return F.size(common) > 0

    return postings.where(asked).groupBy("id").agg(*found).where(_decide(tree, test)).select("id")
