"""N-gram Jaccard join by a token-group matrix, and the classes it links.

Documents with equal shingle sets are one class; one stands for all. Classes
are put into groups of similar sets, the union of each group's tokens is stored,
and a group is opened (its members are read and compared) only if the overlap
with its union reaches what the similarity asks for.

* The matrix has a row for each (token, group). A set of n tokens that links
  with another shares at least ceil(percent * n / 100) with it, so whatever the
  order of all tokens, the two share one of their first n - ceil(percent * n /
  100) + 1 (their heads). Only heads enter the matrix. The order has the tokens
  that very many documents hold last, so a common passage brings sets together
  only where little else is in them. Which tokens are frequent is counted in
  bounded memory over all documents; this decides the order only, and every
  order gives the same links.
* Heads are longer than that by a few tokens, so linked sets share these few as well. A
  set that shares fewer with all others of any band of sizes leaves the matrix, and its
  text never travels; so tokens that sets share by chance bring few of them together.
* Groups have about ``GROUP`` members and ``GROUP_TOKENS`` tokens: sets that share
  the most common token of their heads, dealt by a hash.
* Bound. The number of tokens that two groups share in the matrix has to reach
  what their sizes ask of heads. Then their unions meet: a set x of the one can
  link with a set y of the other only if they share percent / 100 of the larger,
  so the unions have to share that much of the larger of both groups' smallest
  sets. Other pairs of groups stay closed.
* Opening. Each set of the one group is bounded against the union of the other,
  then compared with the members.

Groups are first opened on their own, then each with the first of those that
share its token. What is then linked belongs to one component, members are
grouped anew by component, and only groups of different components can still
be opened; small components of one home share groups. So very many similar sets cost pairs of groups only where links are
missing, and no link between different components is lost.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import discard, divided, releasing, rows_per_batch, shuffle_partitions, staged, text_or_empty
from lorebase.llm.components import components
from lorebase.llm.kernel import U, chunks, mix64, shingles

GROUP = 32
GROUP_TOKENS = 1 << 16
#: Tokens known as frequent: a bound of what is broadcast and of a task's counters.
FREQUENT = 1 << 19
#: Tokens that a task counts at once.
COUNTED = 1 << 20
#: Texts handed to Python at a time, and bytes of them worked on at once.
TEXTS, PIECE = 2000, 1 << 18
#: Bits of the filter that keeps sets without candidates from travelling.
FILTER_BITS = 1 << 26
#: Linked sets share one token of their heads, and one more for so many that they share at least, up to MORE.
PER_MORE, MORE = 16, 7
#: Bands of sizes in the span of sizes that can link.
FINE = 4
NO_ID = (1 << 63) - 1


def head_size(n: int, percent: int) -> int:
    """So many first tokens of a set of n, in any order, share 1 + m with those of every
    set that links with it, where m is ``percent * n // (100 * PER_MORE)`` of the smaller
    set, ``MORE`` at most: the last of these has the others of ceil(percent * n / 100) behind it."""
    return n - -(-percent * n // 100) + 1 + min(percent * n // (100 * PER_MORE), MORE)


def head(tokens: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """First tokens of a sorted set: those that aren't frequent by their value,
    then the frequent ones (``frequent`` is sorted) by their rank."""
    k = head_size(len(tokens), percent)
    if not len(frequent):
        return tokens[:k]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    hit = frequent[at] == tokens
    rare = tokens[~hit][:k]
    if len(rare) == k:
        return rare
    return np.concatenate((rare, tokens[hit][np.argsort(rank[at[hit]])][: k - len(rare)]))


class Counts:
    """Tokens that a task meets more than once, and how often; memory is bounded."""

    def __init__(self):
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.tokens, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, own: list[np.ndarray]) -> None:
        self.waiting += own
        self.size += sum(map(len, own))
        if self.size >= COUNTED:
            self.close()

    def close(self) -> None:
        tokens, counts = np.unique(np.concatenate([np.zeros(0, U), *self.waiting]), return_counts=True)
        self.waiting, self.size = [], 0
        tokens, counts = np.concatenate((self.tokens, tokens[counts > 1])), np.concatenate((self.counts, counts[counts > 1]))
        self.tokens, place = np.unique(tokens, return_inverse=True)
        self.counts = np.bincount(place, counts, len(self.tokens)).astype(np.int64)
        if len(self.tokens) > FREQUENT:
            most = np.sort(np.argpartition(-self.counts, FREQUENT)[:FREQUENT])
            self.tokens, self.counts = self.tokens[most], self.counts[most]


def reaches(union_x: np.ndarray, union_y: np.ndarray, least: int, percent: int) -> bool:
    """Whether two groups' unions share enough for a set of ``least`` tokens to link.

    Both unions are sorted; the shorter is looked up in the longer."""
    small, large = sorted((union_x, union_y), key=len)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return 100 * int((large[at] == small).sum()) >= percent * least


def verify(x: list[np.ndarray], y: list[np.ndarray] | None, percent: int, comp_x: list, comp_y: list | None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) that link members of two groups (of one, if ``y`` is None).
    Members known to be of one component are not compared again."""
    alone = y is None
    y, comp_y = (x, comp_x) if alone else (y, comp_y)
    parent: dict = {}

    def root(c):
        while (p := parent.get(c, c)) != c:
            parent[c] = c = parent.get(p, p)
        return c

    sizes = np.array([len(t) for t in y])
    every = np.concatenate(y)
    owner = np.repeat(np.arange(len(y)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    union = every[np.concatenate(([True], every[1:] != every[:-1]))]
    for i, t in enumerate(x):
        roots = np.array([root(c) != root(comp_x[i]) for c in comp_y])
        if alone:
            roots[: i + 1] = False
        roots &= (100 * np.minimum(sizes, len(t)) >= percent * np.maximum(sizes, len(t)))
        if not roots.any():
            continue
        at = np.minimum(np.searchsorted(union, t), len(union) - 1)
        if 100 * int((union[at] == t).sum()) < percent * len(t):
            continue  # the bound: no member can reach the threshold
        a, b = np.searchsorted(every, t, "left"), np.searchsorted(every, t, "right")
        n = b - a
        hits = owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        overlap = np.bincount(hits, minlength=len(y))
        for j in np.flatnonzero(roots & (100 * overlap >= percent * (len(t) + sizes - overlap))).tolist():
            if root(comp_y[j]) != root(comp_x[i]):
                parent[root(comp_y[j])] = root(comp_x[i])
                yield i, j


def set_name(tokens: np.ndarray) -> bytes:
    return hashlib.sha256(tokens).digest()[:16]


def sid_of(name: bytes) -> int:
    """A short name of a set, for finding candidates only; 63 bits."""
    return int.from_bytes(name[:8], "big") & NO_ID


def shared_tokens(plain: DataFrame, words: int, percent: int, parts: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(token, sid) of the tokens that more than one set has in its head.

    Nearly all tokens are held once, so they travel packed: a batch of texts
    gives one row of sorted names for each of ``parts`` parts. A token that two
    sets of a batch hold is shared for certain: its holders are given out at
    once, and only its name is sent on, with a mark. So a token that very many
    sets hold is sent once for each batch. A name is 32 bits within its part;
    equal names of different tokens only bring more sets together.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sid, seen = [], [], set()
            for _, _, raw, offs in chunks(batch["text"], PIECE):
                for t in shingles(raw, offs, words):
                    if len(t) and (x := set_name(t)) not in seen:
                        seen.add(x)
                        tokens.append(head(t, percent, frequent, rank))
                        sid.append(sid_of(x))
            if not tokens:
                continue
            owner, sids = np.repeat(np.arange(len(sid)), [len(x) for x in tokens]), np.array(sid, np.int64)
            name = mix64(np.concatenate(tokens) ^ U(0x6A09E667F3BCC909))
            name = name % U(parts) << U(32) | name >> U(32)
            order = np.argsort(name, kind="stable")
            name, owner = name[order], owner[order]
            new = np.concatenate(([True], name[1:] != name[:-1]))
            size = np.diff(np.append(np.flatnonzero(new), len(name)))
            rows, many = [], np.repeat(size > 1, size)

            def give(name, sids, shared):
                part = (name >> U(32)).astype(np.int64)
                edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(name)]):
                    rows.append((int(part[x]), name[x:y].astype(np.uint32).tobytes(), sids[x:y].tobytes(), shared))

            if many.any():
                give(name[many], sids[owner[many]], 1)
            give(name[new], np.where(many[new], -1, sids[owner[new]]), 0)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.int32()))], names=["part", "names", "sids", "shared"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part, name, sid):
            return pa.RecordBatch.from_arrays([pa.array(name.astype(np.int64) | part << 32), pa.array(sid)], names=["token", "sid"])

        part, names, sids = None, [], []

        def close():
            if not names:
                return
            name, sid = np.concatenate(names), np.concatenate(sids)
            order = np.lexsort((sid, name))
            name, sid = name[order], sid[order]
            other = np.concatenate(([True], (name[1:] != name[:-1]) | (sid[1:] != sid[:-1])))  # copies of a set are one
            name, sid = name[other], sid[other]
            new = np.concatenate(([True], name[1:] != name[:-1]))
            size = np.diff(np.append(np.flatnonzero(new), len(name)))
            keep = np.repeat(size > 1, size) & (sid >= 0)
            yield out(part, name[keep], sid[keep])

        for batch in batches:
            for p, a, b, shared in zip(*(batch[c].to_pylist() for c in ("part", "names", "sids", "shared"))):
                name, sid = np.frombuffer(a, np.uint32), np.frombuffer(b, np.int64)
                if shared:
                    yield out(p, name, sid)
                    continue
                if p != part:
                    yield from close()
                    part, names, sids = p, [], []
                names.append(name)
                sids.append(sid)
        yield from close()

    packed = plain.select("text").mapInArrow(releasing(deal), "part int, names binary, sids binary, shared int")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(releasing(meet), "token bigint, sid bigint").distinct()


def least_shared(low: Column, high: Column, low_other: Column, high_other: Column, percent: int) -> Column:
    """What the heads of linked sets of sizes from these two ranges share at least.

    Linked sets of sizes a >= b share t (a + b) / (1 + t), of which at most t a - m are past
    a head: t (b - t a) / (1 + t) + m or more, with t = percent / 100 and the m of ``head_size``.
    Less is asked for, as names of tokens may be equal: one, and several times what is
    likely in very long sets."""
    t = percent / 100
    asks = F.least(low_other - t * high, low - t * high_other) * (t / (1 + t))
    m = F.least(F.floor(percent * F.least(low, low_other) / (100 * PER_MORE)), F.lit(MORE))
    return F.greatest(asks, F.lit(0)) + m - 1 - high * high_other / (1 << 31)


def met_enough(held: DataFrame, percent: int) -> DataFrame:
    """``held`` (token, set, n) without the sets that share too few tokens to link, and without
    tokens that a set shares with none of a size at which it shares enough.

    A set's tokens are counted by the band of sizes of those it shares them with,
    whoever these are, so this bounds what it shares with any one of them; no sets are paired."""
    # Sizes that can link lie in one band or at most FINE bands apart.
    step = math.log(max(100 / percent, 1.05)) * (1 + 1e-9) / FINE
    held = held.withColumn("band", F.floor(F.log("n") / step).cast("int"))
    at, own = Window.partitionBy("token").orderBy("band"), Window.partitionBy("set")
    away = [(d, 1 << i) for i, d in enumerate(range(-FINE, FINE + 1))]
    masks = [F.when(F.sum("holders").over(at.rangeBetween(d, d)) > int(d == 0), bit).otherwise(0) for d, bit in away]
    bands = held.groupBy("token", "band").agg(F.count(F.lit(1)).alias("holders"))
    bands = bands.select("token", "band", functools.reduce(operator.add, masks).alias("mask")).where("mask > 0")

    def enough(d: int, bit: int) -> Column:
        low, high = F.exp((F.col("band") + d) * step) * (1 - 1e-9), F.exp((F.col("band") + d + 1) * step) * (1 + 1e-9)
        shared = F.sum(F.when(F.col("mask").bitwiseAND(bit) > 0, 1).otherwise(0)).over(own)
        return F.when(shared >= least_shared(F.col("n"), F.col("n"), low, high, percent), bit).otherwise(0)

    left = held.join(bands, ["token", "band"])
    left = left.select("token", "set", "n", "mask", functools.reduce(operator.add, [enough(*x) for x in away]).alias("good"))
    return left.where(F.col("mask").bitwiseAND(F.col("good")) > 0).drop("mask", "good")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, class_id,
    text_hash, component_hash``.

    * A set holds the distinct shingles of ``words`` lower-cased (A-Z) words of
      the whole text; a shorter text's whole sequence is its only shingle. Sets
      link if 100 * intersection >= ``percent`` * union. Null or empty texts and
      texts without words have no shingles and link with nothing.
    * ``component_id`` is the smallest identifier reachable by links, and ``class_id``
      the smallest identifier with the same set. Links within a known component
      are not looked for again, so they are not counted.
    * ``text_hash`` is xxhash64 of the text, which tells rows with one identifier
      apart; ``component_hash`` is the component's own name (null without words), which
      tells components apart whose smallest identifiers are equal or null.
    * Null identifiers belong to classes like any other row but name none, unless
      a class has no other; repeated rows are rows like any other. An empty table
      gives an empty result; other columns are not read. A very long text is held
      whole in a task and is a group of its own.
    * Shingles are 64-bit hashes, sets are compared whole by SHA-256 of them.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent has to be from 1 to 100")
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), text_or_empty(text_col).alias("text"))
    hashed = plain.withColumn("text_hash", F.xxhash64("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, counts = ["doc_id", "text_hash", "n", "set", "token", "count"], Counts()
        for batch in batches:
            for a, b, raw, offs in chunks(batch["text"], PIECE):
                own = list(shingles(raw, offs, words))
                counts.add(own)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["text_hash"].slice(a, b - a), pa.array([len(t) for t in own], pa.int64()), pa.array([set_name(t) if len(t) else None for t in own], pa.binary()), none, none], names=columns)
        counts.close()
        none = pa.nulls(len(counts.tokens), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(none), pa.binary()), pa.array(counts.tokens.view(np.int64)), pa.array(counts.counts)], names=columns)

    with rows_per_batch(spark, TEXTS):
        first = staged(hashed.mapInArrow(releasing(sets), "doc_id bigint, text_hash bigint, n bigint, set binary, token bigint, count bigint"))
    signed = first.where("n IS NOT NULL").drop("token", "count")
    most = first.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT)
    frequent = most.select("token").toArrow()["token"].to_numpy().view(U)  # at most FREQUENT numbers, by falling count
    order = np.argsort(frequent)
    frequent, rank = frequent[order], (len(order) - order).astype(np.int32)

    classes = staged(signed.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    sid = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("bigint").bitwiseAND(F.lit(NO_ID))
    by_sid = classes.select("set", "n", sid.alias("sid"))
    with rows_per_batch(spark, TEXTS):
        shared = staged(shared_tokens(plain, words, percent, shuffle_partitions(spark), frequent, rank))
    held = staged(shared.join(by_sid, "sid").select("token", "set", "n"))
    discard(shared)
    seen, held = held, staged(met_enough(held, percent))
    discard(seen)
    counted = held.groupBy("token").agg(F.count(F.lit(1)).alias("holders"), F.sum("n").alias("volume")).where("holders > 1")
    seen, held = held, staged(held.drop("n").join(counted, "token"))
    discard(seen)
    # Groups: sets that share the most common token of their heads, dealt by a hash.
    home = held.groupBy("set").agg(F.max(F.struct("holders", "volume", "token")).alias("most"))
    parts = F.ceil(F.greatest(F.col("most.holders") / GROUP, F.col("most.volume") / GROUP_TOKENS))
    wanted = home.select("set", F.col("most.token").alias("home"), F.pmod(F.xxhash64("set"), parts).alias("part")).join(classes, "set")
    wanted = staged(wanted.withColumn("place", sid.bitwiseXOR(F.col("rep")).bitwiseAND(F.lit(FILTER_BITS - 1))))

    # Sets in the matrix are few as a rule: a filter of a fixed size, on the short name
    # and the identifier that stands for the class, keeps the others from travelling.
    marks = wanted.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, U)
    bits[marks["at"].to_numpy()] = marks["bits"].to_numpy().view(U)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for a, b, raw, offs in chunks(batch["text"], PIECE):
                names, ids, own = [], [], []
                for i, (rep, t) in enumerate(zip(batch["doc_id"].slice(a, b - a).to_pylist(), shingles(raw, offs, words))):
                    if len(t):
                        place = (sid_of(x := set_name(t)) ^ rep) & (FILTER_BITS - 1)
                        if int(bits[place >> 6]) >> (place & 63) & 1:
                            names.append(x)
                            ids.append(rep)
                            own.append(squeeze(raw[offs[i] : offs[i + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.int64()), pa.array(own, pa.binary())], names=["set", "rep", "text"])

    # A compressed text is a fraction of its tokens, which are made of it where a group is opened.
    near = plain.mapInArrow(releasing(pick), "set binary, rep bigint, text binary")
    with rows_per_batch(spark, TEXTS):
        # Partitioned by ``set`` alone (``least`` is never above ``rep``), so texts travel once for both.
        members = staged(near.join(wanted.select("set", F.col("rep").alias("least"), "home", "part"), "set").where("rep <= least").drop("rep", "least").dropDuplicates(["set"]))

    def pack(frame: DataFrame, *key: str) -> DataFrame:
        return frame.groupBy(*key).agg(F.collect_list(F.struct("set", "component", "text")).alias("members"))

    def read(value):
        own, expand = value.values, zstandard.ZstdDecompressor().decompress
        texts = pa.array([expand(x) for x in own.field("text").to_pylist()], pa.binary())
        tokens = [t for _, _, data, offs in chunks(texts, PIECE) for t in shingles(data, offs, words)]
        return [own.field("set").to_pylist(), own.field("component").to_pylist(), tokens]

    def join_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups on their own: each member's component, named by its least set."""
        for batch in batches:
            sets_, labels = [], []
            for x in batch["members"]:
                own, _, t = read(x)
                parent = {c: c for c in own}

                def root(c):
                    while parent[c] != c:
                        c = parent[c]
                    return c

                for i, j in verify(t, None, percent, own, None):
                    a, b = sorted((root(own[i]), root(own[j])))
                    parent[b] = a
                sets_ += own
                labels += [root(c) for c in own]
            yield pa.RecordBatch.from_arrays([pa.array(sets_, pa.binary()), pa.array(labels, pa.binary())], names=["set", "component"])

    def unions_of(packed: DataFrame) -> DataFrame:
        """(group, tokens, least, most) of packed groups: the stored unions, as 32-bit
        names of their tokens. Names may be equal, so overlaps are bounded from above."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [read(x)[2] for x in batch["members"]]
                columns = [batch["group"], pa.array([np.sort((np.unique(np.concatenate(t)) >> U(32)).astype(np.uint32)).tobytes() for t in own], pa.binary()), pa.array([min(map(len, t)) for t in own], pa.int64()), pa.array([max(map(len, t)) for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "tokens", "least", "most"])

        return packed.select("group", "members").mapInArrow(releasing(work), "group bigint, tokens binary, least bigint, most bigint")

    def qualifying(pairs: DataFrame, unions: DataFrame) -> DataFrame:
        """The pairs (g, h) of groups that the bound leaves."""

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [reaches(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), n, percent) for x, y, n in zip(batch["tx"].to_pylist(), batch["ty"].to_pylist(), batch["least"].to_pylist())]
                yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(keep, pa.bool_())) for c in ("g", "h")], names=["g", "h"])

        x = unions.select(F.col("group").alias("g"), F.col("tokens").alias("tx"), F.col("least").alias("lx"), F.col("most").alias("mx"))
        y = unions.select(F.col("group").alias("h"), F.col("tokens").alias("ty"), F.col("least").alias("ly"), F.col("most").alias("my"))
        near = pairs.join(x, "g").join(y, "h").where((100 * F.col("mx") >= percent * F.col("ly")) & (100 * F.col("my") >= percent * F.col("lx")))
        return near.select("g", "h", "tx", "ty", F.greatest("lx", "ly").alias("least")).mapInArrow(releasing(bound), "g bigint, h bigint")

    def open_groups(pairs: DataFrame, store: DataFrame) -> DataFrame:
        """Links (a, b) of components from pairs of groups ``g``, ``h``."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [], []
                for x, y in zip(batch["x"], batch["y"]):
                    (_, cx, tx), (_, cy, ty) = read(x), read(y)
                    for i, j in verify(tx, ty, percent, cx, cy):
                        a.append(cx[i])
                        b.append(cy[j])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        x = store.select(F.col("group").alias("g"), F.col("members").alias("x"))
        y = store.select(F.col("group").alias("h"), F.col("members").alias("y"))
        return pairs.join(x, "g").join(y, "h").select("x", "y").mapInArrow(releasing(work), "a binary, b binary")

    def merged(labelled: DataFrame, links: DataFrame) -> DataFrame:
        """``labelled`` with the components that ``links`` joins made one."""
        found = components(links).select(F.col("node").alias("component"), F.col("component").alias("__to"))
        return labelled.join(found, "component", "left").withColumn("component", F.coalesce("__to", "component")).drop("__to")

    # Texts are read from `members` only to pack groups; labels travel without them.
    # Texts of groups of one stay where they are; of the others only those travel.
    place = members.select("set", "home", "part")
    several = staged(place.groupBy("home", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    alone, rest = divided(members, several, "home", "part")
    rest = pack(rest.withColumn("component", F.col("set")), "home", "part").select("members")
    with rows_per_batch(spark, 16):  # a row is a group's texts
        labels = staged(rest.mapInArrow(releasing(join_within), "set binary, component binary").unionByName(alone.select("set", F.col("set").alias("component"))))

    # Each group with the first one of the same home.
    hub = staged(place.groupBy("home").agg(F.min("part").alias("hub"), F.max("part").alias("last")).where("last > hub").drop("last"))
    named = members.join(hub, "home").join(labels, "set").withColumn("group", F.xxhash64("home", "part"))
    store = staged(pack(named, "group"))
    pairs = staged(place.join(hub, "home").where("part > hub").select(F.xxhash64("home", "part").alias("g"), F.xxhash64("home", "hub").alias("h")).distinct())
    with rows_per_batch(spark, 16):
        unions = staged(unions_of(store))
        pairs = staged(qualifying(pairs, unions))
        labels = staged(merged(labels, open_groups(pairs, store)))
    discard(store, unions)
    now = staged(place.join(labels, "set"))

    # What is left: pairs of components that share tokens of the matrix. Members are put
    # into new units, by component; where a home holds many small components, these
    # share units of about GROUP members, so that they don't meet one by one.
    per = staged(now.join(classes.select("set", "n"), "set").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("volume"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("home").alias("home")))
    crowd = per.where(F.col("size") <= GROUP).groupBy("home").agg(F.count(F.lit(1)).alias("components"), F.greatest(F.sum("size") / GROUP, F.sum("volume") / GROUP_TOKENS).alias("units")).where(F.col("components") > GROUP)
    crowded = F.col("units").isNotNull() & (F.col("size") <= GROUP)
    unit = F.when(crowded, F.xxhash64("home", F.pmod(F.xxhash64("component"), F.ceil("units")))).otherwise(F.xxhash64("component"))
    parts = F.when(crowded, F.lit(1)).otherwise(F.ceil(F.greatest(F.col("size") / GROUP, F.col("volume") / GROUP_TOKENS)))
    per = staged(per.join(crowd.select("home", "units"), "home", "left").select("component", "least", "most", unit.alias("unit"), parts.alias("parts")))
    units = staged(per.groupBy("unit").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("components")))
    placed = now.select("set", "component").join(per.select("component", "unit", "parts"), "component").join(units.drop("components"), "unit")
    placed = staged(placed.select("set", "component", "unit", "least", "most", F.xxhash64("unit", F.pmod(F.xxhash64("set"), F.col("parts"))).alias("group")))
    cells = staged(held.select("token", "set").join(placed, "set").select("token", "unit", "least", "most").distinct())
    # Tokens held by the same units ask the same question: one of them stands for all.
    name = F.xxhash64("unit")
    rows = cells.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(name).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "unit")).alias("y"), F.sum(F.pmod(name, F.lit(1 << 31))).alias("s")).where("n > 1")
    asked = rows.groupBy("n", "x", "y", "s").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("tokens")).select("token", "tokens")
    cells = staged(cells.join(asked, "token"))
    # Units meet on a token and on a band of sizes: sets of a and b tokens link only if t <=
    # a / b <= 1 / t, with t = percent / 100. The one unit lies in the bands of its own sets' sizes,
    # the other in those of sizes that can link with its sets; they meet in the first in common.
    t = percent / 100
    step = math.log(max(1 / t, 1.05))
    band = lambda c: F.floor(F.log(c) / step).cast("int")

    def side(c: str, low: Column, high: Column) -> DataFrame:
        own = cells.select("token", "tokens", F.col("unit").alias(f"c{c}"), F.col("least").alias(f"l{c}"), F.col("most").alias(f"m{c}"), band(low).alias(f"b{c}"), band(high).alias("last"))
        return own.withColumn("band", F.explode(F.sequence(f"b{c}", "last"))).drop("last")

    x = side("x", F.col("least"), F.col("most"))
    y = side("y", t * (1 - 1e-9) * F.col("least"), (1 + 1e-9) / t * F.col("most")).drop("tokens")
    near_by = (100 * F.col("mx") >= percent * F.col("ly")) & (100 * F.col("my") >= percent * F.col("lx"))
    meet = (F.col("cx") < F.col("cy")) & (F.col("band") == F.greatest("bx", "by")) & near_by
    met = x.join(y, ["token", "band"]).where(meet).groupBy("cx", "cy").agg(F.sum("tokens").alias("shared"), *[F.min(c).alias(c) for c in ("lx", "mx", "ly", "my")])
    asks = least_shared(F.col("lx"), F.col("mx"), F.col("ly"), F.col("my"), percent)
    met = staged(met.where(F.col("shared") >= asks).select("cx", "cy"))
    groups = staged(placed.select("unit", "group").distinct())
    own = units.where("components > 1").join(groups, "unit").select(F.col("group").alias("g"), F.col("group").alias("h"))
    pairs = met.join(groups.select(F.col("unit").alias("cx"), F.col("group").alias("g")), "cx").join(groups.select(F.col("unit").alias("cy"), F.col("group").alias("h")), "cy").select("g", "h")
    pairs = staged(pairs.unionByName(own))
    opened = pairs.select(F.col("g").alias("group")).unionByName(pairs.select(F.col("h").alias("group"))).distinct()
    opened = staged(placed.drop("unit").join(opened, "group", "left_semi"))
    store = staged(pack(divided(members.select("set", "text"), opened, "set")[1].join(opened, "set"), "group"))
    with rows_per_batch(spark, 16):
        unions = staged(unions_of(store))
        pairs = staged(qualifying(pairs, unions))
        found = staged(merged(now.select("set", "component"), open_groups(pairs, store)))
    discard(store, unions, members, held, cells)

    # Sets to identifiers.
    named = staged(classes.join(found, "set", "left").select("set", "rep", F.coalesce("component", "set").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = staged(named.join(least, "component").select("set", F.col("rep").alias("class_id"), "component_id", F.xxhash64("component").alias("component_hash")))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    empty = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("bigint").alias("component_hash"))
    full = signed.where("n > 0").join(by_set, "set").select("doc_id", "n", "class_id", "component_id", "text_hash", "component_hash")
    return full.unionByName(empty).select(null("doc_id"), F.col("n").alias("n_shingles"), null("component_id"), null("class_id"), "text_hash", "component_hash")
