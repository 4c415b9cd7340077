"""Toxicity by a counterfactually regularised classifier.

Features are the lower-cased words of a text and their first 3 to 6 bytes (in
languages that inflect, a stem tells more than a form), hashed to ``2**BITS``
places; a text has a feature or not. Features whose rates in the two classes
differ by ``screen`` standard errors are kept, and a sparse logistic regression
is fitted on a bounded sample of labelled rows:

    weighted log loss + l1 * |w| + swap * mean((w . (x' - x))**2)

where x' is x with its identity terms swapped for others of their group, for
sentences of the sample that hold such terms, and for the terms themselves. So
the model may not tell a group's terms apart, nor score a neutral mention by
them. Class weights bring the sample back to the classes' frequencies, so
scores are probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import discard, releasing, rows_per_batch, staged, text_or_empty
from lorebase.llm.kernel import CHUNK, LOWER, chunks, flat, prefix, spans_hash

BITS = 20
#: Texts handed to Python at a time.
TEXTS = 2000
STEMS = (3, 4, 5, 6)
#: Groups of terms that may stand for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("transgender", "cisgender", "nonbinary"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("american", "african", "european", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "arab", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic"),
    ("young", "old", "elderly"),
    ("frau", "mann"),
    ("frauen", "männer"),
    ("femme", "homme"),
    ("femmes", "hommes"),
    ("mujer", "hombre"),
    ("mujeres", "hombres"),
)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters from U+00C0 to U+00DE in lower case."""
    out = LOWER[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[wide] += 0x20
    return out


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letter = (data >= 97) & (data <= 122) | (data >= 0x80)
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(letter[1:], letter[:-1], out=edge[1:-1])
    edge[offs] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    inner = letter[starts]
    return starts[inner], ends[inner]


def feature_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every word: one row for the word and each stem, each text's first word)."""
    low = lowered(data)
    starts, ends = letter_runs(low, offs)
    sums = prefix(low)
    out = np.empty((1 + len(STEMS), len(starts)), np.int32)
    for i, n in enumerate((None, *STEMS)):
        stop = ends if n is None else np.minimum(starts + n, ends)
        out[i] = ((spans_hash(sums, starts, stop) ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)
    return out, np.searchsorted(starts, offs)


def text_features(text: str) -> np.ndarray:
    data, offs = flat(pa.array([text]))
    return np.unique(feature_places(data, offs)[0])


_GROUP_OF = {t: g for g in IDENTITY_TERMS for t in g}


def swaps(text: str, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sentence with identity terms: features that a swap takes out, and puts in.
    Of more than ``most`` sentences, those with the least crc32 are taken."""
    low = text.lower()
    if not any(t in low for t in _GROUP_OF):
        return []
    changed = []
    for sentence in low.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        words = sentence.split()
        other = [g[(g.index(b) + 1) % len(g)] if (g := _GROUP_OF.get(b := w.strip(",;:\"'()"))) else w for w in words]
        if other != words:
            changed.append((" ".join(words), " ".join(other)))
    if len(changed) > most:
        changed = sorted(changed, key=lambda c: (zlib.crc32(c[0].encode("utf-8", "surrogatepass")), c))[:most]
    pairs = [(text_features(x), text_features(y)) for x, y in changed]
    return [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in pairs]


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, pairs: list, place: np.ndarray, l1: float = 1e-4, swap: float = 1.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, intercept) by accelerated proximal gradient over the screened features ``place``."""
    if len(rows) == 0 or not 0 < labels.sum() < len(labels):
        rate = float(labels.mean()) if len(rows) else 0.5
        return np.zeros(0, np.int64), np.zeros(0), float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    n = len(rows)
    column = np.full(1 << BITS, -1, np.int64)
    column[place] = np.arange(len(place))

    def matrix(sets):
        cols = [column[x] for x in sets]
        cols = [c[c >= 0] for c in cols]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int64)

    r, c = matrix(rows)
    terms = [(text_features(a), text_features(b)) for g in IDENTITY_TERMS for a, b in zip(g, g[1:] + g[:1])]
    pairs = pairs + [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in terms]
    out_r, out_c = matrix([a for a, _ in pairs])
    in_r, in_c = matrix([b for _, b in pairs])
    d, p = len(place), len(pairs)
    share = weights / weights.sum()

    def gap(w):
        return np.bincount(in_r, w[in_c], p) - np.bincount(out_r, w[out_c], p)

    def curve(w):  # an upper bound of the Hessian, applied
        q = gap(w[1:]) * (2 * swap / p)
        h = share * (np.bincount(r, w[1:][c], n) + w[0]) / 4
        return np.concatenate(([h.sum()], np.bincount(c, h[r], d) + np.bincount(in_c, q[in_r], d) - np.bincount(out_c, q[out_r], d)))

    v = np.ones(d + 1)
    for _ in range(20):
        v = curve(v / np.linalg.norm(v))
    bound = float(np.linalg.norm(v)) * 1.05
    base = float((labels * share).sum())
    w = np.zeros(d + 1)
    w[0] = np.log(base / (1 - base))
    ahead, t = w, 1.0
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-np.clip(np.bincount(r, ahead[1:][c], n) + ahead[0], -40, 40))) - labels)
        q = gap(ahead[1:]) * (2 * swap / p)
        grad = np.concatenate(([g.sum()], np.bincount(c, g[r], d) + np.bincount(in_c, q[in_r], d) - np.bincount(out_c, q[out_r], d)))
        new = ahead - grad / bound
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - l1 / bound, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    kept = np.flatnonzero(w[1:])
    return place[kept], w[1:][kept], float(w[0])


class Model(NamedTuple):
    """Weights of feature places; ``fitted`` is false where labels of one class or none were there."""

    places: np.ndarray
    values: np.ndarray
    intercept: float
    fitted: bool

    def scores(self, texts: pa.Array) -> pa.Array:
        table = np.zeros(1 << BITS, np.float32)
        table[self.places] = self.values
        out = [np.zeros(0)]
        for a, b, raw, offs in chunks(texts, CHUNK):
            features, first = feature_places(raw, offs) if len(raw) else (np.zeros((1, 0), np.int32), np.zeros(b - a + 1, np.int64))
            kind, word = np.nonzero(table[features])
            text = np.searchsorted(first, word, "right") - 1
            each = np.unique(text.astype(np.int64) << BITS | features[kind, word])
            sums = np.bincount(each >> BITS, table[each & ((1 << BITS) - 1)], b - a) + self.intercept
            out.append(1 / (1 + np.exp(-np.clip(sums, -60, 60))))
        return pa.array(np.concatenate(out))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("bigint").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_toxic: int = 3000,
    most_clean: int = 6000,
    screen: float = 2.5,
    least: int = 4,
    most_swaps: int = 16,
) -> Model:
    """The model of the labelled rows that are not held out; see ``toxicity``."""
    known = (
        labels.where(~held_out(id_col))
        .select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label > 0").orderBy(*by_hash).limit(most_toxic).union(known.where("label <= 0").orderBy(*by_hash).limit(most_clean))
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            rows = []
            for x, y, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "label", "text"))):
                rows.append((x, y, 0, text_features(text), []))
                rows += [(x, y, 1, a, b) for a, b in swaps(text, most_swaps)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), ints, ints))], names=["doc_id", "label", "pair", "a", "b"])

    # The sample has at most most_toxic + most_clean rows of two numbers: safe to broadcast.
    # Of rows with one identifier that with the least hash is learnt from; maps combine them first.
    one = plain.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    with rows_per_batch(docs.sparkSession, TEXTS):
        gathered = staged(one.select("doc_id", "label", "least.text").mapInArrow(releasing(gather), "doc_id bigint, label int, pair int, a array<int>, b array<int>"))
    whole = gathered.where("pair = 0")
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") > 0).alias("n1")).first()
    n, n1 = size["n"], size["n1"]
    kept = np.zeros(0, np.int32)
    if 0 < n1 < n:
        # Screening: a feature's rates in the two classes, in standard errors apart.
        seen = whole.select("label", F.explode("a").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("label") > 0).alias("k1"))
        rate = F.col("k") / n
        error = F.sqrt(rate * (1 - rate) * (1 / n1 + 1 / (n - n1)))
        differ = F.abs(F.col("k1") / n1 - (F.col("k") - F.col("k1")) / (n - n1))
        # At most 2 ** BITS numbers, and those the sample's size allows.
        kept = np.array(sorted(r["f"] for r in seen.where((F.col("k") >= least) & (differ >= screen * error)).select("f").collect()), np.int32)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[kept] = True
        for batch in batches:
            parts = [[x[known[x]].astype("<i4").tobytes() for x in (np.asarray(v.values, np.int32) for v in batch[c])] for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], batch["pair"], *(pa.array(p, pa.binary()) for p in parts)], names=["doc_id", "label", "pair", "a", "b"])

    found = gathered.mapInArrow(pick, "doc_id bigint, label int, pair int, a binary, b binary").collect()
    discard(gathered)
    found.sort(key=lambda r: (r["doc_id"], r["pair"], bytes(r["a"]), bytes(r["b"])))
    decode = lambda x: np.frombuffer(bytes(x), "<i4")
    own = [r for r in found if not r["pair"]]
    y = np.array([r["label"] > 0 for r in own], float)
    counts = {1: max(y.sum(), 1), 0: max(len(y) - y.sum(), 1)}
    weights = np.array([totals[int(v)] / counts[int(v)] for v in y])
    fitted = bool(own) and 0 < y.sum() < len(y)
    return Model(*(fit([decode(r["a"]) for r in own], y, weights, [(decode(r["a"]), decode(r["b"])) for r in found if r["pair"]], kept) if own else (np.zeros(0, np.int64), np.zeros(0), 0.0)), fitted)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, score`` of every row; only these come back from Python."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], model.scores(batch["text"])], names=["doc_id", "text_hash", "score"])

    return plain.mapInArrow(releasing(score), "doc_id bigint, text_hash bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **how) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted, text_hash``.

    * A row is held out if crc32 of its identifier as text, modulo 4, is 2; such
      labels are never learnt from. Labels, languages, sources and identifiers
      are no features.
    * The model is fitted on the driver from a bounded sample, ``most_toxic`` and
      ``most_clean`` rows that come first by a hash of the identifier; only the
      features of their whole texts that pass the screening get there
      (``least`` sample rows or more, ``screen`` standard errors). One text an
      identifier is learnt from, that with the least hash, and at most
      ``most_swaps`` swapped sentences of it. Everything is scored.
    * Null or empty texts have no features and get the intercept's score; null
      labels aren't learnt from; of several labels of an identifier the largest
      counts. Null identifiers are never held out nor labelled. Without labels of
      both classes every score is the labels' rate (0.5 without any label). An empty table gives
      an empty result; repeated rows get equal scores. A very long text is held
      whole in a task. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, **how)
    found = scored(docs, model, id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
