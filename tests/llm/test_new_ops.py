"""Best-two-fit packing, source divergence and whitening against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from lorebase.llm import divergence, whitening
from lorebase.llm.divergence import source_divergence
from lorebase.llm.queries import OP12_SQL, op11_two_fit_packing, op12_source_divergence, op13_jacobi_whitening
from lorebase.llm.tokens import encoder
from lorebase.llm.two_fit import best_two_fit, fill
from lorebase.llm.whitening import jacobi_svd, packed, unpacked, whiten

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_two_fit(sizes, limit):
    """The method, by trying everything."""
    left, out = sorted(sizes, reverse=True), []
    while left:
        own = []
        for x in list(left):
            if sum(own) + x <= limit:
                own.append(x)
                left.remove(x)
        if len(own) > 1:
            gap = limit - sum(own) + own[-1]
            pairs = [(a + b, b, a) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= gap]
            if pairs:
                _, b, a = max(pairs)
                left.append(own.pop())
                left.sort(reverse=True)
                left.remove(a)
                left.remove(b)
                own += [a, b]
        out.append(own)
    return out


def test_fill_is_best_two_fit():
    rng = random.Random(3)
    for limit in (1, 7, 40, 100):
        for _ in range(30):
            sizes = [rng.randint(1, limit) for _ in range(rng.randint(0, 40))]
            got = list(fill(np.array(sizes, np.int64), limit))
            assert sorted(i for own in got for i in own) == list(range(len(sizes)))
            by_size = [sorted(sizes[i] for i in own) for own in got]
            theirs = [sorted(x) for x in plain_two_fit(sizes, limit)]
            assert [sum(x) for x in by_size] == [sum(x) for x in theirs]
    # the pair takes the smallest one's place: 6 + 3 leaves 1, 6 + 2 + 2 none
    assert [sum(x) for x in ([([6, 3, 2, 2][i]) for i in own] for own in fill(np.array([6, 3, 2, 2]), 10))] == [10, 3]


def check_packing(rows, texts, tokens):
    """texts: (doc_id, text) of each row; identifiers may be repeated."""
    want = Counter()
    for i, t in texts:
        ids = ids_of(t)
        for n, start in enumerate(range(0, len(ids), tokens)):
            own = ids[start : start + tokens]
            want[i, n, start, len(own), crc(own)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens
    return places


def test_two_fit_rounds(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["ab", "cde", "x1", "naïve", "it's"]) for _ in range(rng.choice([1, 3, 10, 30, 150])))) for i in range(400)]
    texts += [(None, None), (7, ""), (7, ""), (None, "word"), (9, "long " * 3000)] + [(5, "the same")] * 60
    docs = spark.createDataFrame([(*x, "clash", 1) for x in texts], "doc_id long, text string, piece string, nth int").repartition(6)
    for window, block in ((1 << 15, 1 << 14), (16, 20)):
        rows = best_two_fit(docs, TOKENIZER, tokens=64, window=window, block=block).collect()
        places = check_packing(rows, texts, 64)
        total = sum(r["length"] for r in rows)
        assert len(places) <= 1.03 * -(-total // 64) + (1 if window > 16 else 6)
        for r in rows:
            assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
    again = best_two_fit(docs, TOKENIZER, tokens=64, window=16, block=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert best_two_fit(docs.limit(0), TOKENIZER).count() == 0
    # pieces of more than half a sequence never close early, and rounds end
    rows = best_two_fit(spark.createDataFrame([(i, "a1 " * 20) for i in range(300)], "doc_id long, text string"), TOKENIZER, tokens=64, block=10).collect()
    assert len({r["sequence_id"] for r in rows}) == 300


def test_two_fit_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    places = check_packing(op11_two_fit_packing(spark, SF).collect(), docs, 4096)
    total = sum(n for own in places.values() for _, n in own)
    assert len(places) <= -(-total // 4096) + 1


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_divergence(rows, least, top=200):
    """rows: (lang, source, text)."""
    docs = [(a or "", b or "", TERM.findall((t or "").translate(LOWER))) for a, b, t in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        df, total = Counter(), Counter()
        counts = {b: Counter() for a, b, _ in docs if a == lang}
        for a, b, terms in docs:
            if a == lang:
                df.update(set(terms))
                total.update(terms)
                counts[b].update(terms)
        kept = {t for t, n in df.items() if n >= least}
        n_of = lambda c: sum(c[t] for t in kept)
        p = {b: {t: 1 + 10**9 * (c[t] + 1) // (n_of(c) + len(kept)) for t in kept} for b, c in counts.items()}
        q = {t: 1 + 10**9 * (total[t] + 1) // (n_of(total) + len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for b in counts:
            pair = [(-sum(f(p[b][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != b]
            term = [(-f(p[b][t], q[t]), t.encode(), t) for t in kept if counts[b][t] and p[b][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, b, part, x, -v, i + 1) for i, (v, _, x) in enumerate(found)]
    return sorted(out)


def told(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_divergence_against_plain(spark, monkeypatch):
    rng = random.Random(7)
    words = ["Ab", "ab", "cd", "ÉÉ", "éé", "日本", "x", "it", "zz9zz", "İi", "w" * 300, "w" * 301]
    rows = [(rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", None, "S"]), " ".join(rng.choice(words[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 30)))) for _ in range(150)]
    rows += [("en", "none", None), ("en", "none", "12 34"), ("one", "alone", "a a a"), ("one", "alone", "a b"), ("one", "alone", "b-a"), ("empty", "x", ""), ("empty", "y", None)]
    rows += [("fr", "hot", "le la les")] * 50 + [("fr", "cold", "le " * 30000 + "\x00fin")]
    docs = spark.createDataFrame([(*x, 1, "clash") for x in rows], "lang string, source string, text string, count int, term string").repartition(5)
    want = plain_divergence(rows, 3)
    assert told(source_divergence(docs)) == want
    assert told(source_divergence(docs, least=2, top=2)) == plain_divergence(rows, 2, 2)
    # a sketch so narrow that it rules nothing out, and tasks that hand counts on early
    monkeypatch.setattr(divergence, "HELD", 4)
    monkeypatch.setattr(divergence, "NARROW", 16)
    monkeypatch.setattr(divergence, "WIDE", 16)
    assert told(source_divergence(docs)) == want
    assert source_divergence(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark):
    docs = spark.createDataFrame([("en", "s", f"all t{'abcdefghij'[i % 10]} {'xyz' * (i + 1)}") for i in range(30)], "lang string, source string, text string").repartition(4)
    bits = divergence.document_sketch(docs, 1 << 16, 3)
    counted = divergence.surviving_counts(docs, bits, 1 << 16).collect()
    terms = Counter()
    for r in counted:
        terms[r["term"]] += r["docs"]
    assert terms["all"] == 30 and all(terms["t" + c] == 3 for c in "abcdefghij")
    assert len(terms) == 11  # terms of one document never travel


def test_divergence_query_and_sql(spark):
    got = told(op12_source_divergence(spark, SF))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()]
    assert got == plain_divergence(rows, 3)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.sql(f"SELECT lang, source, part, item, value, rank FROM ({OP12_SQL})").fetchall()
    assert sorted(theirs) == got


def test_jacobi_svd():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (5, 5), (20, 20)):
        a = rng.normal(size=shape) * np.logspace(0, -9, shape[1])
        s, v = jacobi_svd(np.linalg.qr(a)[1])
        assert np.allclose(s, np.linalg.svd(a)[1], rtol=1e-12)
        assert np.abs(v.T @ v - np.eye(shape[1])).max() < 1e-13
        assert np.allclose(np.linalg.norm(a @ v, axis=0), s, rtol=1e-10)
    assert not jacobi_svd(np.zeros((3, 3)))[0].any()


def plain_whitening(vectors, components=16):
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in vectors}
    distinct = sorted({tuple(v) for v in x.values()})
    n, total = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, total)] for v in distinct])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = {}
    for i, own in x.items():
        c = np.array([(n * a - s) / n for a, s in zip(own, total)])
        for k in range(min(components, len(e))):
            if e[k] > 1e-9 * e[0]:
                out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(own, total)), c @ v[:, k] / np.sqrt(e[k]), e[k] / e.sum())
    return out


def same_whitening(rows, want):
    assert Counter((r["vec_id"], r["component"]) for r in rows) == Counter(dict.fromkeys(want, 1))
    turn = {}
    for r in rows:
        n, deviation, w, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(share, rel=1e-9) and 0 <= r["identity_error"] < 1e-9
        if abs(w) > 1e-3:
            assert abs(r["whitened"]) == pytest.approx(abs(w), rel=1e-5, abs=1e-6)
            assert turn.setdefault(r["component"], np.sign(w * r["whitened"])) == np.sign(w * r["whitened"])


def test_whitening_query(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(op13_jacobi_whitening(spark, SF).collect(), plain_whitening(vectors))


def test_whitening_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(200)] + [(500, [1e3, -1e3, 0.0, 0.1, -0.1])]
    good += [(i, good[0][1]) for i in range(300, 400)]
    bad = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1.0] * 4)]
    schema = "vec_id long, embedding array<double>, dim string"
    rows = spark.createDataFrame([(*x, "clash") for x in good + bad], schema).repartition(9)
    got = whiten(rows).collect()
    same_whitening(got, plain_whitening(good))
    # repeated and missing identifiers; components asked for
    twice = whiten(rows.union(spark.createDataFrame([(None, good[3][1], ""), (0, good[0][1], "")], schema)), components=2).collect()
    assert Counter(r["vec_id"] for r in twice if r["vec_id"] in (None, 0)) == {None: 2, 0: 4}
    # no variance, no rows, huge entries
    for own in ([(1, [2.0, 3.0])] * 3, [(1, None)], []):
        assert whiten(spark.createDataFrame(own, "vec_id long, embedding array<double>")).count() == 0
    huge = whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge if r["component"] == 1}[1] is None and len(huge) == 6
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert {r["component"] for r in line} == {1} and all(r["explained"] == pytest.approx(1) for r in line)


def test_packed_vectors():
    import pyarrow as pa

    rows = [np.array([1, -2, 3]), np.array([1 << 40, 0, -5])]
    assert unpacked(pa.array([packed(x) for x in rows], pa.binary()), 3).tolist() == [x.tolist() for x in rows]


def test_shared_folder_where_none_is_set(spark):
    from types import SimpleNamespace

    from lorebase.llm.common import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("yarn", "hdfs://x/y/")).startswith("hdfs://x/y/lorebase-")
    a, b = shared_dir(session("local[2]", None)), shared_dir(session("local", ""))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] and a.startswith("file:///")
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[2,1,1024]", None))
