import hashlib
import random
from collections import defaultdict

import pytest

from lorebase.llm import suffix_dedup


def brute(texts, width):
    data = [(t or "").encode() for t in texts]
    starts = defaultdict(list)
    for n, x in enumerate(data):
        for i in range(len(x) - width + 1):
            starts[x[i : i + width]].append((n, i))
    keep = [bytearray(b"\1" * len(x)) for x in data]
    for places in starts.values():
        if len(places) > 1:
            for n, i in places:
                keep[n][i : i + width] = b"\0" * width
    out = []
    for x, k in zip(data, keep):
        kept = bytes(b for b, z in zip(x, k) if z)
        runs = sum(1 for i in range(len(k)) if not k[i] and (i == 0 or k[i - 1]))
        out.append((len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = [None, "", "ab" * 400, "x" * 199, "x" * 199, "y" * 200, "y" * 200, "z" * 201, "z" * 5000]
    for _ in range(60):
        t = prose(r.randint(5, 200))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            cut = r.randint(0, len(t))
            t = t[:cut] + p[a : a + r.randint(150, 400)] + t[cut:]
        texts.append(t)
        if r.random() < 0.3:
            words = t.split()
            words[r.randrange(len(words))] = word()
            texts.append(" ".join(words))
    return texts + [texts[20], texts[21]]


@pytest.mark.parametrize("seed,cells", [(256, (25, 5, 1)), (2, (1,)), (3, (60, 7, 2, 1))])
def test_against_brute_force(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(suffix_dedup, "CELLS", cells)
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, want in enumerate(brute(texts, 200)):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"]


def test_repeated_rows_nulls_and_other_columns(spark):
    t = " ".join(str(i * 7919) for i in range(100))
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (None, t + "x", "c"), (2, None, None)], "doc_id long, text string, key string")
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeated_substrings(docs).collect())
    n = len(t)
    assert got == [(-1, n + 1, n), (1, n, n), (1, n, n), (2, 0, 0)]
    assert suffix_dedup.repeated_substrings(docs.limit(0)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    import numpy as np

    data = np.frombuffer(" ".join(str(i * i) for i in range(3000)).encode(), np.uint8)
    whole = suffix_dedup.stretches(data, 200)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    cut = suffix_dedup.stretches(data, 200)
    for _, _, at, span in (whole, cut):
        first, last = at - (span >> suffix_dedup.SPAN), at - (span & ((1 << suffix_dedup.SPAN) - 1))
        assert first[0] == 0 and last[-1] == len(data) - 200
        assert (first[1:] == last[:-1] + 1).all()
    assert set(whole[0].tolist()) == set(cut[0].tolist())
