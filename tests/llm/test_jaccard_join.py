import random
import re

import numpy as np
import pytest

from lorebase.llm.jaccard_join import Counts, head, ngram_jaccard, reaches


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(seed, words=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    texts = [None, "", " \n", "one", "One", "two words", "two words three"]
    passage = [word() for _ in range(50)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(3, words))]
        if r.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    big = [word() for _ in range(words)]
    for _ in range(130):  # many near copies of one text, linked over others
        own = list(big)
        for _ in range(r.randint(1, 5)):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own).upper() if r.random() < 0.1 else " ".join(own))
    r.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, texts[0])]


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_against_brute_force(spark, words, percent, seed):
    rows = corpus(seed)
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, words, percent)


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (None, None, 3)], "doc_id long, text string, set int")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_jaccard(docs, words=3, percent=90).collect())
    assert got == [(-1, 0, -1), (-1, 2, 5), (5, 2, 5)]
    assert ngram_jaccard(docs.limit(0), words=3, percent=90).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_sets_on_the_threshold_share_a_token_of_their_heads(percent):
    r = np.random.default_rng(percent)
    pairs = [(a, b, o) for a in range(1, 31) for b in range(a, 41) for o in range(a + 1) if (a, b) != (o, o) and 100 * o >= percent * (a + b - o) and 100 * (o - 1) < percent * (a + b - o + 1)]
    for a, b, o in pairs * max(1, 4000 // len(pairs)):
        t = r.integers(0, 1 << 63, a + b - o, np.int64).astype(np.uint64)
        x, y = np.sort(t[:a]), np.sort(t[a - o :])
        frequent = np.sort(r.choice(t, r.integers(0, len(t) + 1), replace=False))
        rank = r.permutation(len(frequent))
        assert len(np.intersect1d(head(x, percent, frequent, rank), head(y, percent, frequent, rank))), (a, b, o)
        assert reaches(x, y, max(a, b), percent)


def test_counts_keep_the_most_frequent(monkeypatch):
    from lorebase.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "COUNTED", 1000)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    counts, r = Counts(), np.random.default_rng(1)
    for i in range(300):
        own = np.concatenate((np.arange(5, dtype=np.uint64), r.integers(10, 1 << 60, 20).astype(np.uint64)))
        counts.add([own])
    counts.close()
    assert len(counts.tokens) <= 8 and dict(zip(counts.tokens.tolist(), counts.counts.tolist())).items() >= {i: 300 for i in range(5)}.items()


@pytest.mark.parametrize("words,percent", [(5, 80), (3, 90)])
def test_short_texts_on_the_threshold(spark, words, percent):
    rows = []
    for i in range(400):  # texts of words of their own, and each with words more at its end
        n = (4 if percent == 80 else 9) * (1 + i % 3)
        own = [f"w{i}x{j}" for j in range(n + words - 1 + 1 + i % 3)]
        rows += [(2 * i, " ".join(own[: n + words - 1])), (2 * i + 1, " ".join(own))]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got}
    assert found == {(d, len(t.split()) - words + 1, d - d % 2) for d, t in rows}


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_several_tokens_of_their_heads(percent):
    r = np.random.default_rng(percent)
    for a in range(20, 400, 7):
        for b in {a, a + a // 20, 100 * a // percent}:
            o = -(-percent * (a + b) // (100 + percent))
            if not b <= 100 * o // percent or o > a:
                continue
            t = r.integers(0, 1 << 63, a + b - o, np.int64).astype(np.uint64)
            x, y = np.sort(t[:a]), np.sort(t[a - o :])
            frequent = np.sort(r.choice(t, r.integers(0, len(t) + 1), replace=False))
            heads = [head(z, percent, frequent, np.random.default_rng(1).permutation(len(frequent))) for z in (x, y)]
            asks = max(0, (a - percent * b / 100) * percent / (100 + percent)) + min(percent * a // 1600, 7)
            assert len(np.intersect1d(*heads)) >= max(asks, 1 + min(percent * a // 1600, 7)), (a, b, o)


@pytest.mark.parametrize("frequent", [0, 1 << 19])
def test_long_texts_on_the_threshold(spark, monkeypatch, frequent):
    from lorebase.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rows = []
    for i in range(60):  # sets of 9 * (i + 1) shingles, and each with those that make it 10 * (i + 1)
        own = [f"w{i}x{j}" for j in range(10 * (i + 1) + 2)]
        rows += [(2 * i, " ".join(own[: 9 * (i + 1) + 2])), (2 * i + 1, " ".join(own))]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(d, len(t.split()) - 2, d - d % 2) for d, t in rows}


def test_texts_that_share_few_tokens_do_not_travel(spark, monkeypatch):
    from lorebase.llm import jaccard_join

    travelled, staged = [], jaccard_join.staged

    def counting(df, keep=False):
        out = staged(df, keep)
        if {"text", "home"} <= set(out.columns):
            travelled.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)  # as if no repeated token were known
    monkeypatch.setattr(jaccard_join, "staged", counting)
    rows = []
    for i in range(60):  # pairs of texts with one passage of 30 words in common, which is a few tokens of their heads
        passage = [f"p{i}x{j}" for j in range(30)]
        rows += [(2 * i + k, " ".join([f"w{i}x{k}x{j}" for j in range(270)] + passage)) for k in (0, 1)]
    for i in range(5):
        own = [f"near{i}x{j}" for j in range(300)]
        rows += [(1000 + 2 * i, " ".join(own)), (1001 + 2 * i, " ".join([*own[:-1], "other"]))]
    got = ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 90)
    assert travelled == [10]
