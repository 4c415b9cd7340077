import random
import re
from collections import Counter

from lorebase.operators import grams as G

SF = "/root/testdata/sf0.001"


def brute(texts, widths, k):
    out = []
    for w in widths:
        n = Counter()
        for t in texts:
            own = re.findall("[a-z]+", (t or "").lower())
            n.update(" ".join(own[i : i + w]) for i in range(len(own) - w + 1))
        out += [(w, g, c) for g, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return sorted(out)


def test_the_most_frequent_runs_are_exact_however_few_counters_there_are(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [None, "", "one", "One two", "one twò three", "a" * 3000, "x y z " * 500] + [" ".join(rnd.choice(["aa", "Bb", "c", "dd-e", "É f"]) for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += ["end", "start end"] * 3
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = lambda k: sorted((r["width"], r["gram"], r["n"]) for r in G.top_grams(d, "text", (2, 3), k).collect())
    assert got(7) == brute(texts, (2, 3), 7)
    monkeypatch.setattr(G, "CHUNK", 64)
    assert got(100_000) == brute(texts, (2, 3), 100_000)
    assert G.top_grams(d.limit(0), "text", (2,), 5).count() == 0


def test_runs_below_what_is_reached_for_certain_are_no_rows(spark):
    d = spark.createDataFrame([("often seen " * 50 + f"w{'a' * (i % 97)} rare{'b' * i}",) for i in range(200)], "text string").repartition(4)
    found = G.top_grams(d, "text", (2,), 2)
    assert [(r["gram"], r["n"]) for r in found.orderBy("gram").collect()] == [("often seen", 10_000), ("seen often", 9_800)]
