"""Derived tables kept up by changes, against whole runs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lorebase.operators import derive as D
from lorebase.operators import entities as E
from lorebase.operators.classify import classify
from lorebase.operators.deltas import TABLES, Derived

SCHEMA = "id long, author string, text string, links array<string>"
PIECES = ["an agent with code", "Zed Tool", "GPT-4 model", "prompt", "Acme Corp", "quiet day", "robot", "Blue Whale", "data base"]
LINKS = ["https://github.com/o/r", "https://arxiv.org/abs/1234.5", "https://example.org/a", "https://example.org/b"]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def whole(spark, items):
    """The same tables from all items."""
    df = spark.createDataFrame(items, SCHEMA)
    labels = classify(df, links="links").select("id", "author", "primary", "confidence")
    found = E.extract(df, links="links")
    links = df.select("id", F.explode("links").alias("url"))
    members = D.clusters(labels, found)
    nodes, edges = D.graph(df, labels, found, links, members, D.project_ideas(members, found))
    sure = labels.where("confidence >= 0.4").join(found.select("id", F.lower("name").alias("name")).distinct(), "id").groupBy(F.col("primary").alias("category"), "name").count()
    return {"mentions": rows(E.mentions(found)), "clusters": rows(members), "nodes": rows(nodes), "edges": rows(edges), "counts": rows(labels.groupBy("primary").count()), "names": rows(sure)}


def test_changes_equal_whole_runs(spark, tmp_path):
    rng = random.Random(8)
    item = lambda i: (i, rng.choice(["ann", "bob", None]), rng.choice([None, ". ".join(rng.sample(PIECES, rng.randint(0, 4)))]), rng.choice([None, [], rng.sample(LINKS, 2), [LINKS[0]] * 2]))
    kept = Derived(spark, str(tmp_path / "d"))
    assert kept.mentions().count() == 0 and kept.clusters().count() == 0
    items, merged = {}, 0
    for n in range(6):
        old = dict(items)
        for i in rng.sample(range(60), 40 if n == 0 else 5):
            items[i] = item(i)
        for i in rng.sample(range(60), 2 if n else 0):
            items.pop(i, None)
        touched = [i for i in {*old, *items} if old.get(i) != items.get(i)]
        before, after = ([d[i] for i in touched if i in d] for d in (old, items))
        told = kept.apply(spark.createDataFrame(before, SCHEMA) if before else None, spark.createDataFrame(after, SCHEMA))
        merged += told["merged_rows"]
        assert told["rows"] <= 40 * max(1, len(touched))
        if n in (0, 5):
            want = whole(spark, list(items.values()))
            assert rows(kept.mentions()) == want["mentions"]
            assert rows(kept.category_counts()) == want["counts"]
            assert rows(kept.table("category_names")) == want["names"]
            assert rows(kept.clusters()) == want["clusters"]
            nodes, edges = kept.graph()
            assert rows(edges) == want["edges"] and rows(nodes) == want["nodes"]
            top = kept.top_names(2).collect()
            for c in {k[0] for k in want["names"]}:
                best = sorted((-m, name) for category, name, m in want["names"] if category == c)[:2]
                assert sorted((-r["n"], r["name"]) for r in top if r["category"] == c) == best
    assert merged and kept.vacuum() and rows(kept.mentions()) == want["mentions"]
    # everything taken away again: nothing is left, and no counts below 0
    kept.apply(spark.createDataFrame(list(items.values()), SCHEMA))
    assert all(kept.table(t).count() == 0 for t in TABLES)
