"""The index that is kept up, many patterns at once, and the audit of files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorebase.functions import patterns
from lorebase.functions.taxonomy import Taxonomy
from lorebase.operators import classify as C
from lorebase.operators import kept_index
from lorebase.operators.kept_index import KeptIndex, may_hold, merge_from
from lorebase.operators.search import matching
from lorebase.sources import audit

SF = "/root/testdata/sf0.001"
ASKED = ["red", "red NOT blue", '"red blue"', "gr*", 'author:ann AND ("blue red" OR zeb*)', "nowhere", "text:ann OR a*"]


def test_index_equals_rows_after_random_rounds(spark, tmp_path):
    rng = random.Random(4)
    words = ["red", "blue", "green", "grey", "zebra", "ann", "Été", "x1"]
    text = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    kept = KeptIndex(spark, str(tmp_path / "i"), "text", "author")
    assert [r["id"] for r in kept.lookup("red").collect()] == []
    rows, merged, most = {}, 0, 0
    schema = "id long, text string, author string"
    for n in range(20):
        new = {i: (i, text(), rng.choice(["ann", "bob", None])) for i in rng.sample(range(120), 60 if n == 0 else rng.randint(0, 6))}
        gone = rng.sample(range(120), rng.randint(0, 4))
        for i in gone:
            rows.pop(i, None)
        rows |= new
        told = kept.apply(spark.createDataFrame([*new.values(), (None, "red", "ann")], schema), spark.createDataFrame([(i,) for i in gone], "id long"))
        merged, most = merged + told["merged_rows"], max(most, told["segments"])
        assert told["version"] == n + 1
        items = spark.createDataFrame(list(rows.values()), schema).cache()
        for expression in ASKED if n == 19 else ASKED[n % len(ASKED) :][:1]:
            got = sorted(r["id"] for r in kept.lookup(expression).collect())
            assert got == sorted(r["id"] for r in matching(items, expression, "text", "author").select("id").collect()), (n, expression)
        items.unpersist()
    assert merged and most <= 8
    kept.vacuum()
    assert sorted(r["id"] for r in kept.lookup("red").collect()) == sorted(r["id"] for r in matching(spark.createDataFrame(list(rows.values()), schema), "red", "text", "author").select("id").collect())
    assert len(kept._versions()) == 1


def test_small_change_writes_little(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    kept = KeptIndex(spark, str(tmp_path / "i"), "text")
    whole = kept.apply(docs)
    edit = docs.where("id % 100 = 1").withColumn("text", F.concat("text", F.lit(" zzyzx")))
    told = kept.apply(edit, docs.where("id % 100 = 2").select("id"))
    share = edit.selectExpr("sum(length(text))").first()[0] / docs.selectExpr("sum(length(text))").first()[0]
    assert 0 < told["rows"] <= 2 * share * whole["rows"] and not told["merged_rows"]
    assert sorted(r["id"] for r in kept.lookup("zzyzx").collect()) == sorted(r["id"] for r in edit.select("id").collect())
    # two writers of one version: the second one fails, and nothing of it is seen
    before = kept.manifest()
    kept._commit(before, before["segments"])
    with pytest.raises(Exception, match="exist"):
        kept._commit(before, [])
    assert kept.manifest()["segments"] == before["segments"]


def test_word_directory():
    for word, prefix in (("b", False), ("b", True), ("bc", True), ("a", True), ("zz", True), ("bz", False)):
        for files in ([("a", "b"), ("b", "bca"), ("bcb", "c"), ("d", "zz1")],):
            for first, last in files:
                words = [w for w in ("a", "aa", "b", "bb", "bc", "bca", "bcb", "bz", "c", "d", "zz", "zz1") if first <= w <= last]
                holds = any(w.startswith(word) if prefix else w == word for w in words)
                assert may_hold(first, last, word, prefix) or not holds
    assert not may_hold("b", "c", "d", True) and not may_hold("bc", "bd", "bb", True) and may_hold("bca", "c", "bc", True)


def test_merges_are_by_size():
    sizes, written, batches = [], 0, 500
    for _ in range(batches):
        sizes.append(10)
        written += 10
        while (start := merge_from(sizes)) is not None:
            written += sum(sizes[start:])
            sizes[start:] = [sum(sizes[start:])]
        assert len(sizes) <= 14
    assert written <= 10 * batches * 10
    assert merge_from([1000, 10, 10, 10]) is None and merge_from([10] * 4) == 0


def test_many_patterns(spark):
    rng = random.Random(1)
    strings = tuple(["a", "ab", "ab", "", "é ü", "xyz", "日本", "b a"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(60)])
    texts = ["", "ab", "aéb é ü", "日本語 xyz", *("".join(rng.choice("abcé ü") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    assert patterns.places_held(texts, strings) == [[i for i, s in enumerate(strings) if s in t] for t in texts]
    assert patterns.places_held(["x"], ()) == [[]]
    got = C.classify(spark.createDataFrame([(1, None), (2, ""), (3, "An AGENT and an agent write Code")], "id long, text string")).collect()
    assert [r["primary"] for r in got] == ["misc", "misc", "ai-agents"]
    assert got[2]["labels"][0]["rationale"] == "keyword:agent"


def test_keywords_cost_little():
    rng = random.Random(2)
    many = tuple({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 12))) for _ in range(10_000)})
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(400)]
    took = []
    for own in (many[:100], many):
        patterns.places_held(["warm"], own)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            patterns.places_held(texts, own)
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 3 * took[0]
    large = Taxonomy.of_rows([("coding", k) for k in many])
    assert len(large.weights()) == len(many)


def test_audit_of_files(spark, tmp_path):
    files = {
        "src/a.py": "ok\n  api_key = 'abcdefghijkl0123'  \r\nlast /home/me/x",
        "notes.txt": "x" * 10 + " /Users/me " + "y" * 300 + "\n\u2028C:\\Users\\you\n",
        "data/.gitkeep": "/home/allowed/x",
        "data/raw.json": "token = 'abcdefghijkl0123'",
        "deep/er/my.db": "x",
        "near.txt": "password = 'short'\nhomeward/home",
        "empty.txt": "",
    }
    for n, t in files.items():
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(t)
    (tmp_path / "b.bin").write_bytes(b"x\0/home/me/y")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe /home/me/z\n")
    got = {(r["path"], r["line"], r["rule"], r["snippet"]) for r in audit.audit_files(spark, str(tmp_path)).collect()}
    home, secret, name = "absolute-user-home-path", "secret-assignment", "tracked-runtime-artifact"
    assert got == {
        ("src/a.py", 2, secret, "api_key = 'abcdefghijkl0123'"),
        ("src/a.py", 3, home, "last /home/me/x"),
        ("notes.txt", 1, home, ("x" * 10 + " /Users/me " + "y" * 300)[:160]),
        ("notes.txt", 3, home, "C:\\Users\\you"),
        ("data/raw.json", None, name, ""),
        ("deep/er/my.db", None, name, ""),
        ("bad.txt", 1, home, "\ufffd\ufffd /home/me/z"),
    }


def test_postings_are_made_within_rows_and_not_by_a_shuffle(spark):
    from lorebase.operators.search import index

    rows = [(1, "A b a", "x"), (2, None, "b"), (3, "Ünï-code  b!", ""), (1, "a", "y")]
    found = index(spark.createDataFrame(rows, "id long, t string, u string"), "t", "u")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["token"], r["id"], r["column"], r["places"]) for r in found.collect())
    assert got == sorted([("a", 1, "t", [0, 2]), ("b", 1, "t", [1]), ("x", 1, "u", [0]), ("b", 2, "u", [0]), ("uni", 3, "t", [0]), ("code", 3, "t", [1]), ("b", 3, "t", [2]), ("a", 1, "t", [0]), ("y", 1, "u", [0])])
