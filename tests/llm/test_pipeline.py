"""The pipeline against brute force on a small corpus."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorebase.llm.common import staged
from lorebase.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    rows, labels = [], []

    def add(text, source="s"):
        rows.append((len(rows), text, "en", source, len(text or "")))
        return rows[-1][0]

    for _ in range(260):
        words = [word() for _ in range(r.randint(8, 90))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(("idiot", "moron"))
        labels.append((add(" ".join(words), r.choice("abc")), 1, int(toxic)))
    base = [word() for _ in range(100)]
    for k in range(30):
        own = list(base)
        for _ in range(k % 3):
            own[r.randrange(len(own))] = word()
        add(" ".join(own), "a")
    for t in (None, "", "", "same text here", "same text here"):
        add(t, None)
    rows.append(rows[-1])  # a row repeated in full
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, dict((i, t) for i, _, t in labels)


def test_stages(spark, corpus):
    d, rows, toxic = corpus
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    # Columns of names that stages or operators use; their values have to come through.
    clashing = ("score", "predicted", "held_out", "key", "kept", "__key", "__stage_id", "__position", "size", "target", "taken", "row", "text_hash")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in clashing}).withColumn("extra", F.array(F.col("doc_id")))
    columns = docs.columns

    def run(name, frame):
        out = staged(stages[name](spark, frame, d))
        assert out.columns == columns
        rows = out.collect()
        assert all(x[c] == f"{c} {x['doc_id']}" for x in rows for c in clashing) and all(x["extra"] == [x["doc_id"]] for x in rows)
        return out, rows

    clean, got = run("toxicity", docs)
    kept = Counter(x["doc_id"] for x in got)
    wrong = sum((i in kept) == bool(t) for i, t in toxic.items())
    assert wrong <= 0.03 * len(toxic) and all(kept[x[0]] for x in rows if x[0] not in toxic)

    distinct, got2 = run("exact_dedup", clean)
    last = {}
    for x in got:
        t = x["text"] or ""
        last[t] = max(last.get(t, -1), x["doc_id"])
    assert sorted(x["doc_id"] for x in got2) == sorted(last.values())

    near, got3 = run("ngram_jaccard_join", distinct)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {x["doc_id"]: shingles(x["text"]) for x in got2}
    ids, parent = sorted(sets), {}
    root = lambda i: i if parent.get(i, i) == i else root(parent[i])
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(x["doc_id"] for x in got3) == [i for i in ids if root(i) == i]

    mixed, got4 = run("mix_sources", near)
    times, size, weigh = Counter(x["doc_id"] for x in got4), defaultdict(int), defaultdict(int)
    for x in got3:
        n = len((x["text"] or "").split())
        size[x["source"]] += n
        weigh[x["source"]] += n * times[x["doc_id"]]
        assert times[x["doc_id"]] <= 2 and (n or times[x["doc_id"]] == 1)
    assert abs(sum(weigh.values()) - 1.5 * sum(size.values())) <= 100 * len(size)

    pieces = stages["packing"](spark, mixed, d).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    e = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    for x in got3:
        assert tokens[x["doc_id"]] == times[x["doc_id"]] * (len(e.encode(x["text"] or "", add_special_tokens=False).ids) + 1)


def test_run_and_empty_tables(spark, corpus, tmp_path):
    d, _, _ = corpus
    out = corpus_pipeline.run(spark, d)
    assert out.where("offset = 0").count() == out.select("sequence_id").distinct().count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_model_drops_nothing(spark, corpus, tmp_path):
    d, rows, _ = corpus
    stage = dict(corpus_pipeline.STAGES)["toxicity"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, labels in (("none", []), ("one", [(1, 1, 1)]), ("null", [(1, 1, None), (None, 1, 1)])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert stage(spark, docs, f"{tmp_path}/{name}").count() == len(rows)


def test_rows_that_share_an_identifier_go_their_own_ways(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    base = " ".join(f"w{i}" for i in range(60))
    near = base + " end"
    rows = [(1, base, "a"), (1, "quite other words that nothing else here has", "a"), (2, near, "a"), (2, "different words again of which there are no copies", "b"), (None, near + " x", "a"), (None, "no identifier and no copy of these words either", None), (3, None, "a"), (3, "", "b"), (None, base, "a"), (4, base, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    copies = [(r["doc_id"], r["text"]) for r in stages["exact_dedup"](spark, docs, "").collect()]
    assert len(copies) == 7 and (4, base) in copies and (1, base) not in copies and len([t for _, t in copies if not t]) == 1
    left = staged(stages["ngram_jaccard_join"](spark, staged(stages["exact_dedup"](spark, docs, "")), "")).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in left) == sorted([(1, "quite"), (2, near[:5]), (2, "diffe"), (0, "no id"), (3, "")])
    mixed = stages["mix_sources"](spark, docs, "").collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} >= {(3, None), (3, "")} and all(r["source"] in ("a", "b", None) for r in mixed)
    assert sum(len((r["text"] or "").split()) for r in mixed) == pytest.approx(1.5 * sum(len((t or "").split()) for _, t, _ in rows), abs=130)


def test_two_runs_in_one_driver(spark, corpus):
    d, _, _ = corpus
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first, second = stages[1](spark, docs, d), stages[1](spark, docs, d)
    third = stages[2](spark, staged(second), d)
    assert first.count() == staged(second).count() >= third.count()
