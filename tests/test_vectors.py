import numpy as np
from pyspark.sql import functions as F

from lorebase.operators.vectors import VectorIndex

SF = "/root/testdata/sf0.01"


def brute(rows, k):
    """The k nearest of every query, by numpy, from (id, vector) rows; queries are identifiers divisible by 50."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[at], 6)
        out[int(ids[at])] = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != at][:k]
    return out


def found(df):
    got = {}
    for r in df.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    return got


def test_recall_against_all_rows_and_the_exact_way(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = [(r["id"], r["vector"]) for r in v.collect()]
    want = brute(rows, 5)
    index = VectorIndex.build(v, str(tmp_path / "i"), len(rows[0][1]))
    q = v.where("id % 50 = 0")
    exact, fast = found(VectorIndex(spark, str(tmp_path / "i")).search(q, 5)), found(index.search(q, 5, 24, exact=False))
    share = lambda got: np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])
    print("recall", share(fast), "exact", share(exact))
    assert share(exact) == 1.0 and share(fast) > 0.5


def test_odd_vectors_and_an_empty_table(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, [float("inf"), 0.0]), (2, [2.0, 0.0]), (10, [])]
    d = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("list", F.lit("clash"))
    index = VectorIndex.build(d, str(tmp_path / "i"), 2, lists=2)
    assert index.spark.read.parquet(str(tmp_path / "i" / "rows")).count() == len(rows)
    got = [(r["id"], r["other"], r["similarity"], r["rank"]) for r in index.search(d.where("id = 1 OR id > 3"), 2).collect()]
    assert sorted(got) == [(1, 2, 1.0, 1), (1, 2, 1.0, 2)]
    empty = VectorIndex.build(d.limit(0), str(tmp_path / "e"), 2)
    assert empty.search(d).collect() == []


def test_lists_that_can_hold_nothing_nearer_stay_closed(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12 if i % 3 else 0] + 0.05 * rng.normal(size=16)]) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, vector array<double>")
    index = VectorIndex.build(d, str(tmp_path / "i"), 16, lists=12)
    q = d.where("id % 50 = 0")
    assert found(index.search(q, 5, 1)) == brute(rows, 5)


def test_a_list_of_very_many_rows_is_dealt_to_several_cells_and_pairs_are_no_rows(spark, tmp_path, monkeypatch):
    from lorebase.operators import vectors as V

    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 8 if i % 4 else [float(x) for x in rng.normal(size=8)]) for i in range(800)]
    d = spark.createDataFrame(rows, "id long, vector array<double>")
    index = VectorIndex.build(d, str(tmp_path / "i"), 8, lists=4)
    monkeypatch.setattr(V, "CELL_ROWS", 100)
    near = index.search(d.where("id % 50 = 0"))
    assert found(near) == brute(rows, 5)
    plan = index.search(d.where("id % 50 = 0"), exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
