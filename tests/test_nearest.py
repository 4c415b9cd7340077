import numpy as np
from pyspark.sql import functions as F

from lorebase.operators import nearest as B
from lorebase.plans.catalogue import QUERIES


def brute(rows, k):
    """By numpy, from (id, vector, tag) rows of one length: (id, other, tag, rank), queries divisible by 50."""
    x = np.array([v for _, v, _ in rows])
    norms = np.linalg.norm(x, axis=1)
    out = []
    for at, (i, _, _) in enumerate(rows):
        if i % 50 == 0:
            s = np.round(np.divide(x @ x[at], norms * norms[at], out=np.zeros(len(x)), where=norms * norms[at] > 0), 6)
            near = [j for j in np.lexsort(([r[0] for r in rows], -s)) if rows[j][0] != i][:k]
            out += [(i, rows[j][0], rows[j][2], n + 1) for n, j in enumerate(near)]
    return sorted(out)


def test_every_query_meets_every_row_in_any_number_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (np.ones(8) if i % 7 == 0 else np.zeros(8) if i % 11 == 0 else rng.normal(size=8))], i % 3) for i in range(1500)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, tag long")
    for n in (1 << 14, 7):  # queries of a cell
        monkeypatch.setattr(B, "CELL_QUERIES", n)
        got = sorted((r["id"], r["other"], r["tag"], r["rank"]) for r in B.against_all(v.where("id % 50 = 0"), v, 5).collect())
        assert got == brute(rows, 5)


def test_odd_vectors_have_no_similarity_and_those_that_are_no_number_come_first(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], None), (2, [1.0], 2), (3, None, 3), (4, [None, 1.0], 4), (5, [float("nan"), 1.0], 5), (6, [-1.0, 0.0], 6), (None, [1.0, 0.0], 7)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, tag long")
    got = B.against_all(v.where("id = 0"), v, 6).orderBy("rank").collect()
    assert [(r["other"], r["tag"]) for r in got] == [(5, 5), (1, None), (2, 2), (3, 3), (4, 4), (6, 6)]
    assert B.against_all(v.limit(0), v, 5).count() == B.against_all(v, v.limit(0), 5).count() == 0


def test_the_vote_makes_no_row_for_each_pair(spark):
    plan = QUERIES["nearest_label_vote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
