from __future__ import annotations

import numpy as np
import pytest

from txrisk.llm import metric_tree as M


def brute(rows, queries, k=5):
    out = {}
    for q, v in queries:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def run(spark, rows, queries, k=5):
    make = lambda r: spark.createDataFrame([(i, [int(x) for x in v]) for i, v in r], "vec_id long, v array<long>")
    out: dict = {}
    for r in sorted(M.top_k(spark, make(rows), make(queries), k).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("page,queries_of_block", [(1024, 4096), (60, 7)])
def test_equals_brute_force(spark, monkeypatch, page, queries_of_block):
    monkeypatch.setattr(M, "PAGE_ROWS", page)
    monkeypatch.setattr(M, "LEAF", 16)
    monkeypatch.setattr(M, "QUERY_ROWS", queries_of_block)
    rng = np.random.default_rng(4)
    centres = rng.integers(-100, 100, (6, 12))
    rows = [(i, centres[i % 6] + rng.integers(-20, 20, 12)) for i in range(400)]
    rows += [(400 + i, centres[0]) for i in range(90)]  # ties and a very common vector
    queries = [(i, v) for i, v in rows if i % 50 == 0 or i in (400, 480)]
    assert run(spark, rows, queries) == brute(rows, queries)


def test_few_rows_and_short_vectors(spark):
    rows = [(1, [1, 2]), (2, [3]), (3, [0, 0]), (50, [2, 2])]
    got = run(spark, rows, [(50, [2, 2])])
    assert got == {50: [(1, 6), (2, 6), (3, 0)]}
    one = spark.createDataFrame([(50, [2, 2])], "vec_id long, v array<long>")
    assert M.top_k(spark, one, one).collect() == []
    assert M.top_k(spark, one, one.where("vec_id < 0")).collect() == []


def test_bad_vectors_take_no_part(spark):
    bad = [(0, [0.5, -0.001]), (50, [0.1, None]), (100, [float("nan"), 1.0]), (150, [float("inf"), 0.0]), (7, None), (None, [1.0, 1.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "clash") for r in bad], "vec_id long, embedding array<float>, v string")
    got = {r.vec_id: r.v for r in M.quantised(df).collect()}
    assert got == {0: [128, -1], 9: [256, 512]}
    none = M.quantised(df.where("vec_id < 0"))
    assert M.top_k(spark, none, none).collect() == []


def test_tree_computes_few_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1000, (20, 8))
    x = np.round(np.repeat(centres, 50, 0) + rng.normal(0, 5, (1000, 8)))
    bound = (x * x).sum(1).max()
    tree = M.MTree(M.lifted(x, bound), np.arange(1000), x)
    assert all(len(leaf[1]) for leaf in tree.leaves) and sum(len(leaf[1]) for leaf in tree.leaves) == 1000
    for points, _, _, d in tree.leaves:
        assert (np.diff(d) >= 0).all() and len(points) == len(d)
    q = np.append(x[3], 0)
    scores = x @ x[3]
    want = sorted(((int(s), -i) for i, s in enumerate(scores) if i != 3), reverse=True)[:5]
    assert tree.search(q, 3, 5, float("inf")) == [(s, -i) for s, i in want]


def test_repeated_rows_of_the_query_leave_k_others(spark):
    ids = [1] * 7 + [2, 3, 4, 5, 6, 7, 8]
    vectors = spark.createDataFrame([(i, [3, 4]) for i in ids], "vec_id long, v array<long>")
    got = M.top_k(spark, vectors, vectors.where("vec_id = 1").limit(1)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3, 4, 5, 6]
