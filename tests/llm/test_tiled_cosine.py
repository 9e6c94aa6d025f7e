"""op13: links and classes against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.llm import tiled_cosine as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """{row: (vec_id, n_links, component_id, kept)} by all pairs."""
    good = []
    for d, v, label in rows:
        fine = d is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(float) if fine else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(good):
        for j in range(i):
            b = good[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if good[i] is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, *_) in enumerate(rows):
        c = least[find(i)] if good[i] is not None else d
        out.append((d, n[i], c, None if d is None else d == c))
    return sorted(out, key=repr)


def found(spark, rows, threshold=0.98):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("v", "size", "node", "cell", "share", "chunk", "n", "root", "copies", "guest", "depth", "first", "h1", "part"):
        df = df.withColumn(name, F.lit("clash"))
    out = M.near_duplicates(spark, df, threshold)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def some_rows(n=240, d=12, seed=0, labels=3, spread=0.06, bases=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(bases, d))
    v = base[rng.integers(0, bases, n)] * rng.uniform(0.1, 9, (n, 1)) + 0
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + rng.normal(size=(n, d)) * spread
    return [(int(i), [float(x) for x in np.float32(row)], int(rng.integers(0, labels))) for i, row in zip(rng.permutation(n), v, strict=True)]


@pytest.mark.parametrize(("tile", "guests"), [(2048, 4096), (16, 4096), (8, 12), (1, 3)])
def test_all_pairs_for_every_tile_size(spark, monkeypatch, tile, guests):
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "GUESTS", guests)
    rows = some_rows()
    want = brute(rows)
    assert sum(r[1] for r in want) > 100
    assert found(spark, rows) == want


def test_defined_cases(spark, monkeypatch):
    one, near, nan, inf = [1.0, 0.0], [1.0, 0.1], float("nan"), float("inf")
    rows = [
        (1, one, 0), (2, one, 0), (3, one, 0), (3, one, 0), (4, near, 0), (5, [0.0, 1.0], 0), (6, one, 1), (7, one, None), (8, None, 0), (9, [], 0),
        (10, [0.0, 0.0], 0), (11, [nan, 1.0], 0), (12, [inf, 1.0], 0), (13, [None, 1.0], 0), (14, [1.0, 0.0, 0.0], 0), (15, [2.0, 0.0, 0.0], 0),
        (None, one, 0), (16, [-1.0, 0.0], 0), (17, [1e30, 0.0], 0), (18, [1e-30, 0.0], 0), (19, [-0.0, 0.0], 0), (5, near, 2), (5, one, 2), (20, [7.0], 0), (21, [9.0], 0), (22, [-9.0], 0),
    ]
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(M, "TILE", 1)
    assert found(spark, rows) == brute(rows)


def test_the_threshold_itself(spark):
    # 4/5, 3/5 has a length of exactly 1: its cosine with (1, 0) is 0.8 as given
    rows = [(1, [1.0, 0.0], 0), (2, [4.0, 3.0], 0), (3, [4.0, 3.0001], 0), (4, [0.0, 1.0], 0)]
    assert found(spark, rows, 0.8) == brute(rows, 0.8)
    assert [r[1] for r in found(spark, rows, 0.8)] == [1, 2, 1, 0]


def test_a_large_group_of_copies_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 32)
    monkeypatch.setattr(M, "GUESTS", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in np.float32(base)], 0) for i in range(0, 300, 3)]
    rows += [(i, [float(x) for x in np.float32(base + rng.normal(size=16) * 0.03)], 0) for i in range(1, 300, 3)]
    rows += [(i, [float(x) for x in np.float32(rng.normal(size=16))], i % 2) for i in range(2, 300, 3)]
    assert found(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(4, [1.0, 2.0], 0)]) == [(4, 0, 4, True)]
    assert found(spark, [(4, None, 0)]) == [(4, 0, 4, True)]


def test_pruned_products_find_what_whole_ones_do():
    rng = np.random.default_rng(2)
    for d in (1, 2, 7, 8, 9, 33, 64):
        v = rng.normal(size=(200, d))
        v[100:] = v[:100] + rng.normal(size=(100, d)) * 0.15
        x = M.units(v) @ np.linalg.qr(rng.normal(size=(d, d)))[0]
        i, j = M.linked(x[:100], x[100:], v[:100], v[100:], 0.98)
        u = M.units(v)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(u[:100] @ u[100:].T >= 0.98)), strict=True))


def test_visits_cover_every_pair_within_reach():
    rng = np.random.default_rng(4)
    x = M.units(rng.normal(size=(400, 6)) * [3, 2, 1, 1, 1, 1])
    depth = np.full(400, 5)
    home, row, cell = M.reachable(x, np.median(x, 0)[:5], depth, 0.4)
    visits = set(zip(row.tolist(), cell.tolist(), strict=True))
    near = np.argwhere(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.4)
    for i, j in near.tolist():
        if home[i] < home[j]:
            assert (i, int(home[j])) in visits
