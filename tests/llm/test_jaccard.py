from __future__ import annotations

import random
import re

import numpy as np
import pytest

from txrisk.llm import jaccard as J
from txrisk.llm.components import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(rng, n):
    """Texts of which many are edits of a few, in chains and stars."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 30, 60]))] for _ in range(max(2, n // 12))]
    while len(out) < n:
        words = list(rng.choice(out))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def run(spark, docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(spark, docs).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, docs_of, seed):
    rows = near_copies(random.Random(seed), 220)
    assert run(spark, docs_of(rows).repartition(5)) == brute(rows)


def test_equals_brute_force_with_salted_lists(spark, docs_of, monkeypatch):
    monkeypatch.setattr(J, "SALT_ROWS", 5)
    rows = near_copies(random.Random(3), 150)
    assert run(spark, docs_of(rows)) == brute(rows)


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "É x"), (8, "é x"), (10, "x " * 50000 + "y"), (9, "x " * 50000 + "y")]
    got = run(spark, docs_of(rows))
    assert got == brute(rows)
    assert got[1] == (0, 1) and got[4] == (1, 4) and got[5] == (1, 4) and got[8] == (1, 8) and got[10][1] == 9


def test_repeated_rows_and_missing_ids(spark, docs_of):
    docs = docs_of([(2, "a b c"), (2, "a b c"), (None, "a b c"), (None, "q r s"), (3, "t u")])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in J.classes(spark, docs).collect())
    assert got == [(-1, 1, -1), (-1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 1, 3)]
    kept = sorted((r.doc_id or -1, r.text) for r in J.one_of_each(spark, docs).collect())
    assert kept == [(-1, "q r s"), (2, "a b c"), (3, "t u")]


def test_empty_table_and_stage(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(["a b c d e f", "a b c d e f", "z", None, ""])])
    assert J.classes(spark, docs.where("doc_id < 0")).collect() == []
    out = J.stage_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3, 4]


def shuffled_rows(node):
    """Rows with a text that the shuffles of an executed plan have written."""
    children = node.children()
    below = sum(shuffled_rows(children.apply(i)) for i in range(children.size()))
    if node.nodeName() != "Exchange" or "text#" not in node.output().mkString(","):
        return below
    return below + node.metrics().apply("shuffleRecordsWritten").value()


def test_dropping_ids_moves_few_texts(spark, docs_of):
    rows = [(i % 1990 if i % 7 else None, f"text {i}") for i in range(2000)]
    drop = set(range(0, 1990, 50)) | {5000}
    gone = spark.createDataFrame([(d,) for d in sorted(drop)], "doc_id long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kept = J.without_ids(docs_of(rows), gone).select("doc_id", "text")
        got = kept.collect()
        moved = shuffled_rows(kept._jdf.queryExecution().executedPlan())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    order = lambda rows: sorted((d is None, d or 0, t) for d, t in rows)
    assert order(got) == order((d, t) for d, t in rows if d not in drop)
    assert 0 < moved <= 60
    assert J.without_ids(docs_of(rows), gone.limit(0)).count() == len(rows)


def test_prefixes_of_similar_sets_meet_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = a.copy()
        b[: int(rng.integers(0, max(1, n // 6)))] += np.uint64(1)
        b = np.unique(b)
        both = len(np.intersect1d(a, b))
        assert J.similar(a, b) == (100 * both >= 75 * (len(a) + len(b) - both))


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 299), (299, 300), (5, 5)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 200)}, 300: 299}
    assert components(spark, spark.createDataFrame([], "x long, y long")).collect() == []
