"""op12: counts against a walk through every order."""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.llm import filter_audit as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", " \n", "short", LONG, LONG + " extra", "same " * 100, "Same " * 100, "same  " * 99 + "  x", LONG + " #", "A" * 50 + LONG, "$ " + "same " * 150,
    " ".join(f"W{i}" for i in range(120)), " ".join(f"WORD{i}" for i in range(120)), "é" * 30, "漢 " * 100, "&", "%" + LONG, "ab" * 50_000,
    " ".join(f"w{i % 80}" for i in range(100)), " ".join(f"w{i % 79}" for i in range(100)), "A" + "b" * 9, "AA" + "b" * 18, "AAA" + "b" * 18,
]


def failing(rows):
    """The filters that each (doc_id, text, ...) fails."""
    out = []
    for d, t, *_ in rows:
        text = t or ""
        words = WORD.findall(text)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            f.add("C")
        if re.search(r"[#$%&*|]", text):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == text for e, u, *_ in rows):
            f.add("E")
        out.append(f)
    return out


def walked(rows, good, toxic):
    """Every order run filter by filter over the rows (doc_id, text, lang)."""
    failed = failing(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        gone_by = dict.fromkeys("ABCDE", 0)
        lines = {}
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                gone_by[x] += len(gone)
                fails = [r for r in own if x in r[1]]
                lines["".join(order), k] = (
                    len(left), len(gone), len(fails) - len(gone), sum(r[1] == {x} for r in own),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone),
                )
        for (order, k), v in lines.items():
            out[part, order, k] = (*v, gone_by[order[k - 1]])
    return out


def found(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("part", "failed", "same", "good", "toxic", "first", "all0", "copied", "quality"):
        docs = docs.withColumn(name, F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = M.audit(spark, docs, marks).collect()
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out}, len(out)


def test_against_a_walk(spark):
    langs = ["en", "de", None, ""]
    rows = [(i * 7 % 101, t, langs[i % 4]) for i, t in enumerate(TEXTS * 3)]
    rows += [(5, "short", "en"), (5, "short", "en"), (None, "short", "en"), (None, "unseen", "en"), (500, "unseen", "fr")]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 101, 2)]
    labels = [(i, int(q), int(x)) for i, q, x in labels] + [(4, 1, 0), (4, 0, 1), (7, None, 1), (9, 1, None), (None, 1, 1), (999, 1, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    got, n = found(spark, rows, labels)
    assert got == walked(rows, good, toxic) and n == len(got)


def test_one_text_of_most_rows(spark):
    rows = [(i, "the same line", "en") for i in range(400)] + [(1000 + i, LONG + f" {i}", "en") for i in range(50)]
    got, _ = found(spark, rows, [])
    assert got == walked(rows, set(), set())


def test_empty_tables(spark):
    assert found(spark, [], [])[0] == {}
    got, n = found(spark, [(1, LONG, "x")], [])
    assert n == 600 and got["x", "ABCDE", 5] == (1, 0, 0, 0, 0, 0, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
def test_positional_popcount(words):
    want = [sum(w >> i & 1 for w in words) for i in range(32)]
    assert M.positional_popcount(np.array(words, np.uint32)).tolist() == want


def test_words_are_truth_tables():
    for failed in range(32):
        for subset in range(32):
            assert bool(int(M.WORDS[failed]) >> subset & 1) == (failed & subset == 0)


@pytest.mark.parametrize("held", [0, 1, 10_000])
def test_many_parts(spark, monkeypatch, held):
    monkeypatch.setattr(M, "PARTS_HELD", held)
    rows = [(i, "x" if i % 2 else LONG + str(i), f"lang{i % 40}") for i in range(160)]
    got, n = found(spark, rows, [(3, 1, 1)])
    assert n == 40 * 600 and got == walked(rows, {3}, {3})


def test_texts_are_read_once_and_no_row_meets_all_others(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    rows = M.failed_filters(spark, docs)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "Window" not in plan
