"""op11: units, cuts and outputs against the definition."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.llm import fill_in_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = ["a", "bc", " ", "\n", "\t \r", "é", "漢字", " ", " ", "😀", "word ", "x" * 70, " " * 70, "passage of words that comes again and again in many texts "]


def by_definition(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cuts_by_definition(text, low, high):
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((low % (n + 1), high % (n + 1)))
    return n, len("".join(units[:a])), len("".join(units[:b]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1)), max_size=8))
def test_cuts_of_any_text(rows):
    texts, h1, h2 = ([r[i] for r in rows] for i in range(3))
    n, a, b = M.cut(pa.array(texts, pa.string()), np.array(h1, np.int64), np.array(h2, np.int64), M.Summaries())
    assert list(zip(n.tolist(), a.tolist(), b.tolist(), strict=True)) == [cuts_by_definition(*r) for r in rows]


@pytest.mark.parametrize(("least", "most", "room"), [(1, 4, 10), (1, 7, 1 << 20), (64, 4096, 100)])
def test_chunks_and_cache_change_nothing(monkeypatch, least, most, room):
    monkeypatch.setattr(M, "LEAST", least)
    monkeypatch.setattr(M, "MOST", most)
    monkeypatch.setattr(M, "MASK", np.uint32(0xC0000000))
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(PIECES, 40)), int(rng.integers(0, 2**32)), int(rng.integers(0, 2**32))) for _ in range(60)]
    n, a, b = M.cut(pa.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), M.Summaries(room))
    assert list(zip(n.tolist(), a.tolist(), b.tolist(), strict=True)) == [cuts_by_definition(*r) for r in rows]


def test_chunks_are_whole_code_points_of_bounded_size():
    text = ("漢字 😀 word " * 3000).encode()
    ends = M.chunk_ends(np.frombuffer(text, np.uint8), [len(text)])[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= M.MOST
    for a, b in zip([0, *ends], ends, strict=False):
        text[a:b].decode()


def test_shared_passages_are_counted_once():
    rng = np.random.default_rng(1)
    passage = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(2000))
    memo = M.Summaries()
    M.cut(pa.array([f"{i} other words first {passage} {i}" for i in range(20)]), np.zeros(20, np.int64), np.ones(20, np.int64), memo)
    assert memo.hits > 0.8 * memo.asked


def test_rows_and_outputs(spark, docs_of):
    texts = [None, "", " ", "one", " one  two\n", "a <P> b", "x<S>", "<M>", "<P", "a<", "é漢字 😀 end ", "word " * 5000, "z" * 200_000, "   "]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(3, "one"), (3, "one"), (None, "no id at all")]
    out = M.fill_in_middle(docs_of(rows))
    assert set(docs_of(rows).columns) | {"fim"} == set(out.columns)
    out = out.withColumn("back", M.restored(F.col("fim.output"), F.col("fim.form")))
    got = sorted(((r.doc_id, r.text, tuple(r.fim), r.back) for r in out.collect()), key=repr)
    assert got == sorted(((d, t, by_definition(d, t), t or "") for d, t in rows), key=repr)
    assert {g[2][1] for g in got} == {"plain", "psm", "spm"}
    assert {r.n for r in out.collect()} == {"clash"}


def test_shares_are_parameters(spark, docs_of):
    rows = [(i, f"some words of text {i}") for i in range(50)]
    every = M.fill_in_middle(docs_of(rows), into="made", seed=7, fim_percent=100, spm_percent=0)
    assert {r.made.form for r in every.collect()} == {"psm"}
    assert {r.made.form for r in M.fill_in_middle(docs_of(rows), fim_percent=0).select(F.col("fim").alias("made")).collect()} == {"plain"}


def test_empty_table(docs_of):
    assert M.fill_in_middle(docs_of([])).count() == 0


def test_no_shuffle(spark, docs_of):
    plan = M.fill_in_middle(docs_of([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
