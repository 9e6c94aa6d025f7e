from __future__ import annotations

import numpy as np
import pytest

from txrisk.llm import line_templates as L


def run(spark, docs):
    return {r.doc_id: r for r in L.drop_recurring(spark, docs).collect()}


def test_recurring_templates_go(spark, docs_of):
    rows = [(i, f"Own line {'abcdefghij'[i]}{'klmnopqrst'[i]} here\nPosted on 2024-01-{i + 10} by user{i} at noon\nAll rights reserved.") for i in range(8)]
    rows += [(100 + i, f"The weather in {city} is fine today") for i, city in enumerate(["Rome", "Oslo", "Bonn", "Lima", "Kyiv"])]
    rows += [(200, "All rights reserved\nPosted on"), (201, "single line")]
    got = run(spark, docs_of(rows).repartition(4))
    assert all(got[i].text.startswith("Own line") and got[i]._n_dropped == 2 for i in range(8))
    assert all(got[100 + i]._n_dropped == 1 and got[100 + i].text == "" for i in range(5))
    assert got[200]._n_dropped == 0 and got[201]._n_dropped == 0


def test_long_passages_need_two_documents(spark, docs_of):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    got = run(spark, docs_of([(1, f"a\n{long}"), (2, f"{long}\nb"), (3, f"{long} x"), (4, "short one\n" + "q"), (5, "short one")]))
    assert got[1].text == "a" and got[2].text == "b" and got[3]._n_dropped == 0 and got[4]._n_dropped == 0


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "x\n\n\nx\nx\nx\nx\nx"), (None, "same"), (None, "same"), (4, "same\n"), (4, "same\n")]
    docs = docs_of(rows)
    out = L.drop_recurring(spark, docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = {(r.doc_id, r.text): (r._n_lines, r._n_dropped) for r in out.collect()}
    assert got[1, None] == (0, 0) and got[2, ""] == (1, 0) and got[3, "x\n\n\nx\nx\nx\nx\nx"] == (8, 0)
    assert out.count() == len(rows)
    assert L.drop_recurring(spark, docs.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_large_leaves_are_split(spark, docs_of, parts):
    rows = [(i, f"one two three four five six seven eight {w} ten") for i, w in enumerate(["a", "b", "c", "d", "e", "f", "g", "h"])]
    rows += [(50 + i, "one two three " + " ".join([w] * 7)) for i, w in enumerate("klmnopqrst")]
    got = run(spark, docs_of(rows).repartition(parts))
    dropped = {i for i, r in got.items() if r._n_dropped}
    assert not any(i >= 50 for i in dropped)
    assert dropped == set(range(8))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_large_leaves_lose_no_template(spark, docs_of, parts):
    rows = [(i, f"one two three Posted by {w} at the noon today") for i, w in enumerate("abcdefgh")]
    rows += [(20 + i, f"one two three {w} q r s t u v") for i, w in enumerate("abcdefgh")]
    rows += [(50 + i, "one two three " + " ".join([w] * 7)) for i, w in enumerate("klmnopqrst")]
    got = run(spark, docs_of(rows).repartition(parts))
    assert {i for i, r in got.items() if r._n_dropped} == {*range(8), *range(20, 28)}


def brute(rows):
    """{(doc_id, text): kept text} by the definition, for rows with ids."""
    import re

    def mask(line):
        return " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())

    need = lambda n: 2 if n >= L.LONG else 5
    docs = {}  # masked line -> documents
    for d, text in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if m := mask(line):
                docs.setdefault(m, set()).add(d)
    leaf = lambda m: (len(m.split(" ")), *m.split(" ")[:3])
    at = {}  # (leaf, place, token) -> documents of its lines, counted by line
    for m, ds in docs.items():
        for i, t in enumerate(m.split(" ")):
            if t != "<*>":
                at[leaf(m), i, t] = at.get((leaf(m), i, t), 0) + len(ds)
    members = {}
    for m in docs:
        tokens = m.split(" ")
        n = len(tokens)
        constant = [i for i, t in enumerate(tokens) if at.get((leaf(m), i, t), 0) >= need(n)]
        base = [t if i in constant else "<*>" for i, t in enumerate(tokens)]
        forms = [(base, len(constant))]
        forms += [([*base[:i], "<*>", *base[i + 1 :]], len(constant) - 1) for i in constant if i >= 3]
        for form, c in forms:
            if c >= L.SIMILAR * n:
                members.setdefault((leaf(m), tuple(form)), set()).add(m)
    gone = {m for m, ds in docs.items() if len(ds) >= need(len(m.split(" ")))}
    for lines in members.values():
        if len(set().union(*(docs[m] for m in lines))) >= need(len(next(iter(lines)).split(" "))):
            gone |= lines
    return {(d, t): t if t is None else "\n".join(x for x in t.split("\n") if mask(x) not in gone) for d, t in rows}


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, docs_of, seed):
    """One crowded leaf and some small ones, with fields of few and of many values."""
    rng = np.random.default_rng(seed)
    names = [f"n{chr(97 + i)}" for i in range(20)]
    word = lambda k: names[min(int(rng.exponential(k)), 19)]
    forms = [
        lambda: f"the one and {word(6)} went to {word(6)} by {word(1)}", lambda: f"the one and {word(3)} saw {word(9)} in a hat",
        lambda: f"the {word(9)} is here", lambda: f"posted {rng.integers(9)} days ago by {word(9)}", lambda: " ".join(word(5) for _ in range(4)),
        lambda: " ".join(["the one and", *["so"] * 45, word(1), word(5)]), lambda: " ".join(["the one and", *["so"] * 46, word(2), word(9)]), lambda: "",
    ]
    rows = [(i, "\n".join(forms[rng.integers(len(forms))]() for _ in range(rng.integers(0, 6)))) for i in range(70)]
    rows += [(3, rows[3][1]), (100, None)]
    docs = docs_of(rows)
    kept = L.drop_recurring(spark, docs.withColumn("before", docs["text"])).collect()
    got = {(r.doc_id, r.before): r.text for r in kept}
    want = brute(rows)
    assert got == want and len(kept) == len(rows)
    assert 20 < sum(a != b for (_, a), b in want.items()) < len(want)


def test_clashing_names(spark, docs_of):
    docs = docs_of([(i, "All rights reserved\nown " + "abcdefgh"[i]) for i in range(8)])
    for name in ("_key", "_doc", "_drops", "_kept", "own", "row", "drops", "left", "leaf", "m", "_n_lines"):
        docs = docs.withColumn(name, docs["doc_id"] * 10)
    out = L.drop_recurring(spark, docs)
    assert out.columns == [*[c for c in docs.columns if c != "_n_lines"], "_n_lines", "_n_dropped"]
    rows = out.collect()
    assert len(rows) == 8 and all(r._n_dropped == 1 and r._key == r.own == r.doc_id * 10 and r._n_lines == 2 for r in rows)


def test_masks(spark):
    df = spark.createDataFrame([("  a1  b \t 2024-01-02 c ",), ("",), (" ",)], "l string")
    assert [r[0] for r in df.select(L.masked(df["l"])).collect()] == ["<*> b <*> c", "", ""]
