from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from txrisk.llm import quality as Q


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    syl = ["tan", "ri", "mo", "sel", "ka", "du", "ven", "or"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syl, k=rng.randint(1, 3))) for _ in range(rng.randint(10, 60))]
        good = int(i % 3 > 0)
        if not good:
            words = [[w + "$$" for w in words], [w.upper() + "!!" for w in words], words[:2] * 20][rng.randrange(3)]
        rows.append((i, " ".join(words), good))
    return rows


def test_held_out_accuracy_and_edges(spark, docs_of, labels_of):
    rows = corpus(600, 4)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "tan ri " * 30000), (0, rows[0][1])])
    model = Q.fit(spark, docs, labels_of([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7000, 1, 0)]))
    out = Q.score(docs, model)
    assert out.columns == [*docs.columns, "_quality_score"] and "_quality_score" not in docs.columns
    got = [(r.doc_id, r._quality_score) for r in out.select("doc_id", "_quality_score").collect()]
    assert len(got) == 604 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[900] == by[901] and len({s for i, s in got if i == 0}) == 1
    held = [(by[i] >= Q.THRESHOLD) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95


def test_frequencies_cover_all_documents(spark, docs_of):
    texts = ["a b a", "b", None, "", "c c"]
    df, n = Q.document_frequencies(docs_of(list(enumerate(texts))).repartition(3))
    doc, term, _ = Q.terms(pa.array([t or "" for t in texts]))
    assert n == 5 and (df == np.bincount(term, minlength=len(df))).all()


def test_latent_basis_is_a_truncated_svd():
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((40, 30)) < 0.3, rng.random((40, 30)), 0)
    dense[:, 0] = 1
    row, col = np.nonzero(dense)
    v = Q.latent_basis(row, col, dense[row, col], 40, 30, 20)
    _, s, vt = np.linalg.svd(dense)
    own = np.linalg.norm(dense @ v) ** 2
    assert v.shape == (30, 20) and own > 0.999 * (s[:20] ** 2).sum()


def test_votes_equal_brute_force():
    rows = corpus(200, 9)
    df = np.bincount(Q.terms(pa.array([t for _, t, _ in rows]))[1], minlength=Q.WORDS + Q.LAYOUT)
    model = Q.learn([t for _, t, _ in rows], [y for *_, y in rows], 2 / 3, df, 200)
    idf, basis, vectors, one, zero = model
    texts = pa.array([t for _, t, _ in corpus(20, 10)])
    doc, term, count = Q.terms(texts)
    x = np.zeros((20, len(idf)))
    x[doc, term] = Q.weigh(doc, term, count, 20, idf)
    z = x @ basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for got, c in zip(Q.votes(texts, model), z @ vectors.T, strict=True):
        near = np.argsort(-c)[: Q.NEIGHBOURS]
        w = np.maximum(c[near], 1e-3) ** Q.SHARPNESS
        assert abs(got - (w * one[near]).sum() / (w * (one + zero)[near]).sum()) < 1e-3


def test_no_or_one_class_of_labels(spark, docs_of, labels_of):
    docs = docs_of([(1, "a b"), (2, None)])
    none = Q.fit(spark, docs, labels_of([(1, 1, 1)]).where("doc_id < 0"))
    assert [r._quality_score for r in Q.score(docs, none).collect()] == [0.5, 0.5]
    ones = Q.fit(spark, docs, labels_of([(1, 1, 0), (2, 1, 0)]))
    assert [r._quality_score for r in Q.score(docs, ones).collect()] == [1.0, 1.0]
    assert Q.score(docs.where("doc_id < 0"), ones).collect() == []


def test_equal_cosines_go_by_doc_id(monkeypatch):
    """Of equal neighbours those with the smallest ids vote."""
    monkeypatch.setattr(Q, "NEIGHBOURS", 5)
    texts = ["one two three four"] * 12 + ["five six seven"] * 3
    labels = [1] * 5 + [0] * 7 + [0] * 3
    df = np.ones(Q.WORDS + Q.LAYOUT)
    model = Q.learn(texts, labels, 0.5, df, 15)
    assert Q.votes(pa.array(["one two three four"]), model)[0] == pytest.approx(1.0)
    turned = Q.learn(texts, [1 - x for x in labels], 0.5, df, 15)
    assert Q.votes(pa.array(["one two three four"]), turned)[0] == pytest.approx(0.0)
