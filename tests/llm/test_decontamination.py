from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from txrisk.llm import decontamination as D


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    syl = ["tan", "ri", "mo", "sel", "ka", "du", "ven", "or", "lu", "pes"]
    word = lambda: "".join(rng.choices(syl, k=rng.randint(2, 4)))
    common = ["the", "of", "and", "to"]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n))
    items = [(i, text(rng.choice([12, 20, 40, 100])) + ". " + text(4) + ".") for i in range(30)]
    docs = [(i, text(rng.randint(5, 300))) for i in range(200)]
    return items, docs, text, word


def reworded(text, rng, word, every):
    words = text.split()
    return " ".join(word() if i % every == every - 1 else w.upper() + "," for i, w in enumerate(words))


def test_planted_items_are_found_and_clean_documents_left(spark, docs_of, corpus):
    items, docs, text, word = corpus
    rng = random.Random(1)
    planted = {}
    rows = list(docs)
    for k in range(30):
        copy = items[k][1] if k < 15 else reworded(items[k][1], rng, word, 6)
        rows.append((1000 + k, f"{text(80)} {copy} {text(70)}"))
        planted[1000 + k] = items[k][0]
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "the of"), items[3]], "item_id long, text string")
    docs_ = docs_of([*rows, (2000, None), (2001, ""), (1000, rows[200][1])]).repartition(4)
    got = [(r.doc_id, r.item_id) for r in D.find_leaks(spark, docs_, bench).collect()]
    assert sorted(got) == sorted(planted.items())
    kept = sorted(r.doc_id for r in D.clean(spark, docs_, bench).collect())
    assert kept == [*range(200), 2000, 2001] and D.clean(spark, docs_, bench).columns == docs_.columns


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a b c d e f g")])
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.find_leaks(spark, docs, bench).collect()] == [(1, 1)]
    assert D.find_leaks(spark, docs.where("doc_id < 0"), bench).collect() == []
    assert D.find_leaks(spark, docs, bench.where("item_id < 0")).collect() == []
    assert D.clean(spark, docs, bench.where("item_id < 0")).count() == 1


def test_blocks_cover_the_benchmark(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    items = corpus[0]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, t) for i, t in items])
    assert sorted((r.doc_id, r.item_id) for r in D.find_leaks(spark, docs, bench).collect()) == [(i, i) for i, _ in items]


def test_no_copy_is_lost_among_thousands_of_passages():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(20000)}" for _ in range(n))
    rows = [{"item_id": i, "text": text(16), "answer": ""} for i in range(3000)]
    weights = np.full(1 << D.TERM_BITS, 2.0, np.float32)
    row, term, value = D.vectors(*D.clean_words(pa.array([r["text"] for r in rows])), weights)
    a = np.zeros((len(rows), D.TERMS), np.float32)
    a[row, term] = value
    values, u = np.linalg.eigh(a @ a.T)  # the space that latent_space approximates
    space = (a.T @ u[:, -D.RANK :] / np.sqrt(values[-D.RANK :])).astype(np.float32)
    block = D.Block(rows, space, weights)
    docs = pa.array([f"{text(30)} {r['text']} {text(30)}" for r in rows[::100]])
    assert {(r, item) for r, item, *_ in D.search(docs, block)} == {(r, 100 * r) for r in range(30)}


def test_short_and_reworded_items_are_found(corpus):
    _, _, text, word = corpus
    rng = random.Random(9)
    rows, docs = [], []
    for i in range(240):
        n = (5, 6, 8, 12, 20, 40)[i % 6]
        own = [word() for _ in range(n)]
        rows.append({"item_id": i, "text": " ".join(own), "answer": ""})
        if i % 12 >= 6:
            for j in rng.sample(range(n), int(0.4 * n)):
                own[j] = word()
        docs.append(f"{text(80)} {' '.join(own)} {text(80)}")
    weights = np.full(1 << D.TERM_BITS, 2.0, np.float32)
    row, term, value = D.vectors(*D.clean_words(pa.array([r["text"] for r in rows])), weights)
    a = np.zeros((len(rows), D.TERMS), np.float32)
    a[row, term] = value
    block = D.Block(rows, np.linalg.svd(a, full_matrices=False)[2].T, weights)  # the complete space
    got = {(r, item) for r, item, *_ in D.search(pa.array(docs), block)}
    assert got >= {(i, i) for i in range(240)}


def test_frequent_words_alone_are_no_copy():
    frequent = ["the", "of", "and", "to", "in"]
    weights = np.full(1 << D.TERM_BITS, 10.0, np.float32)
    weights[D.bucket(D.clean_words(pa.array([" ".join(frequent)]))[0])] = 2.0
    rows = [{"item_id": 1, "text": "the of and kappa lambda", "answer": ""}]
    block = D.Block(rows, np.zeros((D.TERMS, 1), np.float32), weights)
    assert D.search(pa.array(["one the two of three and four", " ".join(frequent * 9)]), block) == []
    assert [x[:2] for x in D.search(pa.array(["", "x the of kappa lambda y"]), block)] == [(1, 1)]


def test_latent_space_is_the_row_space(spark, corpus):
    items = corpus[0]
    table = D.passages(spark.createDataFrame(items, "item_id long, text string"))
    weights = np.full(1 << D.TERM_BITS, 2.0, np.float32)
    n = table.count()
    space = D.latent_space(table, weights, n)
    rows = [r.text for r in table.collect()]
    row, term, value = D.vectors(*D.clean_words(pa.array(rows)), weights)
    a = np.zeros((n, D.TERMS))
    a[row, term] = value
    assert np.allclose(space.T @ space, np.eye(space.shape[1]), atol=1e-3)
    assert np.linalg.norm(a - a @ space @ space.T) < 0.05 * np.linalg.norm(a)


def test_common_subsequence():
    def slow(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(2)
    for _ in range(100):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        assert D.common(a, b) == slow(a, b)


def test_every_text_of_an_item_and_items_without_id(spark, docs_of, corpus):
    items, docs, text, word = corpus
    bench = [(1, items[0][1]), (1, items[1][1]), (None, items[2][1]), (None, items[3][1]), (2, items[4][1]), (2, items[4][1])]
    rows = [*docs[:50], *[(1000 + k, f"{text(40)} {items[k][1]} {text(30)}") for k in range(5)], (2000, f"{items[0][1]} {items[1][1]} {items[2][1]}")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in D.find_leaks(spark, docs_of(rows), bench).collect()]
    want = [(1000, 1), (1001, 1), (1002, None), (1003, None), (1004, 2), (2000, 1), (2000, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(r.doc_id for r in D.clean(spark, docs_of(rows), bench).collect()) == list(range(50))


def test_tasks_get_only_the_rows_of_passage_terms():
    """A block holds no row of the space for a term without a passage, and its vectors are those of the whole space."""
    rows = [{"item_id": 1, "text": "alpha beta gamma delta epsilon zeta", "answer": ""}]
    weights = np.linspace(1, 2, 1 << D.TERM_BITS).astype(np.float32)
    own, _ = D.clean_words(pa.array([rows[0]["text"]]))
    space = np.zeros((D.TERMS, 2), np.float32)
    space[(own % np.uint64(D.TERMS)).astype(int)] = np.arange(12).reshape(6, 2) / 10
    block = D.Block(rows, space, weights)
    assert block.rows.shape == (6, 2)
    words, _ = D.clean_words(pa.array(["beta other beta words alpha and zeta"]))
    full = np.zeros(D.TERMS)
    for w in set(words.tolist()):
        w = np.uint64(w)
        full[int(w % np.uint64(D.TERMS))] += np.sqrt((words == w).sum()) * weights[D.bucket(np.array([w]))[0]]
    x, norm, outside = D.folded(words, block.rows, block.row, weights)
    assert np.allclose(x, full @ space, rtol=1e-5) and np.isclose(norm, np.linalg.norm(full), rtol=1e-5)
    assert np.isclose(outside**2, norm**2 - x @ x, rtol=1e-3, atol=1e-3) or outside == 0


def test_vectors_of_words_that_share_a_term():
    words = np.array([5, 5 + D.TERMS, 5, 9], np.uint64)
    weights = np.ones(1 << D.TERM_BITS, np.float32)
    space, row = np.ones((1, 1), np.float32), np.full(D.TERMS, -1)
    row[5] = 0
    x, norm, _ = D.folded(words, space, row, weights)
    assert np.isclose(x[0], 2**0.5 + 1) and np.isclose(norm**2, (2**0.5 + 1) ** 2 + 1)
