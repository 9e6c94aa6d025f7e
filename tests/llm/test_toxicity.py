from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from txrisk.llm import toxicity as X

SYLLABLES = ["tan", "ri", "mo", "sel", "ka", "du", "ven", "or"]
BAD = ["grumpel", "snarfik", "blotzen"]


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(30)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(30)] = rng.choice(BAD)
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(400, 1)
    return X.train([t for _, t, _ in rows], [y for *_, y in rows])


def scores(model, texts):
    units, unit, doc = X.word_units(pa.array(texts, pa.string()))
    value, worst = X.unit_scores(units, model[0]), np.full(len(texts), -np.inf)
    np.maximum.at(worst, doc, value[unit])
    return X.probability(worst, model)


def test_held_out_accuracy(model):
    rows = corpus(400, 2)
    p = scores(model, [t for _, t, _ in rows])
    assert np.mean((p >= 0.5) == [y == 1 for *_, y in rows]) > 0.97


@pytest.mark.parametrize("text", ["you grumpel", "you GRUMPEL!!", "g r u m p e l", "g.r.u-m.p.e.l", "grummpel", "grumxpel"])
def test_disguised_insults(model, text):
    assert scores(model, [f"tanri mosel {text} kadu."])[0] >= 0.5


def test_clean_texts(model):
    assert (scores(model, ["tanri mosel kadu ven.", "", "a b", "12 34", "   "]) < 0.5).all()


def test_kernel_is_the_sum_over_shared_gapped_subsequences():
    from itertools import combinations

    def phi(w):
        s, out = f"^{w}$", {}
        for idx in combinations(range(len(s)), 4):
            gaps = [b - a - 1 for a, b in zip(idx, idx[1:], strict=False)]
            if max(gaps) <= 1:
                u = tuple(s[i] for i in idx)
                out[u] = out.get(u, 0) + X.DECAY ** sum(gaps)
        return out

    words = ["idiot", "idxiot", "stupid", "dio"]
    k = X.kernel(pa.array(words), X.features(pa.array(words)))
    size = np.sqrt(np.maximum(X.placements(np.array([len(w) + 2 for w in words])), 1e-9))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            fa, fb = phi(a), phi(b)
            want = sum(v * fb.get(u, 0) for u, v in fa.items()) / size[i] / size[j]
            assert abs(k[i, j] - want) < 1e-3


def test_query_rows_and_edges(spark, docs_of, labels_of):
    rows = corpus(300, 5)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "grumpel " * 20000), (0, rows[0][1])])
    labels = labels_of([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5000, None, None)])
    m = X.fit(spark, docs, labels)
    out = X.score(docs, m)
    assert out.columns == [*docs.columns, "_tox_score"] and docs.columns[-1] != "_tox_score"
    got = [(r.doc_id, r._tox_score) for r in out.select("doc_id", "_tox_score").collect()]
    assert len(got) == 304 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[900] < 0.5 and by[901] == by[900] and by[902] >= 0.5
    assert len({s for i, s in got if i == 0}) == 1
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert held and np.mean([(by[i] >= 0.5) == bool(y) for i, _, y in rows if i in held]) > 0.9


def test_no_or_one_class_of_labels(spark, docs_of, labels_of):
    docs = docs_of([(1, "a b"), (2, None)])
    for labels, low, high in (([], 0.0, 1e-5), ([(1, 1, 0)], 0.0, 1e-5), ([(1, 1, 1), (3, 1, 1), (2, 0, 1)], 0.99, 1.0)):
        m = X.fit(spark, docs, labels_of(labels) if labels else labels_of([(1, 1, 1)]).where("doc_id < 0"))
        got = [r._tox_score for r in X.score(docs, m).collect()]
        assert all(low <= s <= high for s in got)
    assert X.score(docs.where("doc_id < 0"), m).collect() == []
