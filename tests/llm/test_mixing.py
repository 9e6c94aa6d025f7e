from __future__ import annotations

import math
import random

import pytest

from txrisk.llm import mixing


def run(spark, docs):
    out = mixing.mix(spark, mixing.sized(docs))
    return [r.asDict() for r in out.select("doc_id", "text", "source", "_mix_size", "_mix_source_size", "_mix_target", "_mix_copies").collect()]


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped, out = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        out = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_and_taken_words(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["a", "b", "Z", "é", None, "a"])) for i in range(3000)]
    got = run(spark, docs_of(rows))
    sizes: dict = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["_mix_size"]
    want = brute_targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["_mix_source_size"] == size and math.isclose(r["_mix_target"], want[s], rel_tol=1e-9) for r in own)
        taken = sum(r["_mix_size"] * r["_mix_copies"] for r in own)
        assert abs(taken - want[s]) <= 2 * 200
        assert all(0 <= r["_mix_copies"] <= 2 for r in own)


def test_reruns_agree_on_any_partitioning(spark, docs_of):
    rows = [(i, "a b " * (i % 17), f"s{i % 4}") for i in range(500)]
    one = {r["doc_id"]: r["_mix_copies"] for r in run(spark, docs_of(rows))}
    two = {r["doc_id"]: r["_mix_copies"] for r in run(spark, docs_of(rows[::-1]).repartition(7))}
    assert one == two


def test_nulls_empty_texts_repeated_rows(spark, docs_of):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (3, None, "b")] + [(None, "q", None)] * 5
    got = run(spark, docs_of(rows))
    assert len(got) == len(rows)
    assert sorted(r["_mix_size"] for r in got) == sorted([0, 0, 0, 2, 2, 0] + [1] * 5)
    assert all(r["_mix_target"] <= 2 * r["_mix_source_size"] for r in got)


def test_empty_table_and_emit(spark, docs_of):
    empty = docs_of([(1, "a", "s")]).where("doc_id < 0")
    assert run(spark, empty) == []
    docs = docs_of([(i, "a b c", "s") for i in range(40)])
    out = mixing.stage_mix(spark, docs, "")
    assert out.columns == docs.columns
    # one source takes 150 % of its words, so half of the documents come twice
    counts = [r["count"] for r in out.groupBy("doc_id").count().collect()]
    assert len(counts) == 40 and abs(sum(counts) - 60) <= 1


@pytest.mark.parametrize("text,n", [("", 0), (" a\tb\x0bc\n", 3), ("a b", 1), ("é ü", 2)])
def test_word_count(spark, text, n):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(mixing.word_count(df["t"])).first()[0] == n


def test_plan_has_no_python(spark, docs_of):
    plan = mixing.mix(spark, mixing.sized(docs_of([(1, "a", "s"), (2, "b", "t")])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_stage_copies_of_repeated_rows(spark, monkeypatch):
    """Equal rows give together what the mix takes of them, and every other column is kept."""
    monkeypatch.setattr(mixing, "RUN", 3)
    rows = [(1, "the same words", "a", "en")] * 40 + [(i, f"words of text number {i} " * (i % 5), "ab"[i % 2], "de") for i in range(2, 60)]
    rows += [(None, None, None, None)] * 7 + [(70, "", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want = {}
    for r in mixing.mix(spark, mixing.sized(docs)).collect():
        key = (r.doc_id, r.text, r.source, r.lang)
        want[key] = want.get(key, 0) + r._mix_copies
    out = mixing.stage_mix(spark, docs, "")
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_stages_that_move_texts_release_their_shuffles(spark):
    """Texts that a stage has shuffled are not kept on disk while the next one shuffles its own."""
    from txrisk.llm import mixing, token_orc

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(8)], "doc_id long, text string, source string")
    for stage in (mixing.stage_mix, token_orc.stage_tokens):
        spark.conf.set(key, "false")
        rows = stage(spark, docs, "").collect()
        assert len(rows) >= 8 and spark.conf.get(key) == "true"
        again = stage(spark, docs, "")
        assert sorted(map(str, again.collect())) == sorted(map(str, again.collect()))  # made anew when asked again
