from __future__ import annotations

import random

import numpy as np
import pytest

from txrisk.llm import separators as S
from txrisk.llm.token_orc import default_tokenizer
from txrisk.session import fresh_path


def files_of(spark, lists):
    """Flat files of the given id lists."""
    folder = S._uri(fresh_path(spark, "flat-test"))
    fs, base = S._open(folder)
    fs.create_dir(base, recursive=True)
    rows = []
    for part, ids in enumerate(lists):
        data = np.array(ids, "<u2").tobytes()
        with fs.open_output_stream(f"{base}/{part}.bin") as f:
            f.write(data)
        rows.append((part, f"{folder}/{part}.bin", len(data)))
    return spark.createDataFrame(rows, "part int, path string, bytes long")


def brute(lists, end):
    ids = [i for x in lists for i in x]
    out, start = [], 0
    for at, i in enumerate(ids):
        if i == end:
            out.append((len(out), start, at - start, True))
            start = at + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, block, seed):
    rng = random.Random(seed)
    lists = [[9 if rng.random() < 0.15 else rng.randint(0, 8) for _ in range(rng.choice([0, 1, 5, 60]))] for _ in range(6)]
    got = S.count(spark, files_of(spark, lists), end=9, block_bytes=block)
    assert sorted((r.document, r.start, r.n_tokens, r.closed) for r in got.collect()) == brute(lists, 9)


@pytest.mark.parametrize("lists", [[[]], [[9]], [[9, 9, 9]], [[1, 2, 3]], [[1], [2], [9, 3]]])
def test_edges(spark, lists):
    got = S.count(spark, files_of(spark, lists), end=9, block_bytes=4)
    assert sorted((r.document, r.start, r.n_tokens, r.closed) for r in got.collect()) == brute(lists, 9)


def test_no_files(spark):
    assert S.count(spark, files_of(spark, [[1]]).where("part < 0"), end=9).collect() == []


def test_counts_of_documents(spark, docs_of):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, "some words, here"), (3, "some words, here"), (None, "no id"), (4, "long text " * 4000)]
    files, written = S.write_flat(spark, docs_of(rows).repartition(3), fresh_path(spark, "flat"), default_tokenizer())
    got = S.count(spark, files, block_bytes=1024)
    t = Tokenizer.from_file(default_tokenizer())
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(t.encode(x or "").ids) for _, x in rows)
    assert sorted((r.doc_id or -1) for r in written.collect()) == [-1, 1, 2, 3, 3, 4]
    empty = docs_of(rows).where("doc_id < 0")
    files, written = S.write_flat(spark, empty, fresh_path(spark, "flat"), default_tokenizer())
    assert written.count() == 0 and S.count(spark, files).collect() == []
