from __future__ import annotations

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txrisk.llm import token_orc
from txrisk.llm.tokens import Encoder
from txrisk.session import fresh_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_orc.default_tokenizer())
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


ODD = ["", " ", "  ", "\n", "a\n\n b", "a  b", "\n\n\nx", "x \n", "a  b", "it's, 3.14! <|endoftext|> é.", "word,word.", "\r\nq", "tab\tx", "ü" * 5000, "..", "a. b, c; d!"]


def test_pieces_equal_whole_texts(plain):
    import pyarrow as pa

    enc = Encoder(token_orc.default_tokenizer(), 2)
    ids, n = enc.encode(pa.array(ODD))
    at = 0
    for text, k in zip(ODD, n, strict=True):
        assert ids[at : at + k].tolist() == plain(text), repr(text)
        at += k


def test_strings_of_added_tokens(plain):
    """By default they are read as the tokenizer reads them; for flat files, whose marks are ids, as ordinary text."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = token_orc.default_tokenizer()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|>y z", "<|endof text|>", "plain words"]
    ids, n = Encoder(path, 2).encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain(t)] and ids[: n[0]].tolist() == [64, 220, 50256, 275, 2]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids, _ = Encoder(path, 2, ordinary=True).encode(pa.array(texts))
    assert ids.tolist() == [i for x in texts for i in [*t.encode(x, add_special_tokens=False).ids, 2]] and 50256 not in ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n'é1 \t　", max_size=30), min_size=1, max_size=5))
def test_pieces_equal_whole_texts_random(plain, texts):
    import pyarrow as pa

    enc = Encoder(token_orc.default_tokenizer(), 2)
    ids, n = enc.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in plain(t)] and n.sum() == len(ids)


def test_round_trip_order_and_checksums(spark, docs_of, plain):
    rows = [(9, "b a"), (3, None), (5, "zz"), (5, "aa"), (5, "aa"), (None, "last"), (-1, ODD[9]), (7, "long " * 3000)]
    got = token_orc.stage_tokens(spark, docs_of(rows), "").orderBy("start").collect()
    start = 0
    for r, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), strict=True):
        ids = plain(text or "")
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_empty_table(spark, docs_of):
    assert token_orc.stage_tokens(spark, docs_of([(1, "a")]).where("doc_id < 0"), "").collect() == []


def test_files_hold_stripes_and_filters_and_are_pruned(spark, docs_of):
    path = fresh_path(spark, "t")
    token_orc.write_tokens(docs_of([(i, f"text {i}") for i in range(5000)]), path)
    found = token_orc.find(spark, path, [17, 4000])
    assert sorted(r.doc_id for r in found.collect()) == [17, 4000]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString().replace("`", "")
    from pathlib import Path

    import pyarrow.orc as orc

    files = lambda p: sorted(Path(p.removeprefix("file:")).glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files(path)) == 5000
    assert all(orc.ORCFile(f).row_index_stride == 1000 for f in files(path))
    plain = fresh_path(spark, "t-plain")
    options = {k: v for k, v in token_orc.ORC_OPTIONS.items() if "bloom" not in k}
    token_orc.read_tokens(spark, path).coalesce(1).write.options(**token_orc.ORC_OPTIONS).orc(plain + "-bloom")
    token_orc.read_tokens(spark, path).coalesce(1).write.options(**options).orc(plain)
    assert files(plain + "-bloom")[0].stat().st_size > files(plain)[0].stat().st_size + 5000
