"""Quoted line breaks read in byte ranges."""

from __future__ import annotations

import csv
import io as stdio
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.sources import csv_ranges as R
from txrisk.sources import io

PIECES = ["a", "b,", '"', '""', "\n", ",", "x y", "é", "12", " ", '","', "\r\n", "\n\n", '"\n"']


def file_of(tmp_out, text: str, name: str = "one") -> str:
    import os

    path = tmp_out(name).removeprefix("file:") + ".csv"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


@pytest.fixture()
def ranges(spark):
    """Sets the size of a range for a test."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def put(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")
        spark.conf.set(keys[2], "1")

    yield put
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(rows, header=("id", "text", "n")) -> str:
    out = stdio.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def rows_of(seed, n=40):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(["a", "bc", ",", '"', "\n", "é", " ", "\n\n", "long word "]) for _ in range(rng.randrange(12)))
    return [(i, text() or "x", rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("size", [61, 200, 1 << 20])
def test_S02_every_range_size_gives_the_rows_of_one_task(spark, tmp_out, ranges, size):
    rows = rows_of(size)
    path = file_of(tmp_out, table(rows))
    names = ["a", "b", "c", io.EXTRA]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    whole = spark.read.schema(schema).options(**io.CSV_DIALECT, multiLine=True).csv(path).collect()
    ranges(size)
    if size < 1 << 20:
        assert spark.read.text(path).rdd.getNumPartitions() > 1
    found = [tuple(r) for part in io._raw_fields(spark, path, schema, True) for r in part.collect()]
    assert sorted(found, key=repr) == sorted((tuple(r) for r in whole), key=repr)
    assert sorted((int(a), b, int(c)) for a, b, c, _ in found) == sorted(rows)


def test_S02_typed_table_from_ranges(spark, tmp_out, ranges):
    path = file_of(tmp_out, table(rows_of(5, 90)))
    ranges(300)
    df = io.read_csv_inferred(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint"]
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows_of(5, 90))


def test_S02_several_files_with_their_headers(spark, tmp_out, ranges):
    import os

    folder = tmp_out("many").removeprefix("file:") + ".csv"
    os.makedirs(folder)
    want = []
    for k in range(4):
        rows = [(i + 1000 * k, t, n) for i, t, n in rows_of(k, 15)]
        want += rows
        with open(f"{folder}/part-{k}.csv", "w", newline="") as f:
            f.write(table(rows) if k != 2 else table(rows).replace("\n", "\n\n", 1))
    ranges(180)
    assert sorted(tuple(r) for r in io.read_csv_inferred(spark, folder).collect()) == sorted(want)


def test_S02_field_longer_than_many_ranges(spark, tmp_out, ranges):
    rows = [(1, "line\n" * 60, 2), (2, '"\n' * 30 + "end", 3), (3, "short", 4)]
    path = file_of(tmp_out, table(rows))
    ranges(60)
    assert sorted(tuple(r) for r in io.read_csv_inferred(spark, path).collect()) == rows


def test_S02_carriage_returns(spark, tmp_out, ranges):
    text = 'id,text\r\n1,plain\r\n2,"two\r\nlines"\r\n\r\n3,"a ""b"""\r\n'
    path = file_of(tmp_out, text)
    for size in (9, 1 << 20):
        ranges(size)
        assert sorted(tuple(r) for r in io.read_csv_inferred(spark, path).collect()) == [(1, "plain"), (2, "two\r\nlines"), (3, 'a "b"')]
    old = file_of(tmp_out, "id,text\r1,a\r2,b\r", "old")
    assert sorted(tuple(r) for r in io.read_csv_inferred(spark, old).collect()) == [(1, "a"), (2, "b")]


def test_S02_header_alone_and_header_in_quotes(spark, tmp_out, ranges):
    ranges(4)
    assert io.read_csv_inferred(spark, file_of(tmp_out, "a,b\n")).collect() == []
    df = io.read_csv_inferred(spark, file_of(tmp_out, '"two\nlines","b,c"\n1,2\n3,4', "quoted"))
    assert df.columns == ["two\nlines", "b,c"] and sorted(tuple(r) for r in df.collect()) == [(1, 2), (3, 4)]


def test_S02_more_fields_than_the_header(spark, tmp_out, ranges):
    ranges(10)
    with pytest.raises(io.UploadError, match="more than 2 fields"):
        io.read_csv_inferred(spark, file_of(tmp_out, 'a,b\n1,2\n"3\n4",5,6\n'))


def as_batches(text: str, cuts: list[int]):
    """The lines of a text, each in the range that it begins in."""
    edges = sorted({0, *[c for c in cuts if 0 < c < len(text)]})
    lines, at = [], 0
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        lines.append((line, max(e for e in edges if e <= at)))
        at += len(line) + 1
    for start in {b for _, b in lines}:
        own = [x for x, b in lines if b == start]
        for k in range(0, len(own), 2):  # small batches
            some = own[k : k + 2]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([9] * len(some)), pa.array([start] * len(some))], ["value", "file", "block"])


def by_machine(text: str) -> list[str]:
    """Records by a walk over characters: a quote opens a field only at its beginning."""
    out, record, inside, begin, i = [], "", False, True, 0
    rest = False  # between a closing quote and the next comma or line break
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                record, i = record + '""', i + 2
                continue
            if c == '"':
                inside, rest = False, True
        elif c == "\n":
            out.append(record)
            record, begin, rest, i = "", True, False, i + 1
            continue
        elif c == ",":
            begin, rest = True, False
            record, i = record + c, i + 1
            continue
        elif c == '"' and begin:
            inside = True
        begin = False
        record, i = record + c, i + 1
    if inside:  # a field that is never closed ends with the last line
        record = record.removesuffix("\n")
    return [*out, record] if record or not text.endswith("\n") else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.lists(st.integers(1, 60), max_size=5))
def test_S02_maps_and_records_of_any_ranges(text, cuts):
    if not text:
        return
    maps = {}
    for m in R.range_maps(as_batches(text, cuts)):
        row = m.to_pylist()[0]
        maps[row["block"]] = row
    inside, owner, owners = False, 0, {}
    for block in sorted(maps):
        if inside:
            owners[9, block] = owner
        m = maps[block]
        if not inside or m["closes"]:
            owner = block
        inside = m["from_in"] if inside else m["from_out"]
    whole, joined = [], {}
    for b in R.cut_records(owners)(as_batches(text, cuts)):
        for r in b.to_pylist():
            if r["file"] is None:
                whole.append(r["text"])
            else:
                joined.setdefault((r["owner"], r["open"]), []).append((r["block"], r["text"]))
    whole += ["\n".join(t for _, t in sorted(parts)) for parts in joined.values()]
    blank = lambda rows: sorted(r for r in rows if r not in ("", "\r"))
    assert blank(whole) == blank(by_machine(text))


def test_S02_plan_reads_ranges_in_many_tasks(spark, tmp_out, ranges):
    path = file_of(tmp_out, table(rows_of(1, 400)))
    ranges(500)
    assert R.lines(spark, path).rdd.getNumPartitions() > 8
    blocks = R.lines(spark, path).select("block").distinct().count()
    assert blocks > 8
    assert R.lines(spark, path).agg(F.count("*")).first()[0] == table(rows_of(1, 400)).count("\n")
