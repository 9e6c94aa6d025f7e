"""The records of CSV files read by many tasks, quoted line breaks included.

A byte range cannot tell by itself whether it begins inside a quoted field.  But
what it does to either beginning can be found on its own: a line turns "outside"
or "inside" into one of the two, so a range is a map of two states, and maps
of consecutive ranges compose.  So the files are read twice, in the ranges that
Spark cuts them into:

1. every range gives its map, one row; a prefix scan over a file's ranges
   gives the state at the beginning of each;
2. every range cuts its lines into records.  A record that crosses ranges leaves
   a fragment in each; the fragments, at most two of a range, are put together.

The first record of each file is its header and is left out.  Only texts
without line breaks pass through unchanged rows; everything else of the reader
(fields, types) stays with Spark's own ``from_csv``.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.session import fresh_path

#: the rest of a quoted field, as far as its closing quote; a doubled quote is a quote of the text
CLOSE = re.compile(r'(?:[^"]++|"")*+"')
RECORD = "text string, file long, owner long, block long, open boolean, first boolean"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): the lines, each with the range that it begins in; in order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside (or outside) a quoted field ends inside one."""
    at = 0
    while True:
        if inside:
            closed = CLOSE.match(line, at)
            if closed is None:
                return True
            at = line.find(",", closed.end()) + 1
            if at == 0:
                return False
        if line.startswith('"', at):
            at += 1
        else:  # a quote opens a field only at its beginning
            at = line.find(',"', at) + 2
            if at == 1:
                return False
        inside = True


def _runs(batches):
    """(file, block, lines, places of lines with quotes) for stretches of one range."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, block = batch.column("file").to_numpy(), batch.column("block").to_numpy()
        change = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        edges = [0, *(change.nonzero()[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            value = batch.column("value").slice(a, b - a)
            quoted = pc.match_substring(value, '"').to_numpy(zero_copy_only=False).nonzero()[0]
            yield int(file[a]), int(block[a]), value, quoted.tolist()


def range_maps(batches):
    """A row per range: the state at its end for both beginnings, and whether a record ends in it if it begins inside."""
    key, out = None, []

    def row():
        return pa.record_batch([pa.array([x]) for x in (*key, *out)], ["file", "block", "from_out", "from_in", "closes"])

    for file, block, value, quoted in _runs(batches):
        if (file, block) != key:
            if key is not None:
                yield row()
            key, out = (file, block), [False, True, False]
        for i in quoted:
            line = value[i].as_py()
            a = ends_inside(line, out[0])
            b = a if out[1] == out[0] else ends_inside(line, out[1])
            out = [a, b, out[2] or not b]
        if not out[1]:
            out[2] = True
    if key is not None:
        yield row()


def open_ranges(spark: SparkSession, text: DataFrame) -> dict[tuple[int, int], int]:
    """The ranges that begin inside a quoted field, with the range in which that record begins.

    A map that gives one state for both beginnings settles what follows; between
    two such maps only the number of swaps counts.  So the composition is a last
    value and a sum over the ranges before.  Only ranges cut within a record are returned.
    """
    maps = text.mapInArrow(range_maps, "file long, block long, from_out boolean, from_in boolean, closes boolean")
    path = fresh_path(spark, "csv-ranges")
    maps.write.parquet(path)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("from_out") == F.col("from_in")
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    rows = spark.read.parquet(path).withColumn("swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    settled = F.last(F.when(constant, F.struct(F.col("from_out").alias("state"), F.col("swaps").alias("at"))), ignorenulls=True).over(before)
    inside = (F.coalesce(settled["state"].cast("int"), F.lit(0)) + F.col("swaps") - F.coalesce(settled["at"], F.lit(0))) % 2 == 1
    rows = rows.withColumn("inside", inside)
    begun = F.last(F.when(~F.col("inside") | F.col("closes"), F.col("block")), ignorenulls=True).over(before)
    cut = rows.withColumn("owner", begun).where("inside").select("file", "block", "owner")
    return {(r["file"], r["block"]): r["owner"] for r in cut.toLocalIterator()}


def cut_records(owners: dict[tuple[int, int], int]):
    """Lines to records.  Whole ones are rows of text alone; a range's first record and its fragments name their range."""

    def run(batches):
        key, held, owner, first, inside = None, [], None, True, False

        def special(texts, owner, opened, first):
            file, block = key
            return pa.record_batch(
                [pa.array([texts], pa.string()), *[pa.array([x]) for x in (file, owner, block, opened, first)]], ["text", "file", "owner", "block", "open", "first"]
            )

        def plain(texts):
            nothing = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())]
            return pa.record_batch([texts, *nothing], ["text", "file", "owner", "block", "open", "first"])

        def blank(text):
            return text in ("", "\r")

        for file, block, value, quoted in _runs(batches):
            if (file, block) != key:
                if held:
                    yield special("\n".join(held), owner, True, owner == key[1] and first)
                key, held, first = (file, block), [], True
                inside = key in owners
                owner = owners.get(key, block)
            n, at = len(value), 0
            for i in [*quoted, n]:
                # lines without a quote: records of their own, or more of the open one
                if inside:
                    held += value.slice(at, i - at).to_pylist()
                elif i > at:
                    some = value.slice(at, i - at)
                    some = some.filter(pc.invert(pc.is_in(some, pa.array(["", "\r"]))))
                    if first and len(some):
                        yield special(some[0].as_py(), block, False, True)
                        some, first = some.slice(1), False
                    if len(some):
                        yield plain(some)
                at = i + 1
                if i == n:
                    break
                line = value[i].as_py()
                after = ends_inside(line, inside)
                if not inside:
                    held, owner = [], block
                held.append(line)
                inside = after
                if inside:
                    continue
                text, held = "\n".join(held), []
                if owner != block:  # the rest of a record of an earlier range
                    yield special(text, owner, True, False)
                elif first and not blank(text):
                    yield special(text, block, False, True)
                    first = False
                else:
                    yield plain(pa.array([text], pa.string()))
                owner = block
        if held:
            yield special("\n".join(held), owner, True, owner == key[1] and first)

    return run


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of the files, without headers, each as one text: the whole ones, and a few put together.

    Both are read from what the second pass writes, so the files are read in the
    same ranges as in the first.
    """
    text = lines(spark, path)
    stored = fresh_path(spark, "csv-records")
    text.mapInArrow(cut_records(open_ranges(spark, text)), RECORD).write.parquet(stored)
    rows = spark.read.parquet(stored)
    special = rows.where("file is not null").groupBy("file", "owner", "open")
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))  # a record is put together in one place
    whole = special.agg(F.max("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    header = whole.where("first").groupBy("file").agg(F.min("owner").alias("owner"))
    path = fresh_path(spark, "csv-headers")
    header.write.parquet(path)
    header = spark.read.parquet(path).withColumn("first", F.lit(True))
    rest = whole.join(header, ["file", "owner", "first"], "left_anti")
    return rows.where("file is null").select("text"), rest.where("text not in ('', '\\r')").select("text")
