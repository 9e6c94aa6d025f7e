"""Line de-duplication with a log-template tree.

Every line is a path in a tree of fixed depth: its number of tokens, then its
first ``DEPTH`` tokens; tokens with digits are variable fields and count as
``<*>``.  A leaf holds the distinct lines that agree so far.  In a leaf, a token is
a constant of its place if enough documents have it there, else a variable
field.  So each line has a template of constants and fields, and further ones with one more
of its constants as a field; a template is a template only if at least ``SIMILAR``
of its places are constant.  It recurs if enough documents have a line of it.
"Enough" is ``DOCUMENTS``; from ``LONG`` tokens on it is ``LONG_DOCUMENTS``, as so long a line
does not come about twice by chance.  Every line of a recurring template, and every
line that enough documents share as it is, is dropped from every document.

Nothing here depends on the order of lines or on the size of a leaf: constants and
templates are counts by key, so a leaf is never in one task.  Lines are counted as (leaf,
line) hashes by partial aggregates, so a line that a third of all documents share
is one row per task.  A template is the exclusive-or of its places' 64-bit hashes;
one more field is two more hashes, so a line of n tokens has n short rows.  Texts are split
and masked once; the masked lines are stored, and only those of leaves that can hold a
recurring template are read again (a bit table of ``2**LEAF_BITS`` leaf hashes, 2 MB,
leaves out the others, the join behind it is exact).

Defined cases: a null text has no lines and stays null; an empty text has one
empty line; lines without tokens are never dropped; a line that repeats within
one document counts once; rows without ``doc_id`` count as documents by their
text; repeated rows are one document if they share a ``doc_id``; an empty table
gives no rows.  Other columns are kept by :func:`drop_recurring`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.units import bounded_batches
from txrisk.session import fresh_path

DEPTH = 3
SIMILAR = 0.6
DOCUMENTS = 5
LONG, LONG_DOCUMENTS = 50, 2
LEAF_BITS = 24
FIELD = "<*>"


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, f"lines-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def masked(line: Column) -> Column:
    """A line with single spaces and ``<*>`` for tokens that hold a digit; most lines need neither change, which one search finds."""
    spaced = F.when(line.rlike(r"[\t\x0B\f\r]|  |^ | $"), F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)
    clean = F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(spaced)
    return F.when(line.rlike(r"[0-9\t\x0B\f\r]|  ") | line.startswith(" ") | line.endswith(" "), clean).otherwise(line)


def n_tokens(m: Column) -> Column:
    return F.octet_length(m) - F.octet_length(F.replace(m, F.lit(" "), F.lit(""))) + 1


def leaf(m: Column, depth: int) -> Column:
    return F.xxhash64(n_tokens(m), F.substring_index(m, " ", depth))


def document(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))


def lines(docs: DataFrame) -> DataFrame:
    """(doc, m, line, leaf, n): the lines with tokens, masked and hashed."""
    rows = docs.select(document().alias("doc"), F.explode(F.split("text", "\n")).alias("l"))
    rows = rows.where(F.col("l").rlike(r"\S")).select("doc", masked(F.col("l")).alias("m"))  # not by m, which would be made twice
    m = F.col("m")
    return rows.select("doc", "m", F.xxhash64(m).alias("line"), leaf(m, DEPTH).alias("leaf"), n_tokens(m).alias("n"))


def _bit(column: str) -> Column:
    return F.shiftright(column, 64 - LEAF_BITS) + (1 << (LEAF_BITS - 1))


def enough(n: Column, documents: Column) -> Column:
    """Whether so many documents make a line or template of ``n`` tokens a recurring one."""
    return documents >= F.when(n >= LONG, LONG_DOCUMENTS).otherwise(DOCUMENTS)


def possible(spark: SparkSession, stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(leaf, line, m, docs, n): the lines of leaves with several lines and enough documents."""
    shared = seen.groupBy("leaf").agg(F.count("*").alias("k"), F.sum("docs").alias("d"), F.max("n").alias("n"))
    shared = _kept(spark, shared.where((F.col("k") > 1) & enough(F.col("n"), F.col("d"))).select("leaf"), "leaves")
    words = shared.select(_bit("leaf").alias("b")).groupBy(F.shiftright("b", 6).alias("w"))
    bits = words.agg(F.expr("bit_or(shiftleft(1L, int(b % 64)))").alias("x")).toArrow()  # at most 2**(LEAF_BITS - 6) rows
    table = np.zeros(1 << (LEAF_BITS - 6), np.int64)
    table[bits.column("w").to_numpy()] = bits.column("x").to_numpy()
    mask = table.view(np.uint8)

    def may(batches):
        for batch in batches:
            b = batch.column("b").to_numpy()
            yield batch.filter(pa.array((mask[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)).select(["leaf", "line", "m"])

    few = stored.select("leaf", "line", "m", _bit("leaf").alias("b")).mapInArrow(may, "leaf long, line long, m string")
    few = few.groupBy("leaf", "line").agg(F.min("m").alias("m"))  # a frequent line is one row per task
    return few.join(seen, ["leaf", "line"]).join(shared, "leaf")


def templates(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(key, line, docs, n): every line with the keys of its templates; a key names its leaf, too."""
    place = rows.select("leaf", "line", "docs", "n", F.posexplode(F.split("m", " ")).alias("pos", "token"))
    place = place.select("leaf", "line", "docs", "n", "pos", F.xxhash64("pos", "token").alias("h"))
    place = _kept(spark, place, "places").withColumn("w", F.xxhash64("pos", F.lit(FIELD)))
    common = place.where("h != w").groupBy("leaf", "h").agg(F.sum("docs").alias("d"), F.max("n").alias("n"))
    common = _kept(spark, common.where(enough(F.col("n"), F.col("d"))).select(F.col("leaf").alias("l0"), F.col("h").alias("h0")), "constants")
    marked = place.join(common, (F.col("leaf") == F.col("l0")) & (F.col("h") == F.col("h0")), "left")
    line = Window.partitionBy("leaf", "line")  # a line's own tokens
    marked = marked.withColumn("constant", F.col("h0").isNotNull())
    marked = marked.withColumns({
        "whole": F.bit_xor(F.when(F.col("constant"), F.col("h")).otherwise(F.col("w"))).over(line), "constants": F.count_if("constant").over(line)
    })
    further = F.when(F.col("constant") & (F.col("pos") >= DEPTH) & (F.col("constants") - 1 >= SIMILAR * F.col("n")), F.col("whole").bitwiseXOR(F.col("h")).bitwiseXOR(F.col("w")))
    first = F.when((F.col("pos") == 0) & (F.col("constants") >= SIMILAR * F.col("n")), F.col("whole"))
    keys = marked.select("leaf", F.explode(F.array(first, further)).alias("key"), "line", "docs", "n").where("key is not null")
    return _kept(spark, keys.select(F.xxhash64("leaf", "key").alias("key"), "line", "docs", "n"), "keys")


def recurring(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, line) of all documents, and the lines (line) of recurring templates."""
    bounded_batches(spark)
    stored = _kept(spark, lines(docs), "lines")  # texts are split and masked once
    whose = _kept(spark, stored.select("doc", "line", "leaf", "n").distinct(), "seen")
    seen = _kept(spark, whose.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.max("n").alias("n")), "counted")
    alone = seen.where(enough(F.col("n"), F.col("docs"))).select("line")
    keys = templates(spark, possible(spark, stored, seen))
    # a template has at least the documents of its most frequent line and at most the sum of all
    size = keys.groupBy("key").agg(F.sum("docs").alias("most"), F.max("docs").alias("least"), F.count("*").alias("k"), F.max("n").alias("length"))
    size = size.where((F.col("k") > 1) & enough(F.col("length"), F.col("most")))
    size = size.select("key", enough(F.col("length"), F.col("least")).alias("sure"))
    known = _kept(spark, keys.join(_kept(spark, size, "sizes"), "key"), "candidates")
    open_ = known.where(~F.col("sure"))  # lines of few documents each
    counted = open_.select("key", "line", "n").join(whose.select("doc", "line"), "line")
    counted = counted.groupBy("key", "doc").agg(F.max("n").alias("n")).groupBy("key").agg(F.count("*").alias("d"), F.max("n").alias("n"))
    counted = counted.where(enough(F.col("n"), F.col("d"))).select("key")
    joint = known.where("sure").select("line").union(open_.join(_kept(spark, counted, "templates"), "key").select("line"))
    return whose, _kept(spark, alone.union(joint).distinct(), "recurring")


def drop_recurring(spark: SparkSession, docs: DataFrame, n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """``docs`` without the lines of recurring templates, and how many lines each had and lost."""
    whose, gone = recurring(spark, docs)
    drops = whose.join(gone, "line").groupBy("doc").agg(F.collect_set("line").alias("drops"))
    drops = _kept(spark, drops, "drops")
    rows = docs.select(F.struct(*docs.columns).alias("row"), document().alias("own"))  # the caller's names stay apart
    rows = rows.join(drops, F.col("own") == F.col("doc"), "left")
    every = F.split("row.text", "\n")
    left = F.filter(every, lambda x: F.coalesce(~F.array_contains("drops", F.xxhash64(masked(x))), F.lit(True)))
    rows = rows.withColumn("left", F.when(F.col("drops").isNull(), every).otherwise(left))
    had = F.coalesce(F.size(every), F.lit(0))
    lost = F.when(F.col("row.text").isNull(), 0).otherwise(had - F.size("left"))
    text = F.array_join("left", "\n").alias("text")
    out = [text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in (n_lines, n_dropped)]
    return rows.select(*out, had.alias(n_lines), lost.alias(n_dropped))


def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without recurring lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring(spark, docs, "n_lines", "n_dropped").select("doc_id", "n_lines", "n_dropped", "text")
