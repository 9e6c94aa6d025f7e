"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies,
``target / source size``.  The documents of a source are laid out in one fixed
order, their expected copies are prefix-summed, one offset per source is added,
and a document is emitted once per integer boundary its interval crosses.

The order is (size class, hash of the row): classes of a quarter octave spread
the copies evenly over short and long documents, so the words taken stay within
about one large document of the target.  The prefix sum is a rank times a
constant, and the rank is a sum of three: documents in earlier classes of the
source, documents in earlier hash blocks of the class, and the position in the
block.  No window holds more than one block, one class's blocks or one source's
classes, so a source (or one size) with a third of all rows is spread out.

Defined cases: null and empty text have size 0 and take part like any other row
(their copies carry no words); a null source is a source of its own, last in
order; a null ``doc_id`` is hashed as empty text; repeated rows are sampled one
by one; an empty table gives an empty result.  Working columns start with
``_mix_``; the input may have any other extra columns.  The offset comes from a
hash of the source, so reruns agree on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.units import release_shuffles
from txrisk.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK_ROWS = 512  # expected rows of one hash block
MAX_BLOCKS = 1 << 16  # blocks of one size class (the hash has 20 bits for them)
CLASSES = 260  # quarter octaves of a 64-bit size
RUN = 1000  # copies of one text that a row of work emits


def word_count(text: Column) -> Column:
    """Words of a text: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash52(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with its size, size class and order hash."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    out = docs.withColumns({"_mix_size": word_count(F.col("text")), "_mix_hash": _hash52(key)})
    cls = F.expr("shiftright(shiftleft(_mix_size, 2), length(bin(_mix_size)) - 1) + 4 * (length(bin(_mix_size)) - 1) - 3")
    return out.withColumn("_mix_cls", F.when(F.col("_mix_size") == 0, 0).otherwise(cls).cast("int"))


def targets(classes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size, target) per source from (source, class, n, size) counts.

    A target is ``least(cap * size, weight * level)``: sharing the excess anew
    until no source is above its cap ends at the one level for which the
    targets sum to ``share`` of all sizes.  One row per source is ordered in
    one task; documents are counted before.
    """
    per = classes.groupBy("source").agg(F.sum("size").alias("size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "size", w.alias("w"), (cap * F.col("size")).alias("cap"))
    per = per.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    room = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumns({"level": left / room, "at": F.row_number().over(order)})
    per = per.withColumn("fit", F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level")))
    level = F.coalesce(F.min("fit").over(whole)["level"], F.lit(float("inf")))
    return per.select("source", "size", F.least(F.col("cap").cast("double"), F.col("w") * level).alias("target"))


def mix(spark: SparkSession, rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``rows`` (from :func:`sized`) with source size, target and copies."""
    path = fresh_path(spark, "mix-classes")
    rows.groupBy("source", "_mix_cls").agg(F.count("*").alias("n"), F.sum("_mix_size").alias("size")).write.parquet(path)
    classes = spark.read.parquet(path)
    blocks = [1] * CLASSES  # by class: how many hash blocks keep about BLOCK_ROWS rows each
    for r in classes.groupBy("_mix_cls").agg(F.sum("n").alias("n")).collect():  # at most CLASSES rows
        blocks[r["_mix_cls"]] = max(1, min(MAX_BLOCKS, -(-r["n"] // BLOCK_ROWS)))
    n_blocks = F.element_at(F.array(*map(F.lit, blocks)), F.col("_mix_cls") + 1)
    rows = rows.withColumn("_mix_sub", F.shiftright(F.shiftright("_mix_hash", 32) * n_blocks, 20))

    key = ["source", "_mix_cls", "_mix_sub"]
    up = lambda *part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    per_class = classes.withColumn("before", so_far(up("source", by="_mix_cls"))).select("source", "_mix_cls", "before")
    goal = targets(classes, weights, share, cap)
    u = _hash52(F.concat(F.lit("mix:"), F.coalesce("source", F.lit("\x00")))) / F.lit(float(1 << 52))
    goal = goal.select(F.col("source").alias("s0"), F.col("size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), u.alias("_mix_u"))
    per_class = per_class.join(goal, F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
    per_class = per_class.withColumnsRenamed({"source": "s1", "_mix_cls": "c1"})
    per_block = rows.groupBy(*key).agg(F.count("*").alias("n"))
    per_block = per_block.withColumn("in_class", so_far(up("source", "_mix_cls", by="_mix_sub")))
    per_block = per_block.join(per_class, F.col("source").eqNullSafe(F.col("s1")) & (F.col("_mix_cls") == F.col("c1")))
    per_block = per_block.select(
        F.col("source").alias("_mix_s"), F.col("_mix_cls").alias("_mix_c"), F.col("_mix_sub").alias("_mix_b"),
        (F.col("before") + F.col("in_class")).alias("_mix_before"), "_mix_source_size", "_mix_target", "_mix_u",
    )
    inside = Window.partitionBy(*key).orderBy("_mix_hash", "doc_id", "_mix_size")
    out = rows.withColumn("_mix_rank", F.row_number().over(inside))
    same = F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_cls") == F.col("_mix_c")) & (F.col("_mix_sub") == F.col("_mix_b"))
    out = out.join(per_block, same)
    e = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    rank = F.col("_mix_before") + F.col("_mix_rank")
    crossed = F.floor(F.col("_mix_u") + rank * e) - F.floor(F.col("_mix_u") + (rank - 1) * e)
    return out.withColumn("_mix_copies", F.least(crossed, F.lit(cap).cast("long")))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per copy, with the given columns."""
    return mixed.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*columns)


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document contributes to the mix of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    path = fresh_path(spark, "mix-sized")
    sized(docs).drop("text").write.parquet(path)  # the texts are read once
    out = mix(spark, spark.read.parquet(path))
    return out.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").cast("long").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_copies") * F.col("_mix_size")).cast("long").alias("taken"),
    )


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, one row per copy.

    Copies are found on sizes alone, without the texts; equal rows have one name (a
    hash of all columns) and their copies are added up.  Texts are moved once, to
    meet their number of copies, and only those that the mix takes.
    """
    release_shuffles(spark)
    name = {"_mix_row_a": F.xxhash64(*docs.columns), "_mix_row_b": F.xxhash64(F.lit(1), *docs.columns)}
    sizes, found = fresh_path(spark, "mix-sizes"), fresh_path(spark, "mix-copies")
    sized(docs.withColumns(name).select("doc_id", "text", "source", *name)).drop("text").write.parquet(sizes)
    copies = mix(spark, spark.read.parquet(sizes)).groupBy(*name)
    copies.agg(F.sum("_mix_copies").alias("_mix_copies"), F.count("*").alias("_mix_rows")).where("_mix_copies > 0").write.parquet(found)
    copies = spark.read.parquet(found)
    named = docs.withColumns(name)
    out = emit(named.join(copies.where("_mix_rows = 1"), [*name]), docs.columns)
    repeated = copies.where("_mix_rows > 1")
    if repeated.isEmpty():
        return out
    # equal rows: one of them gives all copies, dealt in runs of at most RUN
    one = named.join(repeated, [*name], "left_semi").dropDuplicates([*name]).join(repeated, [*name])
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_mix_copies") - 1) / RUN))
    one = one.withColumn("_mix_run", F.explode(runs)).repartition("_mix_row_a", "_mix_run")
    left = F.least(F.col("_mix_copies") - F.col("_mix_run") * RUN, F.lit(RUN).cast("long"))
    return out.union(emit(one.withColumn("_mix_copies", left), docs.columns))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS h FROM documents),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE ((size << 2) >> (length(bin(size)) - 1)) + 4 * (length(bin(size)) - 1) - 3 END AS cls FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
    / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0))::DOUBLE AS level, row_number() OVER o AS pos, cap::DOUBLE / w AS ratio FROM w
  WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST),
    b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * (SELECT arg_min(level, pos) FROM l WHERE level <= ratio)) AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM l),
r AS (SELECT doc_id, size, source, row_number() OVER (PARTITION BY source ORDER BY cls, h, doc_id, size) AS k FROM c)
SELECT doc_id, size, source_size, target, size * least(2, floor(u + k * e) - floor(u + (k - 1) * e))::BIGINT AS taken
FROM (SELECT r.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
"""
