"""Audit of how filters interact, by truth tables.

With five filters there are 32 subsets of them and a document survives a subset
if it fails none of its filters.  So a document is a 32-bit word with a bit for
each subset that it survives, and the number of documents that survive a subset
is a positional popcount: how many words have that bit.  The words of a part (a
language) and label are added in carry-save form: three words become a sum word
and a carry word of twice the weight, for all 32 positions at once, until at most two
words of each weight are left, whose bits are read off.

Those 32 counts answer everything about every order of the filters.  After the
filters in a set S have run, n(S) documents are kept; filter x then removes n(S) -
n(S + x); documents that fail x are n({}) - n({x}); those that fail nothing
else are n(all but x) - n(all).

The failing filters of a document come from built-in functions over its whole text.
Whether an earlier document has the same text is found by the text's SHA-256:
the smallest id of each hash by a partial aggregate, joined back to the ids.  Only
hashes and ids are moved, and Spark splits a hash that a third of all rows
share.  The counts are per task and part, then summed; nothing is collected.

Defined cases: a null text counts as empty (it fails only A, and E after another
empty one); a null language is the part "", as is an empty one; documents without a
label are in no label count, and one with several labels has a label if any row
says so; a null id is neither smaller nor larger than another, so it never fails E nor
makes others fail; rows that share an id do not make each other fail; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import fresh_path

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SIGNS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
#: the word of a document by its failing filters: a bit for every subset without one of them
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)
LABELS = ("all", "good", "toxic")
PARTS_HELD = 256  # parts that a task sums up before it sends their counts


def failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SIGNS),
    )
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failed_filters(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed): one row per document, ``failed`` with a bit per filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("same"), failures(text).alias("failed"),
    )
    path = fresh_path(spark, "audit-failed")
    rows.write.parquet(path)  # the texts are read once
    rows = spark.read.parquet(path)
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    path = fresh_path(spark, "audit-copied")
    first.select(F.col("same").alias("copied"), "first").write.parquet(path)  # Spark splits hot keys of a join of tables, not of an aggregate
    first = spark.read.parquet(path)
    rows = rows.join(first, F.col("same") == F.col("copied"), "left")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select("doc_id", "part", (F.col("failed") + F.when(late, F.lit(1 << FILTERS.index("E"))).otherwise(0)).cast("int").alias("failed"))


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits, by carry-save adders."""
    counts = np.zeros(32, np.int64)
    level, weight = [words.astype(np.uint32)], 1
    while level:
        x = np.concatenate(level)
        carries = []
        while len(x) >= 3:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * m :]])
        for word in x:  # at most two of each weight
            counts += weight * ((int(word) >> np.arange(32)) & 1)
        level, weight = carries, 2 * weight
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """(part, all0.., good0.., toxic0..): documents of each part and label that survive each subset."""
    names = [f"{label}{s}" for label in LABELS for s in range(SUBSETS)]

    def send(held):
        parts = list(held)
        counts = np.array([held[p] for p in parts]).reshape(len(parts), -1)
        return pa.record_batch([pa.array(parts, pa.string()), *[pa.array(c) for c in counts.T]], ["part", *names])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            part, words = coded.indices.to_numpy(), WORDS[batch.column("failed").to_numpy()]
            has = [np.ones(len(part), bool), *[pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]]
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(len(coded.dictionary) + 1))
            for i, name in enumerate(coded.dictionary.to_pylist()):
                own = order[edges[i] : edges[i + 1]]
                held[name] = held.get(name, 0) + np.array([positional_popcount(words[own[h[own]]]) for h in has])
            if len(held) > PARTS_HELD:
                yield send(held)
                held = {}
        if held:
            yield send(held)

    counted = rows.select("part", "failed", "good", "toxic").mapInArrow(run, ", ".join(["part string", *[f"{n} long" for n in names]]))
    return counted.groupBy("part").agg(*[F.sum(n).alias(n) for n in names])


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filter's bit, bits of the filters before it) for every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, 1 << f, before))
            before |= 1 << f
    return out


REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts of :func:`survivors`."""
    plan = steps()
    names, step = pa.array([p[0] for p in plan]), pa.array([p[1] for p in plan], pa.int32())
    bit, before = np.array([p[2] for p in plan]), np.array([p[3] for p in plan])
    which = np.log2(bit).astype(int)

    def run(batches):
        for batch in batches:
            n = np.array([batch.column(i) for i in range(1, batch.num_columns)]).reshape(len(LABELS), SUBSETS, batch.num_rows)
            for i, part in enumerate(batch.column(0).to_pylist()):
                every, good, toxic = n[:, :, i]
                kept, removed = every[before | bit], every[before] - every[before | bit]
                failing = every[0] - every[bit]
                shapley = np.bincount(which, removed, len(FILTERS)).astype(np.int64)[which]
                cols = [
                    kept, removed, failing - removed, every[ALL ^ bit] - every[ALL],
                    good[before] - good[before | bit], toxic[before] - toxic[before | bit], shapley,
                ]
                yield pa.record_batch([pa.array([part] * len(plan)), names, step, *[pa.array(c) for c in cols]], [f.split()[0] for f in REPORT.split(", ")])

    return counts.mapInArrow(run, REPORT)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters keeps and removes in each place of each order, by part."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed_filters(spark, docs)
    return report(survivors(rows.join(marks, F.col("doc_id") == F.col("labelled"), "left")))


def op12_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction of the five filters over all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(spark, docs.select("doc_id", "text", "lang"), labels)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first, false)::INT AS failed FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN failed & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
