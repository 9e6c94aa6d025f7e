"""N-gram Jaccard self-join by filters under several global token orders.

A document's set is its distinct five-word shingles.  If two sets have a
Jaccard similarity of at least ``PERCENT`` / 100, then under *any* total order
of the shingles they share one among the first ``n - ceil(n * PERCENT / 100) +
1`` of each (its prefix).  The first order puts rare shingles first: it sorts by
the count of the shingle's bucket in a table of ``2**SKETCH_BITS`` counts over
all documents (1 MB, whatever the corpus), then by hash.  Any such function of
the shingle is a valid order, so the table affects speed, never the result.
Its prefixes give the candidates; the prefixes under ``ORDERS`` further orders
(different hash permutations) must also meet, or the pair is dropped before
its whole sets are compared.

Large groups of near copies are not expanded into all pairs, and no link
between components is lost:

1. documents with the same set are one node (the smallest ``doc_id``);
2. within each prefix shingle's list (and size class), every document is
   paired with the one whose shingle comes earliest in its prefix -- the one
   with the fewest rare shingles, so the centre of a group of near copies;
3. the pairs are filtered and verified, links give first components;
4. in the lists that still hold several components, all pairs across
   components are taken, filtered and verified.  Every linked pair meets in
   some list, so it is verified there or already within one component.

Lists are sorted inside window partitions that are salted where the count
table says that a shingle is frequent (the count is never too low), and
frequent lists get their centre by a partial aggregate and a join that Spark
can split.  Only the texts of candidate documents are moved, compressed: they take
a fifth of the room of their sets, which are rebuilt where a pair is verified.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing, not even each other; fewer than five words are one shingle; a
row without ``doc_id`` gets its set's component if a numbered document has the
same set, else null; rows that share a ``doc_id`` are classed by their own
texts; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.components import components
from txrisk.llm.units import SLICE_BYTES, bounded_batches, mixed, parts, shingle_sets
from txrisk.session import fresh_path

PERCENT = 75
SKETCH_BITS = 18
ORDERS = 2  # orders besides the first
ID_BITS = 24  # bits of the tables of document ids
SALT_ROWS = 2048  # rows of a frequent shingle's list in one window partition


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, f"jaccard-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _starts(ends: np.ndarray) -> np.ndarray:
    return ends - np.diff(ends, prepend=0)


def prefix_size(n):
    """How many first shingles of a set of ``n`` must hold one of any similar set's first ones."""
    return n - -(-PERCENT * n // 100) + 1


def survey(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2) per document: its set's size and fingerprint; n = -1: f2 shingles in bucket f1."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch, texts in parts(batches, "text"):
            sets, ends = shingle_sets(texts)
            begin, n = _starts(ends), np.diff(ends, prepend=0)
            sketch += np.bincount((sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(sets):
                full = n > 0
                f1[full] = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), begin[full])
                f2[full] = np.add.reduceat(mixed(sets ^ np.uint64(0x14057B7EF767814F)), begin[full])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), _signed(f1), _signed(f2)], ["doc_id", "n", "f1", "f2"])
        at = np.flatnonzero(sketch)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([nothing, pa.array(np.full(len(some), -1)), pa.array(some), pa.array(sketch[some])], ["doc_id", "n", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long")


def _bit(key: Column) -> Column:
    """The place of an id's bit."""
    return F.shiftright(F.xxhash64(key), 64 - ID_BITS) + (1 << (ID_BITS - 1))


def id_words(ids: DataFrame, column: str) -> DataFrame:
    """(w, bits): the words of a bit table that has a bit for every id of a column; at most 2**(ID_BITS - 5) rows."""
    got = ids.select(_bit(F.col(column)).alias("at")).select(F.shiftright("at", 5).alias("w"), (F.col("at") % 32).cast("int").alias("b"))
    return got.groupBy("w").agg(F.expr("bit_or(shiftleft(1L, b))").alias("bits"))


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bit table that has a bit for every id of a column (and maybe others): ``2**ID_BITS`` bits."""
    got = id_words(ids, column).toArrow()
    table = np.zeros(1 << (ID_BITS - 5), np.uint32)
    table[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return table


def with_bit(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at) of the documents: the place of an id's bit."""
    return docs.where("doc_id is not null").select("doc_id", "text", _bit(F.col("doc_id")).alias("at"))


def chosen(batches, table: np.ndarray):
    """The rows whose bit is set."""
    for batch in batches:
        at = batch.column("at").to_numpy()
        yield batch.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose ``doc_id`` is not among those of ``gone`` (distinct); rows without one stay.

    A row whose bit is not set stays where it is; only the others, the ones to drop and
    few more, are moved to be compared by their ids.  The table of bits has a fixed size
    (2 MB of bits), so every executor can have it, whatever the number of ids.
    """
    words = F.broadcast(id_words(gone, "doc_id").select(F.col("w").alias("_w"), F.col("bits").alias("_bits")))
    at = _bit(docs["doc_id"].cast("long"))
    marked = docs.join(words, F.shiftright(at, 5) == F.col("_w"), "left")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))
    stay, met = marked.where(~hit).drop("_w", "_bits"), marked.where(hit).drop("_w", "_bits")
    return stay.union(met.join(gone, met["doc_id"].cast("long") == gone["doc_id"], "left_anti"))


def postings(docs: DataFrame, nodes: np.ndarray, sketch: np.ndarray) -> DataFrame:
    """A row per prefix shingle of the documents in a bit table: its list, the document, set size, place in the prefix."""

    def run(batches):
        for batch, texts in parts(chosen(batches, nodes), "text"):
            sets, ends = shingle_sets(texts)
            ids = batch.column("doc_id").to_numpy()
            count = sketch[(sets >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            take, size = [], np.zeros(len(ids), np.int64)
            for i, (a, b) in enumerate(zip(_starts(ends).tolist(), ends.tolist(), strict=True)):
                if b > a:
                    p = prefix_size(b - a)
                    take.append(a + np.lexsort((sets[a:b], count[a:b]))[:p])
                    size[i] = p
            if not take:
                continue
            at, n = np.concatenate(take), np.diff(ends, prepend=0)
            doc = np.repeat(np.arange(len(ids)), size)
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            salts = -(-count[at] // SALT_ROWS)
            salt = np.where(salts > 1, mixed(ids[doc].astype(np.uint64)) % np.maximum(salts, 1).astype(np.uint64) + np.uint64(1), 0)
            # the doc's own numbers in one, first what its rows share: rows are three words wide and compress well
            packed = (n[doc].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
            yield pa.record_batch([_signed(sets[at]), pa.array(salt.astype(np.int32)), pa.array(ids[doc]), _signed(packed)], ["token", "salt", "doc", "np"])

    return with_bit(docs).mapInArrow(run, "token long, salt int, doc long, np long")


def unpacked(rows: DataFrame) -> DataFrame:
    """Set size, place in the prefix and size class of packed postings."""
    rows = rows.withColumns({"n": F.shiftright("np", 32).cast("int"), "place": F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")}).drop("np")
    return rows.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("short"))


def may_link(n1, p1, n2, p2):
    """Size and position filters for a shingle at places p1 and p2 of prefixes of sets of n1 and n2."""
    overlap = F.ceil((n1 + n2) * F.lit(PERCENT) / F.lit(100 + PERCENT) - F.lit(1e-9))
    return (PERCENT * F.greatest(n1, n2) <= 100 * F.least(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= overlap)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The filters under further orders, then the sets themselves."""
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    for k in range(ORDERS):
        x, y = (np.partition(mixed(s ^ np.uint64(0xA5A5A5A5 * (k + 1))), prefix_size(len(s)) - 1)[: prefix_size(len(s))] for s in (a, b))
        if len(np.intersect1d(x, y, assume_unique=True)) == 0:
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (x, y) of document ids whose sets are similar enough."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    wanted = id_bits(ids, "id")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in chosen(batches, wanted):
            texts = [squeeze((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary())], ["id", "t"])

    def check(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            size = np.cumsum([len(a) + len(b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)])
            cuts = np.unique([0, *(np.flatnonzero(np.diff(size // (SLICE_BYTES // 4))) + 1), batch.num_rows])
            for at, to in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                part = batch.slice(at, to - at)
                texts = [expand(t).decode() for c in ("a", "b") for t in part.column(c).to_pylist()]
                sets, ends = shingle_sets(pa.array(texts, pa.string()))
                begin, m = _starts(ends), part.num_rows
                good = [similar(sets[begin[i] : ends[i]], sets[begin[m + i] : ends[m + i]]) for i in range(m)]
                yield part.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    packed = with_bit(docs).mapInArrow(pack, "id long, t binary")
    one = pairs.join(packed.select(F.col("id").alias("x"), F.col("t").alias("a")), "x")
    two = one.join(packed.select(F.col("id").alias("y"), F.col("t").alias("b")), "y")
    return two.select("x", "y", "a", "b").mapInArrow(check, "x long, y long")


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = _kept(spark, survey(docs), "survey")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    counted = seen.where("n = -1").groupBy("f1").agg(F.sum("f2").alias("c")).toArrow()  # a row per bucket
    sketch[counted.column("f1").to_numpy()] = counted.column("c").to_numpy()
    rows = seen.where("n >= 0")
    nodes = _kept(spark, rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node")), "nodes")

    # 2: lists of more than one document, each row with its list's centre
    every = postings(docs, id_bits(nodes.where("node is not null"), "node"), sketch)
    every = unpacked(every.repartition("token", "salt"))
    whole = Window.partitionBy("token", "salt")
    inner = Window.partitionBy("token", "salt", "level").orderBy("place", "n", "doc")
    centre = F.struct("place", "n", "doc")
    lists = every.withColumn("c", F.first(centre).over(inner)).withColumn("rows", F.count("*").over(whole))
    lists = _kept(spark, lists.where("rows > 1 or salt > 0").drop("rows"), "lists")
    light = lists.where("salt = 0").select("doc", "n", "place", "c")
    heavy = lists.where("salt > 0").drop("c")
    centres = heavy.groupBy("token", "level").agg(F.min(centre).alias("c"))
    starred = light.union(heavy.join(centres, ["token", "level"]).select("doc", "n", "place", "c"))
    starred = starred.where((F.col("doc") != F.col("c.doc")) & may_link(F.col("n"), F.col("place"), F.col("c.n"), F.col("c.place")))
    first = starred.select(F.least("doc", "c.doc").alias("x"), F.greatest("doc", "c.doc").alias("y")).distinct()
    first = _kept(spark, first, "first")
    links = _kept(spark, verify(docs, first), "links")

    # 4: pairs across components that share a list
    root = components(spark, links)
    lists = lists.drop("c").join(root, F.col("doc") == F.col("node"), "left")
    lists = lists.select("token", "level", "doc", "n", "place", F.coalesce("root", "doc").alias("root"))
    lists = _kept(spark, lists, "rooted")
    mixed_lists = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    lists = _kept(spark, lists.join(mixed_lists, "token"), "mixed")
    l = lists.withColumn("level", F.explode(F.array(F.col("level"), (F.col("level") + 1).cast("short")))).alias("l")  # noqa: E741
    r = lists.alias("r")
    across = (
        (F.col("l.token") == F.col("r.token")) & (F.col("l.level") == F.col("r.level")) & (F.col("l.root") != F.col("r.root"))
        & ((F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.doc") < F.col("r.doc"))))
        & may_link(F.col("l.n"), F.col("l.place"), F.col("r.n"), F.col("r.place"))
    )
    more = l.join(r, across).select(F.least("l.doc", "r.doc").alias("x"), F.greatest("l.doc", "r.doc").alias("y")).distinct()
    more = _kept(spark, more.join(first, ["x", "y"], "left_anti"), "second")
    links = _kept(spark, links.union(verify(docs, more)), "all-links")
    root = components(spark, links)
    named = nodes.join(root, "node", "left").select("n", "f1", "f2", F.coalesce("root", "node").alias("component_id"))
    named = _kept(spark, named, "named").withColumnsRenamed({"n": "n0", "f1": "g1", "f2": "g2"})
    same = (F.col("n") == F.col("n0")) & (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    full = rows.where("n > 0").join(named, same).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op10_order_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that stay: of each class the smallest ``doc_id``, once; all with an empty set.

    Rows without ``doc_id`` stay unless a numbered document has the same set;
    of several such rows with the same text one stays.
    """
    found = _kept(spark, classes(spark, docs), "classes")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = without_ids(docs, gone)
    twice = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    nameless = found.where("doc_id is null")
    if twice.isEmpty() and nameless.isEmpty():
        return kept
    twice = _kept(spark, twice.withColumnRenamed("doc_id", "_twice"), "twice")
    kept = kept.join(twice, kept["doc_id"].cast("long") == F.col("_twice"), "left")
    single = kept.where("_twice is null and doc_id is not null").drop("_twice")
    repeated = kept.where("_twice is not null").drop("_twice").dropDuplicates(["doc_id"])
    return single.union(repeated).union(_without_id(spark, docs))


def _without_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows without ``doc_id``: those with a set of their own, one for each text; all with an empty set."""
    rows = _kept(spark, docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()), "nameless")
    named = classes(spark, rows.select(F.col("_row").alias("doc_id"), "text").union(docs.where("doc_id is not null").select(-1 - F.col("doc_id").cast("long"), "text")))
    own = named.where("doc_id >= 0").withColumn("alone", (F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_id"))).where("alone")
    return rows.join(own.select(F.col("doc_id").alias("_own")), F.col("_row") == F.col("_own"), "left_semi").drop("_row")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near duplicates."""
    return one_of_each(spark, docs)
