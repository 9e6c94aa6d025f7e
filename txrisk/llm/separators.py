"""Token counts by scanning flat token files for end-of-document ids.

A token file is a run of little-endian unsigned integers: the ids of documents
one after the other, each closed by the end id.  There is no index.  Files are
cut into blocks of ``BLOCK_BYTES``, which tasks read by themselves; a block's
end ids are found with one vectorised comparison.  A block reports its tokens,
its end ids and the tokens after the last one; a prefix scan over the blocks (a
row each) gives the number of documents before a block and the tokens that the
document open at its beginning already has, and so stitches documents that
cross any number of blocks and files.

Files are written by tasks into the shared folder under a name of their own
for every attempt; the list of files is what the successful attempts returned,
so a lost executor leaves no wrong data.

Defined cases: null and empty texts are documents of 0 tokens (the end id is
not counted); tokens after the last end id are one more document, ``closed``
false; empty files and an empty list of files give no rows; repeated rows are
documents of their own; a null ``doc_id`` is carried.  Extra columns of the
input are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.token_orc import default_tokenizer
from txrisk.llm.tokens import encoder
from txrisk.llm.units import bounded_batches, parts
from txrisk.session import fresh_path

END = 50256
WIDTH = 2  # bytes of an id
BLOCK_BYTES = 8 << 20


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def write_flat(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Token files of the documents: (part, path, bytes) of each file, (part, place, doc_id) of each document."""
    folder = _uri(folder)
    bounded_batches(spark)

    def encode(batches):
        part, place, written = TaskContext.get().partitionId(), 0, 0
        enc, out, path = encoder(tokenizer, end, ordinary=True), None, None  # no text holds an end id
        for batch, texts in parts(batches, "text"):
            if out is None:
                fs, base = _open(folder)
                fs.create_dir(base, recursive=True)
                path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.bin"
                out = fs.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")
            ids = enc.encode(texts)[0]
            if int(ids.max(initial=0)) >> (8 * WIDTH):
                raise ValueError(f"the tokenizer has ids of more than {WIDTH} bytes")
            data = ids.astype(f"<u{WIDTH}").tobytes()
            out.write(data)
            written += len(data)
            n = batch.num_rows
            nothing = [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array(np.arange(place, place + n)), batch.column("doc_id"), *nothing], names)
            place += n
        if out is not None:
            out.close()
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([path]), pa.array([written])], names
            )

    names = ["part", "place", "doc_id", "path", "bytes"]
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    listed = fresh_path(spark, "flat-list")
    rows.mapInArrow(encode, "part int, place long, doc_id long, path string, bytes long").write.parquet(listed)
    rows = spark.read.parquet(listed)
    return rows.where("path is not null").select("part", "path", "bytes"), rows.where("path is null").select("part", "place", "doc_id")


def scan(files: DataFrame, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(part, block, kind, n, ends): kind 0: a block's tokens after its last end id, and its number of end ids;
    kind 1: the tokens before its first one; kind 2: those of its k-th whole document, in ``ends``."""
    per = block_bytes // width * width
    blocks = files.where("bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / per).cast("long"))))
    blocks = blocks.select("part", "path", "block", F.least(F.lit(per), F.col("bytes") - F.col("block") * per).alias("size"))
    blocks = blocks.repartition(F.col("part"), F.col("block"))

    def read(batches):
        for batch in batches:
            for part, path, block, size in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "block", "size")), strict=True):
                fs, place = _open(path)
                with fs.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(size, block * per), f"<u{width}")
                at = np.flatnonzero(ids == end)
                inner = np.diff(at) - 1
                kind = np.concatenate([[0], [1] * (len(at) > 0), np.full(len(inner), 2)])
                n = np.concatenate([[len(ids) - at[-1] - 1 if len(at) else len(ids)], at[:1], inner])
                order = np.concatenate([[len(at)], [0] * (len(at) > 0), np.arange(1, len(inner) + 1)])
                same = [pa.array(np.full(len(n), v)) for v in (part, block)]
                yield pa.record_batch([*same, *(pa.array(x.astype(np.int64)) for x in (kind, n, order))], ["part", "block", "kind", "n", "ends"])

    return blocks.mapInArrow(read, "part long, block long, kind long, n long, ends long")


def count(spark: SparkSession, files: DataFrame, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(document, start, n_tokens, closed) of every document in the files taken in order of ``part``:
    its number, its first id among all ids, its ids without the end id, whether it has one.  The file in
    which it ends is ``part``."""
    path = fresh_path(spark, "scan")
    scan(files, end, width, block_bytes).write.parquet(path)
    found = spark.read.parquet(path)
    order = Window.orderBy("part", "block")  # a row per block
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    own = found.where("kind = 0").select("part", "block", F.col("n").alias("tail"), "ends")
    size = found.where("kind > 0").groupBy("part", "block").agg(F.sum(F.col("n") + 1).alias("closed"))
    own = own.join(size, ["part", "block"], "left").withColumn("total", F.col("tail") + F.coalesce("closed", F.lit(0)))
    upto = F.sum("tail").over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("sum", upto).withColumn("reset", F.when(F.col("ends") > 0, F.col("sum") - F.col("tail")))
    own = own.select(
        "part", "block", "tail", "ends",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"),
        (F.col("sum") - F.col("tail") - F.coalesce(F.last("reset", ignorenulls=True).over(before), F.lit(0))).alias("open"),
        F.lead("block").over(order).isNull().alias("last"),
    )
    place = fresh_path(spark, "scan-blocks")
    own.write.parquet(place)
    own = spark.read.parquet(place)
    rows = found.where("kind > 0").select("part", "block", "n", F.col("ends").alias("k")).join(own, ["part", "block"])
    in_block = Window.partitionBy("part", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("n") + 1).over(in_block), F.lit(0))
    first = F.col("k") == 0
    rows = rows.select(
        "part",
        (F.col("documents") + F.col("k")).alias("document"),
        (F.col("base") + inside - F.when(first, F.col("open")).otherwise(0)).alias("start"),
        (F.col("n") + F.when(first, F.col("open")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("closed"),
    )
    rest = F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(F.col("open"))
    total = F.col("base") + F.when(F.col("ends") > 0, 0).otherwise(-F.col("open"))
    left = own.where(F.col("last") & (rest > 0)).join(size.withColumnsRenamed({"part": "p", "block": "b"}), (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")), "left")
    left = left.select(
        "part",
        (F.col("documents") + F.col("ends")).alias("document"),
        (total + F.when(F.col("ends") > 0, F.coalesce("closed", F.lit(0))).otherwise(0)).alias("start"),
        rest.alias("n_tokens"),
        F.lit(False).alias("closed"),
    )
    return rows.union(left)


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all ``documents``, found by scanning their token files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files, written = write_flat(spark, docs, fresh_path(spark, "flat"), default_tokenizer())
    counted = count(spark, files)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = written.groupBy("part").agg(F.count("*").alias("n"))  # a row per file
    first = first.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    named = written.join(first, F.col("part") == F.col("p")).select("doc_id", (F.col("first") + F.col("place")).alias("document"))
    return counted.join(named, "document").select("doc_id", "document", "start", "n_tokens")
