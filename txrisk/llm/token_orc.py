"""Token ids of documents in ORC files.

One row per document: its id, its ids as ``array<int>`` (ORC stores them in
integer run-length encoding), their number and the position of the first id
among the ids of the same file.  Rows are in ascending ``doc_id`` order over
the files ``part`` 0, 1, ...; a row index and Bloom filters on ``doc_id`` let a
reader skip stripes and row groups, and every stripe can be read by a task of
its own.

Defined cases: null and empty texts hold the end id alone; a null ``doc_id``
comes last; rows with the same ``doc_id`` are ordered by text; repeated rows
are all kept; an empty table gives no rows.  Extra columns of the input are
not read.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.tokens import encoder
from txrisk.llm.units import bounded_batches, release_shuffles, slices
from txrisk.session import fresh_path

END = 2
ROW = "part int, doc_id long, pos long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(16 << 20),
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_rows(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Encoded documents, range partitioned and sorted by ``doc_id``."""

    def encode(batches):
        part, pos = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer, end)
        for batch in batches:
            texts = batch.column("text")
            for at, n in slices(texts):
                ids, size = enc.encode(texts.slice(at, n))
                upto = size.cumsum()
                yield pa.record_batch(
                    [
                        pa.array([part] * n, pa.int32()),
                        batch.column("doc_id").slice(at, n),
                        pa.array(pos + upto - size),
                        pa.array(size),
                        pa.ListArray.from_arrays(pa.array([0, *upto], pa.int32()), pa.array(ids.view("int32"))),
                    ],
                    ["part", "doc_id", "pos", "n_tokens", "ids"],
                )
                pos += int(upto[-1])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_last())
    return rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").mapInArrow(encode, ROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    token_rows(docs, tokenizer or default_tokenizer(), end).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them are skipped."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): the ids in all files before; one row per file."""
    per = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many they are and their checksum."""

    def sums(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            data = memoryview(ids.values.to_numpy()).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("part"), batch.column("doc_id"), batch.column("pos"), pa.array((ends[1:] - ends[:-1]).astype("int64")), pa.array(crc, pa.int64())],
                ["part", "doc_id", "pos", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).select("part", "doc_id", "pos", "ids")
    rows = rows.mapInArrow(sums, "part int, doc_id long, pos long, n_tokens long, ids_crc32 long")
    # as many rows as files were written
    return rows.join(file_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32"
    )


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: write the documents' ids and describe what the files hold."""
    release_shuffles(spark)  # the shuffle of the texts is done with when the ids are written
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path)
    return digest(spark, path)


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all ``documents`` as read back from their ORC files."""
    return stage_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
