"""A09 on a stream: the account summary kept up to date by micro-batches.

The state of an account is its first row so far, its number of rows and its fraud
count: a row of fixed size, held by Spark's keyed state in RocksDB, so that the
number of accounts is bounded by the executors' disks and not by their memory.  A
micro-batch shuffles one partial row per task and account and changes only the
accounts that it holds.  Their new rows are written under the batch's number; a
batch that is done again after a failure overwrites its own folder.  The summary
is each account's row of the latest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txrisk import schema as S
from txrisk.functions.columns import account_risk_level, numeric_value
from txrisk.operators.accounts import SUMMARY_FIELDS, row_order
from txrisk.session import fresh_path
from txrisk.sources.fixture import read_table, transactions_from
from txrisk.streaming.features_stream import FILES_PER_TRIGGER, event_stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_account_sink(stream: DataFrame, out_path: str, checkpoint: str, order_by: str | None = None) -> StreamingQuery:
    """Drain what is there into ``out_path``; the same checkpoint goes on where an earlier query ended."""
    spark = stream.sparkSession
    order = row_order(stream, "account_stream", order_by)
    place = F.struct(order[0].isNull().alias("missing"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    fields = [F.col(src) if src in stream.columns else F.lit(default) for src, default in SUMMARY_FIELDS.values()]
    row = F.struct(place.alias("place"), *[c.alias(o) for o, c in zip(SUMMARY_FIELDS, fields, strict=True)])
    fraud = F.coalesce(F.sum(numeric_value(stream, "IsFraud").cast("long")), F.lit(0)) if "IsFraud" in stream.columns else F.lit(0).cast("long")
    states = stream.groupBy("AccountID").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("TransactionCount"), fraud.alias("FraudCount"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_path}/batch={batch}")

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query takes the setting along when it starts
        writer = states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_accounts(spark: SparkSession, out_path: str, limit: int | None = S.ACCOUNT_LIMIT) -> DataFrame:
    """A09 from the sink: the rows of ``accounts.account_summary``."""
    stored = spark.read.parquet(out_path)
    state = F.struct("batch", "first", "TransactionCount", "FraudCount")
    last = stored.groupBy("AccountID").agg(F.max_by(state, "batch").alias("s")).select("AccountID", "s.*")
    if limit is not None:
        last = last.orderBy("first.place", "AccountID").limit(limit)
    last = last.where(F.col("AccountID").isNotNull())
    kinds = {"AccountName": "string"}
    named = [F.col(f"first.{k}").cast(kinds.get(k, "double")).alias(k) for k in SUMMARY_FIELDS]
    return last.select("AccountID", *named, "TransactionCount", "FraudCount", account_risk_level(F.col("FraudCount")).alias("RiskLevel"))


def run_account_stream(spark: SparkSession, sf_dir: str, out_path: str | None = None, limit: int | None = None, files: int = FILES_PER_TRIGGER) -> DataFrame:
    """Drain the event stream into the account states, then read the summary."""
    out_path = out_path or fresh_path(spark, "stream-accounts")
    stream = transactions_from(event_stream(spark, sf_dir, files), read_table(spark, sf_dir, "customer"))
    query = start_account_sink(stream, out_path, out_path + "-checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return read_accounts(spark, out_path, limit)
