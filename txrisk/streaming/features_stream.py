"""The stateless feature pipeline on a Structured Streaming source.

The transaction mapping, the rules and ``create_features`` are per-row
expressions, so they run unchanged on a ``readStream`` DataFrame.  The
stream (events) is joined with the static customer table (stream-static
inner join, no state), features are derived and written to Parquet with a
checkpoint in the shared folder, so a restarted query resumes where it
stopped and the sink gets every row exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators.features import create_features
from txrisk.session import fresh_path
from txrisk.sources.fixture import read_table, transactions_from


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the events table; schema taken from the batch table.

    The table may be a folder of part files, which is watched, or one file,
    whose folder is watched for that name.  ``max_files_per_trigger`` bounds
    a micro-batch.
    """
    table = read_table(spark, sf_dir, "events")
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    reader = spark.readStream.schema(table.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = table.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith("/events.parquet"):
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir.rstrip("/"))
    return reader.parquet(path)


FILES_PER_TRIGGER = 1000


def feature_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Streaming DataFrame of transaction features."""
    return create_features(transactions_from(event_stream(spark, sf_dir, max_files_per_trigger), read_table(spark, sf_dir, "customer")))


def start_feature_sink(stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start(out_path)


def run_feature_stream(spark: SparkSession, sf_dir: str, out_path: str | None = None) -> DataFrame:
    """Drain everything available through the streaming pipeline, then read
    the sink back as a batch table."""
    out_path = out_path or fresh_path(spark, "stream-features")
    query = start_feature_sink(feature_stream(spark, sf_dir), out_path, out_path + "-checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(out_path)
