"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import fresh_path


def _kept(spark: SparkSession, df: DataFrame) -> DataFrame:
    path = fresh_path(spark, "edges")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def components(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (x, y) that is not its component's smallest.

    Each round joins every node's edges with its smallest neighbour; the
    smallest is found by a partial aggregate and a node of any degree is one
    key of a join that Spark can split.  The number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u != v").distinct()
    edges = _kept(spark, edges)
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(_kept(spark, low), F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _kept(spark, large.distinct())
        low = _kept(spark, large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"))
        small = large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = _kept(spark, small.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
