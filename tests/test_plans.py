"""Plan checks: pruning, pushdown, no Python UDF, no cartesian products."""

from __future__ import annotations

import pytest
from places import SF001

from txrisk.operators import analytics as A
from txrisk.plans import catalog
from txrisk.sources import io
from txrisk.sources.fixture import transactions_from, read_table

# these train a forest at plan-build time; their scoring plans are pyspark.ml's own
SKIP = {"train_model", "train_accuracy", "model_round_trip", "score_transactions"}
FORBIDDEN = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in catalog.queries() if k not in SKIP))
def test_no_python_udf_no_cartesian(spark, key):
    plan = plan_of(catalog.queries()[key](spark, SF001))
    for word in FORBIDDEN:
        assert word not in plan, f"{key}: {word} in plan"


def test_card_fraud_prunes_columns(spark, tx, tmp_out):
    stored = io.read_transactions(spark, io.write_transactions(tx, tmp_out("prune")))
    plan = plan_of(A.card_fraud(stored))
    assert "ReadSchema: struct<CardUsed:string,IsFraud:int>" in plan


def test_mode_risk_prunes_columns(spark, tx, tmp_out):
    stored = io.read_transactions(spark, io.write_transactions(tx, tmp_out("prune2")))
    plan = plan_of(A.mode_risk(stored))
    assert "ReadSchema: struct<Amount:double,TransactionMode:string,IsFraud:int>" in plan


def test_fixture_join_falls_back_to_shuffle_join(spark):
    """Without a size proof (threshold off) the dimension is not broadcast."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        df = transactions_from(read_table(spark, SF001, "events"), read_table(spark, SF001, "customer"))
        plan = plan_of(df)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_account_roll_up_has_partial_aggregation(spark, tx):
    from txrisk.operators.accounts import account_summary

    plan = plan_of(account_summary(tx))
    assert "partial_min_by" in plan or "partial_min" in plan


def test_salted_join_same_rows(spark, tx):
    from txrisk.sources.fixture import transactions

    salted = transactions(spark, SF001, salt_buckets=4)
    assert salted.count() == tx.count()
    assert salted.exceptAll(tx).count() == 0


def test_salted_join_spreads_a_hot_key(spark):
    from pyspark.sql import functions as F

    from txrisk.plans.joins import join_dimension

    fact = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id"))
    dim = spark.createDataFrame([(7, "hot")], "c_custkey long, c_name string")
    joined = join_dimension(fact, dim, "user_id", "c_custkey", salt_buckets=8, salt_columns=["event_id"])
    assert joined.count() == 3000
    per_salt = fact.select(F.pmod(F.xxhash64("event_id"), F.lit(8)).alias("s")).groupBy("s").count().collect()
    assert len(per_salt) == 8 and max(r["count"] for r in per_salt) < 3000 / 4


def test_scaled_conf_sizes():
    from txrisk.session import scaled_conf

    big = scaled_conf(100 * 2**40, 8000)  # 100 TB on 8,000 cores
    assert big["spark.sql.shuffle.partitions"] == "819200"  # 128 MB each, whatever the size
    small = scaled_conf(2 * 2**20, 8)
    assert small["spark.sql.shuffle.partitions"] == "24"
    assert big["spark.sql.files.maxPartitionBytes"] == str(128 << 20)


def test_scaled_conf_applies_at_runtime(spark, tx):
    from txrisk.session import scaled_conf

    settings = scaled_conf(2 * 2**40, 64)
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)  # all are runtime SQL settings
        assert A.card_fraud(tx).count() == 5
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
