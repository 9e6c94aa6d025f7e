"""Aggregates, filters, ordering."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txrisk.operators import analytics as A
from txrisk.operators.rules import derive_risk


def test_A01_order_and_null_group(spark):
    data = [("a", 1), ("a", 0), ("b", 1), ("b", 1), (None, 0), (None, 1), (None, 1)]
    df = spark.createDataFrame(data, "CardUsed string, IsFraud int")
    out = [(r.CardUsed, r.total_transactions, r.fraud_count, r.fraud_rate) for r in A.card_fraud(df).collect()]
    assert out == [("b", 2, 2, 100.0), (None, 3, 2, 66.67), ("a", 2, 1, 50.0)]
    sql = [tuple(r) for r in A.card_fraud_sql(df).collect()]
    assert sql == out


def test_A01_types(spark, tx):
    types = dict(A.card_fraud(tx).dtypes)
    assert types == {"CardUsed": "string", "total_transactions": "bigint", "fraud_count": "bigint", "fraud_rate": "double"}


def test_A02_mode_risk(spark):
    df = spark.createDataFrame([("m", 1, 10.0), ("m", 0, 30.0), ("n", 0, 5.0)], "TransactionMode string, IsFraud int, Amount double")
    out = [tuple(r) for r in A.mode_risk(df).collect()]
    assert out == [("m", 2, 1, 20.0, 50.0), ("n", 1, 0, 5.0, 0.0)]
    assert [tuple(r) for r in A.mode_risk_sql(df).collect()] == out


def test_A03_drops_missing_and_orders(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,), ("a",)], "c string")
    assert [tuple(r) for r in A.value_counts(df, "c").collect()] == [("y", 2), ("a", 1), ("x", 1)]


def test_A03_totals_equal_non_missing(spark, tx):
    total = A.value_counts(tx, "CardUsed").agg(F.sum("count")).first()[0]
    assert total == tx.where(F.col("CardUsed").isNotNull()).count()


def test_A04_nonmissing_denominator(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 0), (None, 1)], "CardUsed string, IsFraud int")
    out = [(r.CardUsed, r.fraud_rate, r.band) for r in A.fraud_rate_by_card(df).collect()]
    assert out == [("a", 100.0, "danger"), ("b", 0.0, "success")]


def test_A06_missing_account_counts_once(spark):
    df = spark.createDataFrame([("A", 1), ("B", 0), (None, 0), (None, 1)], "AccountID string, IsFraud int")
    r = A.dataset_summary(df).first()
    assert (r.n_rows, r.n_columns, r.n_accounts, r.fraud_mean) == (4, 2, 3, 0.5)


def test_A07_empty_table_zero_guard(spark):
    df = spark.createDataFrame([], "Amount double, IsFraud int")
    r = A.kpis_labelled(df).first()
    assert (r.total_transactions, r.fraud_count, r.fraud_rate, r.high_risk_amount) == (0, 0, 0.0, 0.0)
    assert r.avg_transaction is None


def test_A07_absent_columns(spark):
    df = spark.createDataFrame([("x",)], "note string")
    r = A.kpis_labelled(df).first()
    assert (r.total_transactions, r.fraud_count, r.fraud_rate, r.avg_transaction, r.high_risk_amount) == (1, 0, 0.0, 0.0, 0.0)


def test_A01_sums_to_A07(spark, tx):
    by_card = A.card_fraud(tx).agg(F.sum("fraud_count")).first()[0]
    assert by_card == A.kpis_labelled(tx).first().fraud_count


@pytest.mark.parametrize(
    "schema,data,expected",
    [
        (  # upload_full
            "TransactionID string, Amount double, Risk string, CardUsed string, TransactionMode string",
            [("t1", 10.0, "HIGH", "c", "m"), ("t2", 30.0, "LOW", "c", "m"), ("t3", 5.0, "HIGH", None, "m")],
            (3, 2, 200.0 / 3, 15.0, 15.0),
        ),
        (  # upload_amount_taken
            "AmountTaken double, Risk string",
            [(10.0, "HIGH"), (20.0, "LOW")],
            (2, 1, 50.0, 15.0, 10.0),
        ),
        (  # upload_numeric_only: first numeric column, no high-risk amount
            "x double, note string",
            [(1.0, "a"), (3.0, "b")],
            (2, 0, 0.0, 2.0, 0.0),
        ),
        (  # upload_text_only
            "note string",
            [("a",), ("b",)],
            (2, 0, 0.0, 0.0, 0.0),
        ),
    ],
)
def test_A08_kpis_risk_branches(spark, schema, data, expected):
    df = spark.createDataFrame(data, schema)
    r = A.kpis_risk(df).first()
    got = (r.total_transactions, r.fraud_count, r.fraud_rate, r.avg_transaction, r.high_risk_amount)
    assert got[:2] == expected[:2]
    assert got[2:] == pytest.approx(expected[2:])


def test_A08_after_derive_counts_derived_high(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double")
    r = A.kpis_risk(derive_risk(df)).first()
    assert r.fraud_count == 1  # 9.0 falls in the HIGH bin


def test_A11_A12_without_risk(spark):
    df = spark.createDataFrame([(1.0,)], "Amount double")
    assert tuple(A.high_risk_amount(df).first()) == (0, 0.0)


def test_A16_missing_columns_named(spark):
    df = spark.createDataFrame([("x",)], "Amount string")
    with pytest.raises(A.MissingColumns) as err:
        A.card_fraud(df)
    assert err.value.missing == ["CardUsed", "IsFraud"]


def test_P29_share_sums_to_100(spark, tx):
    shares = A.risk_share(tx).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(100.0, abs=0.2)


def test_F01_to_F04(spark, tx):
    assert A.filter_account(tx, "ACC007").where(F.col("AccountID") != "ACC007").count() == 0
    assert A.filter_high_risk(tx).count() == tx.where("Risk = 'HIGH'").count()
    assert A.filter_fraud(tx).count() == tx.where("IsFraud = 1").count()
    assert A.filter_isin(tx, "Location", ["Russia"]).where("Location <> 'Russia'").count() == 0


def test_F06_unknown_account_is_empty(spark, tx):
    assert A.filter_account(tx, "ACC999999").count() == 0


def test_W04_first_accounts_by_appearance(spark):
    data = [("TXN00003", "C"), ("TXN00001", "B"), ("TXN00002", "A"), ("TXN100000", "D"), ("TXN99999", "E")]
    df = spark.createDataFrame(data, "TransactionID string, AccountID string")
    assert [r.AccountID for r in A.first_accounts(df, 4).collect()] == ["B", "A", "C", "E"]


def test_W05_distinct(spark, tx):
    assert A.distinct_accounts(tx).count() == A.dataset_summary(tx).first().n_accounts


def test_float_label_with_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 0.0)], "CardUsed string, IsFraud double")
    assert {r.CardUsed: r.fraud_count for r in A.card_fraud(df).collect()} == {"a": 1, "b": 0}
    assert {r.CardUsed: r.fraud_rate for r in A.fraud_rate_by_card(df).collect()} == {"a": 100.0, "b": 0.0}
    assert A.kpis_labelled(df.withColumn("Amount", F.lit(1.0))).first().fraud_count == 1


def test_A06_approximate_distinct_close(spark, tx):
    exact = A.dataset_summary(tx).first().n_accounts
    approx = A.dataset_summary(tx, approximate=True).first().n_accounts
    assert abs(approx - exact) <= max(2, 0.05 * exact)


def test_P29_share_when_every_count_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")  # equal-width bins of nothing
    got = {r.Risk: (r["count"], r.share) for r in A.risk_share(df).collect()}
    assert got == {"LOW": (0, None), "MEDIUM": (0, None), "HIGH": (0, None)}
