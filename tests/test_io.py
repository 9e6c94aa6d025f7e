"""Readers, writers, upload checks, smoke query."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from txrisk.sources import io


def test_S01_S05_csv_round_trip(spark, tx, tmp_out):
    path = io.write_transactions(tx, tmp_out("rt") + ".csv", "csv")
    back = io.read_transactions(spark, path, "csv", schema=tx.schema)
    assert back.schema == tx.schema or [f.dataType for f in back.schema] == [f.dataType for f in tx.schema]
    assert back.exceptAll(tx).count() == 0 and tx.exceptAll(back).count() == 0


def test_S01_parquet_round_trip(spark, tx, tmp_out):
    path = io.write_transactions(tx, tmp_out("pq"))
    back = io.read_transactions(spark, path)
    assert back.exceptAll(tx).count() == 0 and back.count() == tx.count()


def test_S02_inferred_types_and_na_tokens(spark, tmp_out):
    import os

    d = tmp_out("upload-dir").replace("file:", "")
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, "x.csv")
    with open(p, "w") as fh:
        fh.write(
            "Amount,CardUsed,Risk,n,gappy,flag,ts\n"
            "10,Visa,HIGH,1,1,True,2024-01-01 10:00:00\n"
            "20.5,NA,LOW,2,NA,False,2024-01-02 11:00:00\n"
            ",N/A,HIGH,3,3,True,garbage\n"
        )
    df = io.read_csv_inferred(spark, p)
    assert dict(df.dtypes) == {
        "Amount": "double",
        "CardUsed": "string",
        "Risk": "string",
        "n": "bigint",
        "gappy": "double",
        "flag": "boolean",
        "ts": "string",
    }
    assert [r.CardUsed for r in df.collect()] == ["Visa", None, None]
    assert df.where(F.col("Amount").isNull()).count() == 1


@pytest.mark.parametrize(
    "path,message", [(None, "No file provided"), ("", "No file selected"), ("data/x.txt", "Please upload a CSV file")]
)
def test_S03_upload_rejections(spark, path, message):
    with pytest.raises(io.UploadError, match=message):
        io.read_csv_inferred(spark, path)


def test_S04_load_or_materialize(spark, tx, tmp_out):
    path = tmp_out("mat")
    built = []

    def build():
        built.append(1)
        return tx

    first = io.load_or_materialize(spark, path, build)
    second = io.load_or_materialize(spark, path, build)
    assert built == [1]
    assert first.count() == second.count() == tx.count()


def test_S07_S08_register_and_records(spark, tx):
    io.register(tx, "transactions_t")
    recs = io.to_records(spark.sql("SELECT CardUsed, count(*) AS n FROM transactions_t GROUP BY CardUsed"), limit=10)
    assert sum(r["n"] for r in recs) == tx.count()


def test_S09_json(spark):
    df = spark.createDataFrame([("A", 1.5)], "AccountID string, NewBalance double")
    assert json.loads(io.as_json(df).first().json) == {"AccountID": "A", "NewBalance": 1.5}


def test_S10_smoke(spark):
    assert io.smoke(spark) == 100


def test_S11_active_dataset(spark, tx):
    up = tx.limit(1)
    assert io.active_dataset(tx, None) is tx
    assert io.active_dataset(tx, up) is up


def test_S01_csv_nan_becomes_null_parquet_keeps_pushdown(spark, tmp_out):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "i int, Amount double")
    back = io.read_transactions(spark, io.write_transactions(df, tmp_out("nan") + ".csv", "csv"), "csv", df.schema)
    assert sorted((r.i, r.Amount) for r in back.collect()) == [(1, None), (2, 3.0)]
    stored = io.read_transactions(spark, io.write_transactions(df, tmp_out("nan-pq")))
    plan = stored.where(F.col("Amount") > 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Amount,2.0)" in plan


def test_S01_reference_csv_layout(spark, tmp_out):
    """The reference's stored table (19 columns, integer balances, text timestamps) reads as is."""
    import os

    from txrisk.operators import analytics as A
    from txrisk.operators import features as FE

    d = tmp_out("ref-layout").replace("file:", "")
    os.makedirs(d, exist_ok=True)
    p = os.path.join(d, "bank_transactions_dataset.csv")
    header = (
        "TransactionID,Timestamp,AccountID,AccountName,OldBalance,NewBalance,Amount,CardUsed,TransactionMode,"
        "Location,MerchantCategory,DeviceType,UserBehaviorScore,TransactionStatus,AmountTaken,Hour,IsFraud,Risk,Probability"
    )
    rows = [
        "TXN00001,2024-05-01 03:15:00,ACC001,Customer 1,12000,11000,1000,Credit Card,ATM Withdrawal,Russia,ATM,ATM,0.25,Completed,1000,3,1,HIGH,88.5",
        "TXN00002,2024-05-04 14:00:00,ACC001,Customer 1,5000,4800,200,Debit Card,POS Swipe,Texas,Retail,Mobile,0.8,Failed,200,14,0,LOW,12.0",
    ]
    with open(p, "w") as fh:
        fh.write("\n".join([header, *rows]) + "\n")
    df = io.read_transactions(spark, p, "csv")
    feats = FE.create_features(df).orderBy("TransactionID").collect()
    assert [(r.Hour, r.DayOfWeek, r.IsNight, r.IsWeekend, r.CountryRiskScore) for r in feats] == [
        (3, 2, 1, 0, 1.0),
        (14, 5, 0, 1, 0.1),
    ]
    assert [tuple(r) for r in A.card_fraud(df).collect()] == [("Credit Card", 1, 1, 100.0), ("Debit Card", 1, 0, 0.0)]
