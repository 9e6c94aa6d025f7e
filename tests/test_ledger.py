"""A05, A06, A13, W04 from figures kept by file."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from txrisk.operators import analytics, profile
from txrisk.sources.ledger import FileLedger


def table(spark, low, high):
    """Rows in order of time; accounts come and go."""
    i = F.col("id")
    return spark.range(low, high).select(
        F.format_string("TXN%05d", i).alias("TransactionID"),
        F.when(i % 50 == 7, F.lit(None)).otherwise(F.format_string("ACC%03d", F.floor(i / 9))).alias("AccountID"),
        F.when(i % 11 != 0, (i * 37 % 1000) / 8.0 + 1e6).alias("Amount"), F.when(i % 13 == 0, float("nan")).otherwise(i * 1.5).alias("OldBalance"),
        F.lit(None).cast("double").alias("Nothing"), (i % 3 == 0).cast("int").alias("IsFraud"),
        F.element_at(F.array(F.lit("HIGH"), F.lit("LOW"), F.lit(None)), (i % 3 + 1).cast("int")).alias("Risk"),
        F.when(i % 4 != 0, F.concat(F.lit("Card "), (i % 5).cast("string"))).alias("CardUsed"),
    )


def near(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture()
def grown(spark, tmp_out):
    folder = tmp_out("grown")
    ledger = FileLedger(spark, folder, folder + "-ledger")

    def add(low, high, parts=3):
        table(spark, low, high).repartitionByRange(parts, "TransactionID").write.mode("append").parquet(folder)
        return ledger

    return add


def test_A05_A13_append_equals_a_full_run(spark, grown):
    ledger = grown(0, 300)
    assert len(ledger.extend()) == 3
    ledger = grown(300, 301, 1)
    assert len(ledger.extend()) == 1 and ledger.extend() == []
    ledger = grown(301, 900)
    ledger.extend()
    whole = spark.read.parquet(ledger.table)
    assert near(ledger.numeric_profile().collect()) == near(profile.numeric_profile(whole).select(*ledger.numeric_profile().columns).collect())
    assert near(ledger.profile_long().collect()) == near(profile.profile_long(whole).collect())
    got, want = ledger.dataset_summary().first(), analytics.dataset_summary(whole).first()
    assert (got.n_rows, got.n_columns) == (want.n_rows, want.n_columns) and got.fraud_mean == pytest.approx(want.fraud_mean)


def test_A05_only_new_files_are_read(spark, grown, monkeypatch):
    ledger = grown(0, 100)
    ledger.extend()
    grown(100, 200, 2)
    read = []
    reader = type(spark.read)
    parquet = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **kw: (read.append(paths), parquet(self, *paths, **kw))[1])
    new = ledger.extend()
    data = [p for paths in read for p in paths if "-ledger" not in p]
    assert len(new) == 2 and sorted(data) == new


def test_A05_merging_keeps_digits(spark, tmp_out):
    """Large means with small deviations: sums of squares would lose them."""
    folder = tmp_out("digits")
    ledger = FileLedger(spark, folder, folder + "-ledger")
    for k in range(3):
        spark.range(100).select((F.lit(1e9 + k) + F.col("id") / 1000).alias("x")).coalesce(1).write.mode("append").parquet(folder)
        ledger.extend()
    want = spark.read.parquet(folder).agg(F.stddev_samp("x")).first()[0]
    assert ledger.statistics().first().std == pytest.approx(want, rel=1e-9)


def test_A06_sketches_against_the_exact_count(spark, tmp_out):
    folder = tmp_out("accounts")
    ledger = FileLedger(spark, folder, folder + "-ledger")
    for k in range(4):  # overlapping accounts
        spark.range(k * 10_000, k * 10_000 + 20_000).select(F.concat(F.lit("ACC"), "id").alias("AccountID")).write.mode("append").parquet(folder)
        ledger.extend()
    assert ledger.dataset_summary().first().n_accounts == pytest.approx(50_000, rel=0.03)


def test_ledger_of_changed_removed_and_empty_files(spark, tmp_out):
    folder = tmp_out("changing").removeprefix("file:")
    for name, (low, high) in {"a": (0, 50), "b": (50, 120), "c": (0, 0)}.items():
        table(spark, low, high).coalesce(1).write.parquet(f"{folder}/part={name}")
    ledger = FileLedger(spark, folder, folder + "-ledger")
    assert len(ledger.extend()) == 3 and ledger.extend() == []
    assert ledger.dataset_summary().first().n_rows == 120
    table(spark, 50, 60).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part=b")
    assert ledger.dataset_summary().first().n_rows == 50  # the changed file is not known yet
    assert len(ledger.extend()) == 1 and ledger.dataset_summary().first().n_rows == 60
    for f in os.listdir(f"{folder}/part=a"):
        os.remove(f"{folder}/part=a/{f}")
    assert ledger.dataset_summary().first().n_rows == 10
    assert {r.key: r.n for r in ledger.value_counts().where("section = 'risk_distribution'").collect()} == {"HIGH": 3, "LOW": 3}


def test_ledger_ignores_what_a_failed_batch_left(spark, grown, monkeypatch):
    ledger = grown(0, 90)
    monkeypatch.setattr(FileLedger, "_figures", lambda self, *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.extend()
    monkeypatch.undo()
    assert len(ledger.extend()) == 3
    whole = spark.read.parquet(ledger.table)
    assert near(ledger.profile_long().collect()) == near(profile.profile_long(whole).collect())


def test_ledger_of_two_writers(spark, grown, monkeypatch):
    ledger = grown(0, 90)
    files = ledger.unknown()
    ledger.extend()
    monkeypatch.setattr(FileLedger, "unknown", lambda self: files)
    ledger.extend()  # a second writer that listed the files before the first one ended
    monkeypatch.undo()
    assert ledger.dataset_summary().first().n_rows == 90
    assert near(ledger.profile_long().collect()) == near(profile.profile_long(spark.read.parquet(ledger.table)).collect())


@pytest.mark.parametrize("k", [1, 3, 10, 10_000])
def test_W04_first_accounts_read_few_files(spark, grown, k):
    ledger = grown(0, 800, 8)
    ledger.extend()
    found, read = ledger.first_accounts(k)
    want = [r.AccountID for r in analytics.first_accounts(spark.read.parquet(ledger.table), k).collect()]
    assert [r.AccountID for r in found.collect()] == want
    assert len(read) <= (8 if k > 100 else 3 if k > 5 else 1)


def test_W04_files_out_of_order(spark, tmp_out):
    folder = tmp_out("mixed")
    table(spark, 0, 400).repartition(5, F.col("Amount")).write.parquet(folder)
    ledger = FileLedger(spark, folder, folder + "-ledger")
    ledger.extend()
    want = [r.AccountID for r in analytics.first_accounts(spark.read.parquet(folder)).collect()]
    assert [r.AccountID for r in ledger.first_accounts()[0].collect()] == want
