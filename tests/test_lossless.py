"""CSV dialect, NaN, stale listings, order columns, caps and plans: one test for each way a row could get lost or wrong."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import tempfile

import pytest
from places import ROOT, SF001
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import parse_timestamp
from txrisk.operators import accounts, analytics, features, model, profile
from txrisk.plans import catalog
from txrisk.plans.dashboard import dashboard, page_records
from txrisk.session import shared_dir
from txrisk.sources import fixture, io
from txrisk.streaming.features_stream import run_feature_stream


def csv_file(text: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-test-"), "t.csv")
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- CSV in ---------------------------------------------------------------------
def test_quotes_commas_and_line_breaks(spark):
    df = io.read_csv_inferred(spark, csv_file('id,note\n1,"a, b"\n2,"say ""hi"" ok, yes"\n3,"two\nlines"\n'))
    assert rows(df) == [(1, "a, b"), (2, 'say "hi" ok, yes'), (3, "two\nlines")]


def test_declared_columns_are_found_by_name(spark):
    df = io.read_transactions(spark, csv_file("AccountID,Amount,TransactionID,other\nACC001,5.5,TXN1,x\n"), "csv")
    r = df.first()
    assert (r.TransactionID, r.AccountID, r.Amount, r.CardUsed) == ("TXN1", "ACC001", 5.5, None)


def test_more_fields_than_the_header_are_an_error(spark):
    with pytest.raises(io.UploadError):
        io.read_csv_inferred(spark, csv_file("a,b\n1,2\n3,4,5\n"))
    assert rows(io.read_csv_inferred(spark, csv_file("a,b\n1,2\n3\n"))) == [(1, 2.0), (3, None)]


@pytest.mark.parametrize("token", ["#NA", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN", "#N/A N/A", "", '""', "NULL", "<NA>"])
def test_spellings_of_missing(spark, token):
    df = io.read_csv_inferred(spark, csv_file(f"a,b\n1.5,x\n{token},y\n"))
    assert dict(df.dtypes)["a"] == "double" and rows(df) == [(1.5, "x"), (None, "y")]


def test_blanks_around_a_token_are_text(spark):
    assert rows(io.read_csv_inferred(spark, csv_file("a,b\n NA ,1\nx,2\n"))) == [(" NA ", 1), ("x", 2)]


def test_any_header_name(spark):
    df = io.read_csv_inferred(spark, csv_file("amt.usd,`q`,amount,Amount\n1.5,2,3,4\n2.5,3,4,5\n"))
    assert df.columns == ["amt.usd", "`q`", "amount.1", "Amount"]
    assert analytics.kpis_risk(df).first().avg_transaction == 4.5
    report = profile.profile_report(df).first()
    assert report.summary_stats["amt.usd"]["mean"] == 2.0


# ---- CSV out and stored tables ------------------------------------------------------
def test_csv_round_trip_keeps_every_text(spark, tmp_out):
    data = [("a", 'say "hi", ok'), ("b", None), ("c", ""), ("d", " x "), ("e", "back\\slash\\"), ("f", "#")]
    df = spark.createDataFrame(data, "k string, t string")
    path = io.write_transactions(df.coalesce(1), tmp_out("csv"), "csv")
    assert sorted(rows(io.read_transactions(spark, path, "csv", schema=df.schema))) == data


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_empty_folder_is_no_table(spark, tmp_out, fmt):
    path = tmp_out("empty")
    os.makedirs(path.removeprefix("file:"))
    df = spark.createDataFrame([("t1", 1.0)], "TransactionID string, Amount double")
    assert io.load_or_materialize(spark, path, lambda: df, fmt, df.schema).count() == 1
    assert io.load_or_materialize(spark, path, lambda: df.limit(0), fmt, df.schema).count() == 1


def test_table_format_by_name():
    assert io.table_format("x/t.csv") == "csv" and io.table_format("x/t") == "parquet"


# ---- dates --------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-05 3:04 PM", "2024-01-05 15:04:00"),
        ("05-Jan-2024 10:00", "2024-01-05 10:00:00"),
        ("20240105 10:11:12", "2024-01-05 10:11:12"),
        ("20240105", "2024-01-05 00:00:00"),
        ("Jan 5, 2024 14:00", "2024-01-05 14:00:00"),
        ("5 Jan 2024 14:00", "2024-01-05 14:00:00"),
        ("1/5/2024 3:04 PM", "2024-01-05 15:04:00"),
        ("2024-01-05T10:11:12", "2024-01-05 10:11:12"),
        ("2024-01-05", "2024-01-05 00:00:00"),
        ("no date", None),
    ],
)
def test_lenient_dates(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).cast("string"))
    assert df.first()[0] == want


# ---- stale listings, folder tables, streams ------------------------------------------
def folder_tables(n_parts: int, spark) -> str:
    sf = tempfile.mkdtemp(prefix="txrisk-test-sf-")
    shutil.copy(f"{SF001}/customer.parquet", f"{sf}/customer.parquet")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(n_parts).write.parquet(f"{sf}/events.parquet")
    return sf


def test_folder_table_before_and_after_an_append(spark):
    sf = folder_tables(3, spark)
    events = spark.read.parquet(f"{SF001}/events.parquet")
    n = events.count()
    assert fixture.transactions(spark, sf).count() == n and run_feature_stream(spark, sf).count() == n
    events.limit(10).write.mode("append").parquet(f"{sf}/events.parquet")
    assert fixture.transactions(spark, sf).count() == n + 10 and run_feature_stream(spark, sf).count() == n + 10


def test_events_without_a_customer_stay(spark):
    events = spark.read.parquet(f"{SF001}/events.parquet")
    none = spark.read.parquet(f"{SF001}/customer.parquet").limit(0)
    assert fixture.transactions_from(events, none).count() == events.count()


# ---- NaN ------------------------------------------------------------------------------
def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("t1", "c", "m", "LOW", 1.0, 10.0), ("t2", "c", "m", "LOW", nan, nan), ("t3", "c", "m", "HIGH", 0.0, 30.0)],
        "TransactionID string, CardUsed string, TransactionMode string, Risk string, IsFraud double, Amount double",
    )
    assert analytics.card_fraud_sql(df).first() == analytics.card_fraud(df).first()
    assert analytics.mode_risk_sql(df).first() == analytics.mode_risk(df).first()
    assert {r.Amount for r in analytics.value_counts(df, "Amount").collect()} == {10.0, 30.0}
    kpis = page_records(df.withColumn("AccountID", F.lit("A")))["kpis"][0]
    assert kpis["avg_transaction"] == 20.0 and kpis == analytics.kpis_labelled(df).first().asDict()
    scaled = model.standardize(df.select("TransactionID", "Amount"), ["Amount"])
    assert sorted((r.Amount is None, r.Amount or 0) for r in scaled.collect()) == [(False, -1.0), (False, 1.0), (True, 0)]


def test_page_and_operators_share_one_rounding(spark):
    df = spark.range(400).select(
        F.concat(F.lit("TXN"), F.col("id")).alias("TransactionID"), F.lit("A").alias("AccountID"), F.lit("c").alias("CardUsed"),
        F.lit("m").alias("TransactionMode"), F.when(F.col("id") < 49, "HIGH").otherwise("LOW").alias("Risk"),
        F.lit(0).alias("IsFraud"), F.lit(1.0).alias("Amount"),
    )
    share = {r["Risk"]: r["share"] for r in page_records(df)["risk_share"]}
    assert share == {r.Risk: r.share for r in analytics.risk_share(df).collect()} == {"HIGH": 12.2, "LOW": 87.8}


# ---- no caps ----------------------------------------------------------------------------
def test_every_row_is_printed(spark):
    df = spark.range(5000).select(F.concat(F.lit("card"), F.col("id")).alias("CardUsed"), F.lit(1.0).alias("Amount"))
    assert len(io.to_records(analytics.value_counts(df, "CardUsed"))) == 5000
    assert len(io.to_records(dashboard(df.withColumn("AccountID", F.lit("a")).withColumn("TransactionID", F.lit("t")), df)["card_usage"])) == 5000


def test_many_classes_get_weights(spark):
    df = spark.range(3000).select(F.col("id").alias("IsFraud"))
    assert model.with_class_weights(df).where("class_weight = 1.0").count() == 3000


def test_long_dictionaries_are_ranked_where_they_are(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in ["b", "a", None, "B", "ab", "aba", "b"]], "CardUsed string")
    short = sorted(r.CardUsed_encoded for r in model.label_encode(df, ["CardUsed"]).collect())
    monkeypatch.setattr(model, "DICTIONARY_ROWS", 2)
    assert sorted(r.CardUsed_encoded for r in model.label_encode(df, ["CardUsed"]).collect()) == short == [0, 1, 2, 3, 4, 4, 5]


# ---- accounts ---------------------------------------------------------------------------
def test_order_of_appearance_without_transaction_id(spark):
    df = spark.createDataFrame([("B", 1, 10.0), ("A", 2, 20.0), ("B", 3, 30.0)], "AccountID string, seq int, NewBalance double")
    with pytest.raises(analytics.MissingColumns):
        accounts.account_summary(df)
    got = accounts.account_summary(df, limit=1, order_by="seq").collect()
    assert [(r.AccountID, r.NewBalance, r.TransactionCount) for r in got] == [("B", 10.0, 2)]
    assert {tuple(r) for r in accounts.first_txn_per_account(df, "seq").collect()} == {("B", 1, 10.0), ("A", 2, 20.0)}


def test_text_ids_order_by_number(spark):
    df = spark.createDataFrame([("TXN100000", "A"), ("TXN99999", "B"), ("TXN00002", "C")], "TransactionID string, AccountID string")
    assert [r.AccountID for r in accounts.account_summary(df, limit=2).orderBy("AccountID").collect()] == ["B", "C"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_account_roll_up_does_not_sort_the_facts(spark, tx, tmp_out):
    stored = io.read_transactions(spark, io.write_transactions(tx, tmp_out("acc")))
    for df in (accounts.account_summary(stored), accounts.account_summary(stored.drop("txn_no"), limit=None)):
        lines = plan_of(df).splitlines()
        at = next(i for i, x in enumerate(lines) if "partial_min(_order" in x)
        below = lines[at : next(i for i in range(at, len(lines)) if "FileScan" in lines[i])]
        assert "HashAggregate" in lines[at] and not any("Sort" in x or "Exchange" in x for x in below)


# ---- plans ------------------------------------------------------------------------------
def test_country_list_is_broadcast_by_its_measured_size(spark, tx, tmp_out, monkeypatch):
    stored = io.read_transactions(spark, io.write_transactions(tx, tmp_out("country")))
    table = catalog._country_table(spark)
    small = features.add_country_risk_join(stored, table)
    # the one exchange on Location is that of the list's own reduction
    assert "BroadcastHashJoin" in plan_of(small) and plan_of(small).count("hashpartitioning(Location") == 1
    want = sorted(map(tuple, small.select("TransactionID", "CountryRiskScore").collect()))
    monkeypatch.setattr(features, "COUNTRY_ROWS", 0)
    long = features.add_country_risk_join(stored, table)
    assert sorted(map(tuple, long.select("TransactionID", "CountryRiskScore").collect())) == want


def test_registered_account_filters_reach_the_scan(spark):
    for key in ("filter_account", "account_details"):
        assert "EqualTo(AccountID,ACC007)" in plan_of(catalog.queries()[key](spark, SF001))


def test_profile_keeps_counts_as_rows(spark, tx):
    assert "collect_list" not in plan_of(profile.profile_long(tx)) and "Expand" not in plan_of(profile.profile_long(tx))


# ---- session and model ----------------------------------------------------------------------
def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="shared by the cluster"):
        shared_dir(Session())


TRAIN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from txrisk.operators import model
from txrisk.session import build_session
from txrisk.sources.fixture import transactions
spark = build_session("local[{cores}]", shuffle_partitions={cores} + 3)
tx = transactions(spark, {sf!r})
scored = model.score_transactions(model.train_model(tx, trees=6, depth=5), tx)
print("SUM", scored.agg(F.sum(F.xxhash64("TransactionID", "prediction").cast("decimal(38,0)"))).first()[0])
"""


def test_the_model_does_not_depend_on_the_number_of_cores():
    out = []
    for cores in (2, 4):
        code = TRAIN.format(root=ROOT, cores=cores, sf=SF001)
        done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240)
        out.append([x for x in done.stdout.splitlines() if x.startswith("SUM")])
    assert out[0] and out[0] == out[1]


def test_a_storage_error_does_not_replace_the_model(spark, tx, monkeypatch):
    def broken(path):
        raise OSError("permission denied")

    monkeypatch.setattr(model.PipelineModel, "load", staticmethod(broken))
    with pytest.raises(OSError, match="permission"):
        model.load_or_train(tx, "anywhere")


# ---- constants --------------------------------------------------------------------------------
def test_fixed_values():
    assert (S.RULE_AMOUNT_SHARE, S.RULE_NEGATIVE_BALANCE, S.RULE_LOW_SCORE, S.RULE_CREDIT_AMOUNT) == (0.7, -500.0, 0.3, 3000.0)
    assert (S.RULE_ATM_BEFORE_HOUR, S.MEDIUM_SCORE_BELOW, S.RATE_DANGER_ABOVE, S.RATE_WARNING_ABOVE) == (6, 0.5, 20.0, 10.0)
    assert (S.THIN_MULTIPLIER, S.THIN_OFFSET, S.THIN_MODULUS, S.THIN_KEEP_FROM) == (7, 3, 10, 4)
    assert (S.FOREST_TREES, S.FOREST_DEPTH, S.FOREST_SEED, S.ACCOUNT_LIMIT) == (200, 10, 42, 10)
