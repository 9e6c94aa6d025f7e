"""P08 by column; M01 ranks in ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from txrisk.functions.columns import TIME_LAYOUTS
from txrisk.operators import features, model
from txrisk.operators.time_layout import fit_layout, parse_time_column


def frame(spark, values, numbered=True):
    rows = [(f"TXN{i:05d}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "TransactionID string, Timestamp string").withColumn("text", F.col("Timestamp"))
    return df if numbered else df.drop("TransactionID")


def hours(df):
    return {r.text: (None if r.Timestamp is None else (r.Timestamp.day, r.Timestamp.hour)) for r in df.collect()}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        (["2024-01-05 07:08:09", "2024-01-06 23:00:00", "2024-01-06", "1/6/2024 7:00"], [(5, 7), (6, 23), None, None]),
        (["1/6/2024 7:00", "2024-01-05 07:08:09", "12/31/2024 0:59", "1/6/2024"], [(6, 7), None, (31, 0), None]),
        ([None, "", "x", "5-Jan-2024"], [None, None, None, (5, 0)]),  # no known layout at first: each on its own
        ([None, "5-Jan-2024", "6-Feb-2024", "2024-01-05"], [None, (5, 0), (6, 0), None]),
        (["20240105", "20240106", "12345", "2024"], [(5, 0), (6, 0), None, None]),
        (["2024-01-05T10:11", "2024-01-05 10:11"], [(5, 10), None]),
    ],
)
def test_P08_layout_of_the_first_value(spark, values, want):
    out = parse_time_column(frame(spark, values).repartition(3))
    assert hours(out) == dict(zip(values, want, strict=True))
    assert dict(out.dtypes)["Timestamp"] == "timestamp_ntz"


def test_P08_first_is_by_transaction_or_a_named_column_or_the_files(spark):
    df = frame(spark, ["2024-01-05", "1/6/2024"])
    assert fit_layout(df) == "iso date"
    assert fit_layout(df.withColumn("o", F.when(F.col("text") == "1/6/2024", 1).otherwise(2)), order_by="o") == "M/d/yyyy"
    assert fit_layout(frame(spark, ["2024-01-05 1:00", "1/6/2024"], numbered=False).coalesce(1)) == "iso minutes"
    assert fit_layout(frame(spark, [None, None])) is None and fit_layout(frame(spark, [])) is None
    same = df.withColumn("Timestamp", F.lit(3))
    assert parse_time_column(same) is same and parse_time_column(df.drop("Timestamp")).columns == ["TransactionID", "text"]


def test_P08_one_parse_a_row(spark):
    df = parse_time_column(frame(spark, ["1/6/2024 7:00", "2024-01-05"]))
    plan = features.create_features(df)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("gettimestamp(") + plan.count("try_to_timestamp(") == 1
    by_row = features.create_features(frame(spark, ["1/6/2024 7:00"]))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert by_row.count("gettimestamp(") >= len(TIME_LAYOUTS) - 8


def test_M01_ranks_of_values_with_one_beginning(spark):
    values = spark.range(5000).select(F.concat(F.lit("Merchant "), F.sha2(F.col("id").cast("string"), 256)).alias("v"))
    want = {v: i for i, v in enumerate(sorted(r.v for r in values.collect()))}
    ranked = model.distinct_ranks(values.repartition(5), "v", "code", parts=16)
    assert {r.v: r.code for r in ranked.collect()} == want
    files = [len(spark.read.parquet(f).collect()) for f in _stored(ranked)]
    assert len(files) >= 12 and max(files) < 3 * 5000 / 16  # no task ranks much more than its share


def _stored(df):
    return sorted({f for f in df.inputFiles() if "ranks-" in f})


def test_M01_long_dictionary_equals_the_short_one(spark, monkeypatch):
    values = ["é", "z", "Z", "", " ", "aa", "a", "😀", "漢", None, "nan"] * 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, CardUsed string")
    want = {r.id: r.CardUsed_encoded for r in model.label_encode(df).collect()}
    monkeypatch.setattr(model, "DICTIONARY_ROWS", 3)
    monkeypatch.setattr(model, "RANK_ROWS", 2)
    assert {r.id: r.CardUsed_encoded for r in model.label_encode(df).collect()} == want
    assert model.distinct_ranks(df.select("CardUsed").limit(0), "CardUsed", "code").collect() == []
