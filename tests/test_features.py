"""Feature semantics on small in-line frames (FIXTURES.md 5)."""

from __future__ import annotations

import datetime as dt

import pytest

from txrisk.operators import features as FE


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_P01_alias_names(spark):
    df = spark.createDataFrame([(100.0, 50.0, 10.0)], "oldbalanceOrg double, newbalanceOrig double, Amount double")
    out = FE.add_aliases(df)
    assert rows(out, "OldBalance", "NewBalance", "AmountTaken") == [(100.0, 50.0, 10.0)]


def test_P01_target_present_is_kept(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "OldBalance double, oldbalanceOrg double")
    assert rows(FE.add_aliases(df), "OldBalance") == [(1.0,)]


def test_P02_fill_null_and_nan(spark):
    df = spark.createDataFrame([(None, float("nan"), 5.0)], "OldBalance double, NewBalance double, Amount double")
    out = FE.fill_numeric(FE.add_aliases(df))
    assert rows(out, "OldBalance", "NewBalance", "Amount", "AmountTaken") == [(0.0, 0.0, 5.0, 5.0)]


def test_P03_P04_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(-1.0, 10.0, 5.0)], "OldBalance double, NewBalance double, Amount double")
    out = FE.create_features(df)
    assert rows(out, "BalanceRatio", "AmountToBalanceRatio") == [(None, None)]


def test_P03_ratio_value(spark):
    df = spark.createDataFrame([(99.0, 50.0, 25.0)], "OldBalance double, NewBalance double, Amount double")
    out = FE.create_features(df)
    assert rows(out, "BalanceRatio", "AmountToBalanceRatio") == [(0.5, 0.25)]


@pytest.mark.parametrize(
    "new,old,expected", [(-1.0, 5.0, 1), (-1.0, 0.0, 0), (0.0, 5.0, 0), (None, 5.0, 0)]
)
def test_P05_negative_balance(spark, new, old, expected):
    df = spark.createDataFrame([(old, new)], "OldBalance double, NewBalance double")
    assert rows(FE.create_features(df), "IsNegativeBalance") == [(expected,)]


def test_P06_P07_risk_lists(spark):
    locs = ["Russia", "Nigeria", "China", "Ukraine", "Vietnam", "North Korea", "russia", None, "Texas"]
    merch = ["Casino", "Digital Goods", "Cryptocurrency", "Adult", "Gambling", "casino", None, "Retail", "ATM"]
    df = spark.createDataFrame(list(zip(range(9), locs, merch)), "i int, Location string, MerchantCategory string")
    out = FE.create_features(df).orderBy("i")
    assert [r.CountryRiskScore for r in out.collect()] == [1.0, 0.9, 0.8, 0.9, 0.7, 1.0, 0.1, 0.1, 0.1]
    assert [r.IsHighRiskMerchant for r in out.collect()] == [1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_P06_join_form_matches_expression(spark):
    from txrisk import schema as S

    locs = ["Russia", "Vietnam", "russia", None, "Texas"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(locs)], "i int, Location string")
    table = spark.createDataFrame(list(S.COUNTRY_RISK.items()), "Location string, score double")
    a = FE.add_country_risk_join(df, table).orderBy("i").collect()
    b = FE.add_country_risk(df).orderBy("i").collect()
    assert [r.CountryRiskScore for r in a] == [r.CountryRiskScore for r in b] == [1.0, 0.7, 0.1, 0.1, 0.1]


def test_constant_branches_without_columns(spark):
    df = spark.createDataFrame([(10.0, 100.0, 90.0)], "Amount double, OldBalance double, NewBalance double")
    r = FE.create_features(df).collect()[0]
    assert (r.CountryRiskScore, r.IsHighRiskMerchant, r.Hour, r.DayOfWeek, r.IsNight, r.IsWeekend) == (
        0.1, 0, 12, 0, 0, 0,
    )


def test_no_timestamp_overwrites_hour(spark):
    df = spark.createDataFrame([(3,)], "Hour int")
    assert rows(FE.create_features(df), "Hour") == [(12,)]


@pytest.mark.parametrize("hour,night", [(5, 1), (6, 0), (21, 0), (22, 1), (0, 1), (23, 1)])
def test_P11_night_thresholds(spark, hour, night):
    df = spark.createDataFrame([(f"2024-01-03 {hour:02d}:30:00",)], "Timestamp string")
    r = FE.create_features(df).collect()[0]
    assert (r.Hour, r.IsNight) == (hour, night)


def test_P08_P10_P12_parse_weekday_and_garbage(spark):
    # 2024-01-01 is a Monday -> 0; 2024-01-06 Saturday -> 5; 2024-01-07 Sunday -> 6
    data = [(0, "2024-01-01 10:00:00"), (1, "2024-01-06 10:00:00"), (2, "2024-01-07 10:00:00"), (3, "garbage"), (4, None)]
    df = spark.createDataFrame(data, "i int, Timestamp string")
    out = FE.create_features(df).orderBy("i").collect()
    assert [(r.DayOfWeek, r.IsWeekend) for r in out] == [(0, 0), (5, 1), (6, 1), (0, 0), (0, 0)]
    assert [r.Hour for r in out] == [10, 10, 10, 12, 12]
    assert out[0].Timestamp == dt.datetime(2024, 1, 1, 10, 0)
    assert out[3].Timestamp is None


def test_P13_large_transaction_is_strict(spark):
    df = spark.createDataFrame([(0, 50.0, 100.0), (1, 50.01, 100.0)], "i int, Amount double, OldBalance double")
    assert [r.LargeTransaction for r in FE.create_features(df).orderBy("i").collect()] == [0, 1]


def test_P14_round_amount_zero_and_missing(spark):
    df = spark.createDataFrame([(0, 200.0), (1, 0.0), (2, None), (3, 150.0), (4, -300.0)], "i int, Amount double")
    assert [r.SuspiciousAmount for r in FE.create_features(df).orderBy("i").collect()] == [1, 1, 1, 0, 1]


def test_P15_deterministic_and_keeps_columns(spark, tx):
    a = FE.create_features(tx)
    assert set(tx.columns) <= set(a.columns)
    assert a.exceptAll(FE.create_features(tx)).count() == 0


def test_P08_other_layouts(spark):
    data = [(0, "1/2/2024 10:05:00"), (1, "01/02/2024 10:05"), (2, "2024/01/02"), (3, "2024-01-02T10:05:00"), (4, "13/45/2024")]
    df = spark.createDataFrame(data, "i int, Timestamp string")
    got = [r.Timestamp for r in FE.create_features(df).orderBy("i").collect()]
    assert got == [
        dt.datetime(2024, 1, 2, 10, 5),
        dt.datetime(2024, 1, 2, 10, 5),
        dt.datetime(2024, 1, 2),
        dt.datetime(2024, 1, 2, 10, 5),
        None,
    ]
