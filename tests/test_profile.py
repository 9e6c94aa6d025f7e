"""Schema-driven profile."""

from __future__ import annotations

import json

import pytest

from txrisk.operators import profile as P
from txrisk.sources import io


def test_P26_numeric_columns_skip_bool(spark):
    df = spark.createDataFrame([(1, True, 2.0, "a")], "a int, b boolean, c double, d string")
    assert P.numeric_columns(df) == ["a", "c"]


def test_P27_schema_report(spark):
    df = spark.createDataFrame([(1, "a")], "a int, d string")
    assert [tuple(r) for r in P.schema_report(df).collect()] == [(0, "a", "int"), (1, "d", "string")]


def test_A05_sample_std_skips_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),)], "x double")
    r = P.numeric_profile(df).first()
    assert (r.column, r.mean, r.min, r.max) == ("x", 2.0, 1.0, 3.0)
    assert r.std == pytest.approx(2**0.5)


def test_A05_one_row_std_is_null(spark):
    r = P.numeric_profile(spark.createDataFrame([(5,)], "x int")).first()
    assert (r.mean, r.std, r.min, r.max) == (5.0, None, 5.0, 5.0)


def test_A13_report_with_risk(spark):
    df = spark.createDataFrame(
        [("t1", 10.0, "HIGH", "c1", "m"), ("t2", 30.0, "LOW", "c1", "m"), ("t3", 5.0, "HIGH", None, "n")],
        "TransactionID string, Amount double, Risk string, CardUsed string, TransactionMode string",
    )
    r = P.profile_report(df).first().asDict(recursive=True)
    assert r["total_transactions"] == 3
    assert r["columns"] == ["TransactionID", "Amount", "Risk", "CardUsed", "TransactionMode"]
    assert r["risk_distribution"] == {"HIGH": 2, "LOW": 1}
    assert (r["high_risk_count"], r["high_risk_amount"]) == (2, 15.0)
    assert r["card_usage"] == {"c1": 2}
    assert r["transaction_modes"] == {"m": 2, "n": 1}
    assert r["summary_stats"]["Amount"]["mean"] == 15.0
    assert r["data_types"] == {
        "TransactionID": "object",
        "Amount": "float64",
        "Risk": "object",
        "CardUsed": "object",
        "TransactionMode": "object",
    }
    json.loads(io.as_json(P.profile_report(df)).first().json)


def test_A13_report_without_risk(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = P.profile_report(df).first().asDict(recursive=True)
    assert r["risk_distribution"] == {"LOW": 2}
    assert (r["high_risk_count"], r["high_risk_amount"]) == (0, 0.0)
    assert "card_usage" not in r


def test_A13_long_form_two_passes(spark, tx):
    plan = P.profile_long(tx)._jdf.queryExecution().executedPlan().toString()
    # statistics and counts: events and the (broadcast) customer table, once each
    assert plan.count("Scan parquet") == 4
    assert "collect_list" not in plan and "Expand" not in plan


def test_A13_empty_and_text_only(spark):
    empty = spark.createDataFrame([], "Amount double, Risk string")
    r = P.profile_report(empty).first().asDict(recursive=True)
    assert (r["total_transactions"], r["high_risk_count"], r["high_risk_amount"], r["risk_distribution"]) == (0, 0, 0.0, {})
    text = spark.createDataFrame([("a",)], "note string")
    r = P.profile_report(text).first().asDict(recursive=True)
    assert r["summary_stats"] == {} and r["risk_distribution"] == {"LOW": 1}
