"""The dashboard page as Spark plans.

``dashboard_rollup`` serves the card, mode and risk breakdowns plus the grand
total from ONE scan: a GROUPING SETS aggregate (Expand -> partial hash
aggregate -> one shuffle of a few rows per set and task -> final aggregate).
``dashboard`` gathers every figure the page shows as lazily built DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import numeric_value, percent, rate_band
from txrisk.operators import accounts, analytics
from txrisk.operators.rules import derive_risk
from txrisk.session import fresh_path
from txrisk.sources import io

ROLLUP_DIMENSIONS = ["CardUsed", "TransactionMode", "Risk"]


def dashboard_rollup(df: DataFrame) -> DataFrame:
    """Per-dimension figures plus an ALL row, for CardUsed, TransactionMode and
    Risk (those present): row count, fraud count, rounded rate over all rows
    (A01/A02), labelled rows and unrounded rate over them (A04), mean amount
    and the amount on fraud rows (A07)."""
    dims = [d for d in ROLLUP_DIMENSIONS if d in df.columns]
    analytics.require(df, "dashboard_rollup", "IsFraud", "Amount")
    n = F.count(F.lit(1))
    label, amount = numeric_value(df, "IsFraud"), numeric_value(df, "Amount")
    fraud = F.sum(label.cast("long"))
    agg = df.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        n.alias("n"),
        fraud.alias("fraud_count"),
        percent(fraud, n, 2).alias("fraud_rate"),
        F.avg(amount).alias("avg_amount"),
        F.count(label).alias("labelled"),
        (F.avg(label) * F.lit(100.0)).alias("fraud_share"),
        F.coalesce(F.sum(F.when(label == 1, amount)), F.lit(0.0)).alias(
            "fraud_amount"
        ),
        F.grouping_id().alias("_gid"),
    )
    full = (1 << len(dims)) - 1
    dimension = F.when(F.col("_gid") == full, F.lit("ALL"))
    value = F.lit(None).cast("string")
    for pos, d in enumerate(dims):
        gid = full & ~(1 << (len(dims) - 1 - pos))
        dimension = dimension.when(F.col("_gid") == gid, F.lit(d))
        value = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(value)
    return agg.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "n",
        "fraud_count",
        "fraud_rate",
        "avg_amount",
        "labelled",
        "fraud_share",
        "fraud_amount",
    )


def page_figures(rollup: DataFrame) -> dict[str, DataFrame]:
    """Every chart and KPI of a labelled table, read off its roll-up."""

    def dim(name: str, *measures, keep_null: bool = False) -> DataFrame:
        rows = rollup.where(F.col("dimension") == name)
        rows = rows if keep_null else rows.where(F.col("value").isNotNull())
        return rows.select(F.col("value").alias(name), *measures)

    def counts(name: str) -> DataFrame:
        return dim(name, F.col("n").alias("count")).orderBy(F.col("count").desc(), name)

    def by_rate(name: str, *measures) -> DataFrame:
        return dim(name, *measures, keep_null=True).orderBy(F.col("fraud_rate").desc_nulls_last(), F.col(name).asc_nulls_last())

    n = F.col("n")
    fraud = F.coalesce("fraud_count", F.lit(0))
    return {
        "risk_counts": counts("Risk"),
        "risk_share": analytics.with_share(counts("Risk")),
        "card_usage": counts("CardUsed"),
        "transaction_modes": counts("TransactionMode"),
        "fraud_by_card": dim("CardUsed", F.col("fraud_share").alias("fraud_rate"))
        .withColumn("band", rate_band(F.col("fraud_rate")))
        .orderBy("CardUsed"),
        "card_fraud": by_rate("CardUsed", n.alias("total_transactions"), "fraud_count", "fraud_rate"),
        "mode_risk": by_rate("TransactionMode", n.alias("total_count"), "fraud_count", "avg_amount", "fraud_rate"),
        "kpis": rollup.where("dimension = 'ALL'").select(
            n.alias("total_transactions"),
            fraud.alias("fraud_count"),
            F.when(n > 0, fraud * F.lit(100.0) / n).otherwise(0.0).alias("fraud_rate"),
            F.col("avg_amount").alias("avg_transaction"),
            F.col("fraud_amount").alias("high_risk_amount"),
        ),
    }


def page_records(base: DataFrame, limit: int | None = S.ACCOUNT_LIMIT) -> dict[str, list[dict]]:
    """The base-table page in TWO passes over the facts: the roll-up and the accounts.

    The roll-up (one row per card, mode and risk value and the total) is
    written to the shared folder once; every figure is a small query on it,
    with the same expressions as the operators.  Same numbers as ``dashboard(base)``.
    """
    spark = base.sparkSession
    path = fresh_path(spark, "rollup")
    dashboard_rollup(base).write.parquet(path)
    page = {"accounts": io.to_records(accounts.account_summary(base, limit))}
    return page | {name: io.to_records(df) for name, df in page_figures(spark.read.parquet(path)).items()}


def dashboard(base: DataFrame, uploaded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the page shows, as DataFrames (nothing is computed here).

    The account roll-up always uses the base table; charts and KPIs use the
    uploaded table when there is one, with its risk derived (P21).
    """
    shown = uploaded if uploaded is not None else base
    page = {"accounts": accounts.account_summary(base)}
    derived = derive_risk(shown)
    page["risk_counts"] = analytics.risk_counts(shown)
    page["risk_share"] = analytics.risk_share(shown)
    if "CardUsed" in shown.columns:
        page["card_usage"] = analytics.value_counts(shown, "CardUsed")
    if "TransactionMode" in shown.columns:
        page["transaction_modes"] = analytics.value_counts(shown, "TransactionMode")
    if {"CardUsed", "IsFraud"} <= set(shown.columns):
        page["fraud_by_card"] = analytics.fraud_rate_by_card(shown)
        page["card_fraud"] = analytics.card_fraud(shown)
    if {"TransactionMode", "IsFraud", "Amount"} <= set(shown.columns):
        page["mode_risk"] = analytics.mode_risk(shown)
    page["kpis"] = analytics.kpis_risk(derived) if uploaded is not None else analytics.kpis_labelled(base)
    return page
