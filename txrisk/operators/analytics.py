"""Dashboard aggregates.

All aggregates are hash aggregates with partial (map-side) aggregation, so a
hot key never ships its rows through the shuffle: each task sends one partial
row per key.  Global figures use ``agg`` without keys (partial per task, one
final row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import numeric_value, percent, rate_band, safe_ratio
from txrisk.operators.profile import numeric_columns
from txrisk.operators.rules import risk_equal_width, risk_source


class MissingColumns(ValueError):
    """An analytic needs columns the table does not have."""

    def __init__(self, op: str, missing: list[str]):
        super().__init__(f"{op} needs column(s) {', '.join(missing)}")
        self.missing = missing


def require(df: DataFrame, op: str, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(op, missing)


def _label(df: DataFrame) -> Column:
    """IsFraud as a number; NaN (a float label column) counts as missing."""
    return numeric_value(df, "IsFraud") if dict(df.dtypes).get("IsFraud") in ("double", "float") else F.col("IsFraud")


def _fraud_sum(df: DataFrame) -> Column:
    # SUM over the 0/1 label; bigint like COUNT
    return F.sum(_label(df).cast("long"))


def _view(df: DataFrame, view: str) -> None:
    """Name the table for SQL with NaN in its numbers read as missing."""
    numbers = {c: numeric_value(df, c) for c in ("IsFraud", "Amount") if dict(df.dtypes).get(c) in ("double", "float")}
    df.withColumns(numbers).createOrReplaceTempView(view)


# ---- A01 -------------------------------------------------------------------
def card_fraud(df: DataFrame) -> DataFrame:
    """Per CardUsed (NULL group kept) count, fraud count and rounded rate,
    ordered by rate DESC then key."""
    require(df, "card_fraud", "CardUsed", "IsFraud")
    return (
        df.groupBy("CardUsed")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            _fraud_sum(df).alias("fraud_count"),
            percent(_fraud_sum(df), F.count(F.lit(1)), 2).alias("fraud_rate"),
        )
        .orderBy(F.col("fraud_rate").desc_nulls_last(), F.col("CardUsed").asc_nulls_last())
    )


# The SQL text form that S07 asks for: the same columns and order as card_fraud.
CARD_FRAUD_SQL = """
SELECT CardUsed, count(*) AS total_transactions, sum(CAST(IsFraud AS BIGINT)) AS fraud_count,
       round(CAST(sum(CAST(IsFraud AS BIGINT)) AS DOUBLE) * 100.0D / count(*), 2) AS fraud_rate
FROM {view}
GROUP BY CardUsed
ORDER BY fraud_rate DESC NULLS LAST, CardUsed NULLS LAST
"""


def card_fraud_sql(df: DataFrame, view: str = "transactions") -> DataFrame:
    """A01 in its SQL text form over a temp view."""
    require(df, "card_fraud", "CardUsed", "IsFraud")
    _view(df, view)
    return df.sparkSession.sql(CARD_FRAUD_SQL.format(view=view))


# ---- A02 -------------------------------------------------------------------
def mode_risk(df: DataFrame) -> DataFrame:
    """Per TransactionMode count, fraud count, mean Amount, rounded rate."""
    require(df, "mode_risk", "TransactionMode", "IsFraud", "Amount")
    return (
        df.groupBy("TransactionMode")
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            _fraud_sum(df).alias("fraud_count"),
            F.avg(numeric_value(df, "Amount")).alias("avg_amount"),
            percent(_fraud_sum(df), F.count(F.lit(1)), 2).alias("fraud_rate"),
        )
        .orderBy(F.col("fraud_rate").desc_nulls_last(), F.col("TransactionMode").asc_nulls_last())
    )


# The SQL text form that S07 asks for: the same columns and order as mode_risk.
MODE_RISK_SQL = """
SELECT TransactionMode, count(*) AS total_count, sum(CAST(IsFraud AS BIGINT)) AS fraud_count,
       avg(CAST(Amount AS DOUBLE)) AS avg_amount,
       round(CAST(sum(CAST(IsFraud AS BIGINT)) AS DOUBLE) * 100.0D / count(*), 2) AS fraud_rate
FROM {view}
GROUP BY TransactionMode
ORDER BY fraud_rate DESC NULLS LAST, TransactionMode NULLS LAST
"""


def mode_risk_sql(df: DataFrame, view: str = "transactions") -> DataFrame:
    """A02 in its SQL text form over a temp view."""
    require(df, "mode_risk", "TransactionMode", "IsFraud", "Amount")
    _view(df, view)
    return df.sparkSession.sql(MODE_RISK_SQL.format(view=view))


# ---- A03 -------------------------------------------------------------------
def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per value, missing values dropped, count DESC then value ASC."""
    require(df, "value_counts", column)
    present = F.col(column).isNotNull()
    if dict(df.dtypes)[column] in ("double", "float"):
        present &= ~F.isnan(column)
    return (
        df.where(present)
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(column).asc())
    )


def risk_counts(df: DataFrame) -> DataFrame:
    """A03 on the derived risk (P21): counts of Risk.

    * a Risk column or one derived from IsFraud: plain value counts;
    * equal-width bins: all three bins, zero counts included (categorical);
    * nothing to derive from: one row UNKNOWN = row count.
    """
    src = risk_source(df)
    if src == "unknown":
        return df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(S.UNKNOWN_RISK).alias("Risk"), "count")
    if src == "equal_width":
        binned = risk_equal_width(df)
        wide = binned.agg(*[F.count_if(F.col("Risk") == lvl).alias(lvl) for lvl in S.RISK_LEVELS])
        rows = [F.struct(F.lit(lvl).alias("Risk"), F.col(lvl).alias("count")) for lvl in S.RISK_LEVELS]
        return wide.select(F.inline(F.array(*rows))).orderBy(F.col("count").desc(), "Risk")
    if src == "label":
        c = F.col("IsFraud")
        df = df.withColumn("Risk", F.when(c == 1, F.lit("HIGH")).when(c == 0, F.lit("LOW")))
    return value_counts(df, "Risk")


def risk_share(df: DataFrame, digits: int = 1) -> DataFrame:
    """Percent share of each risk category (pie labels, one decimal).

    The total is an un-partitioned window over the count table, which has one
    row per risk category (at most a handful): one scan of the data.
    """
    return with_share(risk_counts(df), digits)


def with_share(counts: DataFrame, digits: int = 1) -> DataFrame:
    """Counts per risk category with their share in percent.

    Ties go to the even digit, as in the reference's ``%1.1f``.
    """
    total = F.sum("count").over(Window.partitionBy())
    share = F.bround(safe_ratio(F.col("count") * F.lit(100.0), total), digits)  # NULL when all counts are 0
    return counts.select("Risk", "count", share.alias("share"))


# ---- A04 + P24 ---------------------------------------------------------------
def fraud_rate_by_card(df: DataFrame) -> DataFrame:
    """Unrounded mean(IsFraud) * 100 per card (missing key dropped,
    non-missing denominator), with its P24 band, key ASC."""
    require(df, "fraud_rate_by_card", "CardUsed", "IsFraud")
    rate = F.avg(_label(df).cast("double")) * F.lit(100.0)
    return (
        df.where(F.col("CardUsed").isNotNull())
        .groupBy("CardUsed")
        .agg(rate.alias("fraud_rate"))
        .withColumn("band", rate_band(F.col("fraud_rate")))
        .orderBy("CardUsed")
    )


# ---- A06 -------------------------------------------------------------------
def dataset_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, columns, distinct accounts (a missing id counts as one
    value, like pandas ``unique``), mean IsFraud.

    ``approximate=True`` uses HyperLogLog++ (no shuffle of account ids) for
    very large tables.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    if "AccountID" in df.columns:
        distinct = F.approx_count_distinct("AccountID") if approximate else F.countDistinct("AccountID")
        has_null = F.max(F.col("AccountID").isNull().cast("long"))
        aggs.append((distinct + F.coalesce(has_null, F.lit(0))).cast("long").alias("n_accounts"))
    if "IsFraud" in df.columns:
        aggs.append(F.avg(_label(df).cast("double")).alias("fraud_mean"))
    return df.agg(*aggs)


# ---- A07 -------------------------------------------------------------------
def kpis_labelled(df: DataFrame) -> DataFrame:
    """Headline figures of a labelled table in one global aggregate.

    total, fraud_count (0 without IsFraud), fraud_rate (0 when empty),
    avg_transaction (0 without Amount), high_risk_amount (sum of Amount on
    fraud rows, 0 without Amount or IsFraud).
    """
    n = F.count(F.lit(1))
    has_label, has_amount = "IsFraud" in df.columns, "Amount" in df.columns
    fraud = F.coalesce(_fraud_sum(df), F.lit(0)) if has_label else F.lit(0).cast("long")
    amount = numeric_value(df, "Amount") if has_amount else None
    out = df.agg(
        n.alias("total_transactions"),
        fraud.alias("fraud_count"),
        F.when(n > 0, fraud.cast("double") * F.lit(100.0) / n).otherwise(F.lit(0.0)).alias("fraud_rate"),
        (F.avg(amount) if has_amount else F.lit(0.0)).alias("avg_transaction"),
        (
            F.coalesce(F.sum(F.when(F.col("IsFraud") == 1, amount)), F.lit(0.0))
            if has_label and has_amount
            else F.lit(0.0)
        ).alias("high_risk_amount"),
    )
    return out


# ---- A08, A11, A12 ----------------------------------------------------------
def _risk_amount_column(df: DataFrame) -> str | None:
    for name in ("Amount", "AmountTaken"):
        if name in df.columns:
            return name
    return None


def high_risk_amount_expr(df: DataFrame) -> Column:
    """Sum of Amount (else AmountTaken) over Risk = HIGH; 0 otherwise."""
    amt = _risk_amount_column(df)
    if "Risk" not in df.columns or amt is None:
        return F.lit(0.0)
    return F.coalesce(F.sum(F.when(F.col("Risk") == "HIGH", numeric_value(df, amt))), F.lit(0.0))


def high_risk_count_expr(df: DataFrame) -> Column:
    """Number of Risk = HIGH rows; 0 without a Risk column."""
    if "Risk" not in df.columns:
        return F.lit(0).cast("long")
    return F.count_if(F.col("Risk") == "HIGH")


def high_risk_amount(df: DataFrame) -> DataFrame:
    """A11 + A12 as one global aggregate."""
    return df.agg(
        high_risk_count_expr(df).alias("high_risk_count"), high_risk_amount_expr(df).cast("double").alias("high_risk_amount")
    )


def kpis_risk(df: DataFrame) -> DataFrame:
    """Headline figures of an uploaded table with a Risk column.

    Average of Amount, else AmountTaken, else the first numeric column, else
    0; the high-risk amount only when Amount or AmountTaken exists.  Columns
    are chosen at plan time; one global aggregate.
    """
    n = F.count(F.lit(1))
    high = high_risk_count_expr(df)
    amt = _risk_amount_column(df)
    if amt is not None:
        avg_col, hi_amt = F.avg(numeric_value(df, amt)), high_risk_amount_expr(df)
    else:
        nums = numeric_columns(df)
        avg_col = F.avg(numeric_value(df, nums[0])) if nums else F.lit(0.0)
        hi_amt = F.lit(0.0)
    return df.agg(
        n.alias("total_transactions"),
        high.alias("fraud_count"),
        F.when(n > 0, high.cast("double") * F.lit(100.0) / n).otherwise(F.lit(0.0)).alias("fraud_rate"),
        avg_col.cast("double").alias("avg_transaction"),
        hi_amt.cast("double").alias("high_risk_amount"),
    )


# ---- filters F01-F04 ----------------------------------------------------------
def filter_account(df: DataFrame, account_id: str) -> DataFrame:
    """rows of one account (an equality Parquet can push down)."""
    return df.where(F.col("AccountID") == F.lit(account_id))


def filter_high_risk(df: DataFrame) -> DataFrame:
    """Risk = HIGH rows."""
    return df.where(F.col("Risk") == F.lit("HIGH"))


def filter_fraud(df: DataFrame) -> DataFrame:
    """IsFraud = 1 rows."""
    return df.where(F.col("IsFraud") == F.lit(1))


def filter_isin(df: DataFrame, column: str, values: list) -> DataFrame:
    """set membership (NULL is never a member)."""
    return df.where(F.col(column).isin(values))


# ---- W04, W05 -------------------------------------------------------------------
def order_key(df: DataFrame) -> Column:
    """Row order of the table: ``txn_no`` when present, else the
    TransactionID ordered by (length, text) so TXN100000 sorts after TXN99999."""
    if "txn_no" in df.columns:
        return F.col("txn_no")
    require(df, "order of appearance", "TransactionID")
    return F.struct(F.length("TransactionID").alias("len"), F.col("TransactionID").alias("id"))


def first_accounts(df: DataFrame, k: int = S.ACCOUNT_LIMIT) -> DataFrame:
    """The first ``k`` distinct AccountIDs in order of appearance.

    Partial min per task, then a top-k (TakeOrderedAndProject): no global sort.
    """
    first = df.groupBy("AccountID").agg(F.min(order_key(df)).alias("_first"))
    return first.orderBy("_first").limit(k).select("AccountID")


def distinct_accounts(df: DataFrame) -> DataFrame:
    """Distinct AccountIDs."""
    return df.select("AccountID").distinct()
