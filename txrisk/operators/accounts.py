"""Per-account roll-up.

"First row of an account" is the row with the smallest transaction order: the
number of the transaction, then its id as text, then the values themselves, so
that it is one stored row even where orders tie.  Every pass over the facts is a
hash aggregate of fixed-width values (smallest order, counts), so a hot account (even
a third of all rows) is one partial row per task and no row is sorted.  The few
rows that have an account's smallest order are joined back, and the smallest of
them is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import account_risk_level, col, numeric_value
from txrisk.operators.analytics import require

LAST = (1 << 63) - 1


def row_order(df: DataFrame, op: str, order_by: str | None = None) -> list[Column]:
    """The columns that order the rows: ``order_by``, else ``txn_no``, else the
    number in TransactionID (ids of another form come last); then the id as text."""
    tie = [F.col("TransactionID")] if "TransactionID" in df.columns else []
    if order_by is not None:
        require(df, op, order_by)
        return [col(order_by), *tie]
    if "txn_no" in df.columns:
        return [F.col("txn_no"), *tie]
    require(df, op, "TransactionID")
    number = F.coalesce(F.regexp_extract("TransactionID", r"^[A-Za-z]*([0-9]{1,18})$", 1).try_cast("long"), F.lit(LAST))
    return [F.when(F.col("TransactionID").isNotNull(), number), *tie]


def _ordered(df: DataFrame, op: str, order_by: str | None) -> DataFrame:
    """``df`` with ``_order``, and ``_tie`` for rows of the same order."""
    order = row_order(df, op, order_by)
    return df.withColumns({"_order": order[0], "_tie": order[1] if len(order) > 1 else F.lit(None).cast("string")})


def _account_rollup(
    df: DataFrame, fields: dict[str, tuple[str, object]], balance: str = "first", order_by: str | None = None, limit: int | None = None
) -> DataFrame:
    require(df, "account_summary", "AccountID")
    if balance not in ("first", "latest"):
        raise ValueError("balance must be 'first' or 'latest'")
    rows = _ordered(df, "account_summary", order_by)
    fraud = F.coalesce(F.sum(numeric_value(df, "IsFraud").cast("long")), F.lit(0)) if "IsFraud" in df.columns else F.lit(0).cast("long")
    latest = balance == "latest"
    taken = F.max("_order") if latest else F.min("_order")
    rolled = rows.groupBy("AccountID").agg(F.min("_order").alias("_first"), taken.alias("_at"), F.count(F.lit(1)).alias("TransactionCount"), fraud.alias("FraudCount"))
    if limit is not None:  # with all accounts that tie with the last of them; few unless ids have no number
        place = F.rank().over(Window.orderBy(F.col("_first").asc_nulls_last()))
        rolled = rolled.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    stored = [(out, src) for out, (src, _) in fields.items() if src in df.columns]
    named = rows.select("AccountID", "_order", "_tie", F.struct(F.lit(0).alias("_"), *[F.col(src).alias(out) for out, src in stored]).alias("_row"))
    ids = rolled.select(F.col("AccountID").alias("_id"), F.col("_at").alias("_when"))
    found = named.join(ids, F.col("AccountID").eqNullSafe(F.col("_id")) & F.col("_order").eqNullSafe(F.col("_when")))
    one = F.struct("_tie", "_row")
    found = found.groupBy("_id").agg((F.max(one) if latest else F.min(one)).alias("_one"), F.min("_tie").alias("_tie"))
    out = rolled.join(found, F.col("AccountID").eqNullSafe(F.col("_id")), "left")
    if limit is not None:
        out = out.orderBy(F.col("_first").asc_nulls_last(), "_tie", "AccountID").limit(limit)
    defaults = {o: (F.col(f"_one._row.{o}") if (o, s_) in stored else F.lit(d)) for o, (s_, d) in fields.items()}
    return out.withColumn("_row", F.struct(*[c.alias(o) for o, c in defaults.items()]))


SUMMARY_FIELDS = {"AccountName": ("AccountName", "Unknown"), "NewBalance": ("NewBalance", 0.0)}
DETAIL_FIELDS = {
    "AccountName": ("AccountName", "Unknown"),
    "OldBalance": ("OldBalance", 0.0),
    "NewBalance": ("NewBalance", 0.0),
}


def _project(rolled: DataFrame, fields) -> DataFrame:
    return rolled.select(
        "AccountID",
        *[F.col(f"_row.{k}").cast("string" if k == "AccountName" else "double").alias(k) for k in fields],
        "TransactionCount",
        "FraudCount",
        account_risk_level(F.col("FraudCount")).alias("RiskLevel"),
    )


def account_summary(
    df: DataFrame, limit: int | None = S.ACCOUNT_LIMIT, balance: str = "first", order_by: str | None = None
) -> DataFrame:
    """First ``limit`` accounts in order of appearance (``None`` = all).

    Per account: AccountName and NewBalance of its first row, row count,
    fraud count, RiskLevel.  A missing AccountID takes a slot among the first
    ``limit`` but yields no row, as in the reference.  ``balance="latest"``
    takes name and balance from the account's last row instead (the page
    labels this figure "current balance").  ``order_by`` names the column of
    appearance for tables without ``txn_no`` and ``TransactionID``.
    """
    rolled = _account_rollup(df, SUMMARY_FIELDS, balance, order_by, limit)
    return _project(rolled.where(F.col("AccountID").isNotNull()), SUMMARY_FIELDS)


def account_details(df: DataFrame, account_id: str, balance: str = "first", order_by: str | None = None) -> DataFrame:
    """A10: one account (zero rows when unknown: the caller's 404).

    The equality filter is applied before the aggregate and reaches the
    Parquet scan as a pushed filter when AccountID is a stored column.
    """
    one = df.where(F.col("AccountID") == F.lit(account_id))
    return _project(_account_rollup(one, DETAIL_FIELDS, balance, order_by), DETAIL_FIELDS)


def first_txn_per_account(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """The whole first row of every account, by the same order as A09.

    The smallest order of each account is found by a hash aggregate and its row by
    a join, instead of a window that would sort every account.
    """
    rows = _ordered(df, "first_txn_per_account", order_by)
    first = rows.groupBy("AccountID").agg(F.min("_order").alias("_at")).withColumnRenamed("AccountID", "_id")
    same = F.col("AccountID").eqNullSafe(F.col("_id")) & F.col("_order").eqNullSafe(F.col("_at"))
    row = F.struct("_tie", F.struct(*[col(c) for c in df.columns]).alias("row"))
    return rows.join(first, same).groupBy("_id").agg(F.min(row).alias("_row")).select("_row.row.*")
