"""The ``transactions`` table derived from the driver's tables.

events (fact) joined with customer (dimension) on user_id = c_custkey, then
mapped column by column onto the 19-column transaction schema.  The mapping
lists below are fixed values of the test fixture.

Join strategy: no hint.  Catalyst broadcasts customer only when its measured
or estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
re-checks the real shuffle size at runtime); beyond that it is a sort-merge
join whose skewed partitions (one hot user) AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.columns import format_account_id, format_txn_id, lookup, pick
from txrisk.operators.rules import label_expr, risk_tier_expr
from txrisk.plans.joins import join_dimension

# ---- fixed values: fixture mappings ----------------------------------------
CARDS = ["Credit Card", "Debit Card", "Prepaid Card", "Corporate Card", "Virtual Card"]
MODES = {
    "view": "Mobile Payment",
    "click": "Online Transfer",
    "purchase": "POS Swipe",
    "signup": "Bank Transfer",
    "error": "ATM Withdrawal",
}
LOCATIONS = ["New York", "California", "Texas", "Florida", "Illinois", "Russia", "Nigeria", "China", "UK", "Germany"]
MERCHANTS = [
    "Retail",
    "ATM",
    "E-commerce",
    "Restaurant",
    "Travel",
    "Entertainment",
    "Utilities",
    "Healthcare",
    "Casino",
    "Digital Goods",
    "Cryptocurrency",
    "Adult",
    "Gambling",
]
DEVICES = ["Mobile", "Desktop", "Tablet", "ATM", "POS Terminal"]
STATUS_FAILED_FROM = 17  # event_id % 20: 0-16 Completed, 17-18 Failed, 19 Pending
STATUS_PENDING_FROM = 19
# ---- fixed values: gaps of the dirty variant (column -> (key, modulus)) -----
DIRTY_GAPS = {
    "Amount": ("k", 17),
    "AmountTaken": ("k", 17),
    "OldBalance": ("k", 23),
    "Timestamp": ("k", 19),
    "Location": ("event_id", 29),
    "CardUsed": ("event_id", 29),
    "UserBehaviorScore": ("event_id", 37),
}
DIRTY_LABEL_GAP = ("event_id", 31)

COLUMNS = [
    "TransactionID",
    "Timestamp",
    "AccountID",
    "AccountName",
    "OldBalance",
    "NewBalance",
    "Amount",
    "CardUsed",
    "TransactionMode",
    "Location",
    "MerchantCategory",
    "DeviceType",
    "UserBehaviorScore",
    "TransactionStatus",
    "AmountTaken",
    "Hour",
    "IsFraud",
    "Risk",
    "txn_no",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is now: its files are listed at every call."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _joined(events: DataFrame, customer: DataFrame, salt_buckets: int = 0) -> DataFrame:
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", "props")
    cu = customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    # a left join: an event of an unknown customer is still a transaction
    return join_dimension(ev, cu, "user_id", "c_custkey", "left", salt_buckets=salt_buckets, salt_columns=["event_id"])


def _base_columns() -> list[Column]:
    k = F.get_json_object("props", "$.k").try_cast("int")
    amount = F.floor("value").cast("double") * F.lit(10.0)
    status_slot = F.col("event_id") % 20
    return [
        F.col("event_id"),
        k.alias("k"),
        format_txn_id(F.col("event_id")).alias("TransactionID"),
        F.col("ts").alias("Timestamp"),
        format_account_id(F.col("c_custkey")).alias("AccountID"),
        F.col("c_name").alias("AccountName"),
        F.col("c_acctbal").alias("OldBalance"),
        (F.col("c_acctbal") - amount).alias("NewBalance"),
        amount.alias("Amount"),
        pick(k % 5, CARDS).alias("CardUsed"),
        lookup(F.col("event_type"), MODES).alias("TransactionMode"),
        pick(F.col("c_nationkey") % 10, LOCATIONS).alias("Location"),
        pick(k % 13, MERCHANTS).alias("MerchantCategory"),
        pick(F.col("event_id") % 5, DEVICES).alias("DeviceType"),
        ((F.lit(10) + (F.col("event_id") * 37) % 90).cast("double") / F.lit(100.0)).alias("UserBehaviorScore"),
        F.when(status_slot < STATUS_FAILED_FROM, "Completed")
        .when(status_slot < STATUS_PENDING_FROM, "Failed")
        .otherwise("Pending")
        .alias("TransactionStatus"),
        amount.alias("AmountTaken"),
    ]


def _gap(column: str, key: str, modulus: int) -> Column:
    return F.when(F.col(key) % modulus == 0, F.lit(None)).otherwise(F.col(column))


def transactions(spark: SparkSession, sf_dir: str, dirty: bool = False, salt_buckets: int = 0) -> DataFrame:
    """The fixture table (FIXTURES.md 3); ``dirty=True`` gives the gapped
    variant of FIXTURES.md 4 (rules and tier are computed on the gapped
    values, then IsFraud itself is gapped)."""
    events, customer = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "customer")
    return transactions_from(events, customer, dirty, salt_buckets)


def transactions_from(events: DataFrame, customer: DataFrame, dirty: bool = False, salt_buckets: int = 0) -> DataFrame:
    """The fixture mapping over given events / customer frames (batch or stream).

    ``salt_buckets > 1`` spreads each user's events over that many join
    partitions (see ``plans.joins``) for tables where one user is hot and the
    customer table is too large to broadcast.
    """
    joined = _joined(events, customer, salt_buckets)
    columns, gaps, hour, label, risk = _mapping(joined, dirty)
    base = joined.select(*columns)
    if dirty:
        base = base.withColumns(gaps)
    out = base.withColumn("Hour", hour).withColumn("IsFraud", label).withColumn("Risk", risk)
    return out.withColumn("txn_no", F.col("event_id")).select(*COLUMNS)


# The mapping's expressions name columns and hold no table: made once for a session and the
# types of its tables, they spare each query some hundred calls into the JVM.
_MAPPINGS: dict[tuple, tuple] = {}


def _mapping(joined: DataFrame, dirty: bool) -> tuple:
    key = (joined.sparkSession.sparkContext.applicationId, dirty, tuple(joined.dtypes))
    if key not in _MAPPINGS:
        columns = _base_columns()
        gaps = {c: _gap(c, k, m) for c, (k, m) in DIRTY_GAPS.items()}
        base = joined.select(*columns)
        base = (base.withColumns(gaps) if dirty else base).withColumn("Hour", F.hour("Timestamp"))
        label = label_expr(base, F.col("event_id"))
        if dirty:
            label = F.when(F.col(DIRTY_LABEL_GAP[0]) % DIRTY_LABEL_GAP[1] == 0, F.lit(None)).otherwise(label)
        _MAPPINGS[key] = (columns, gaps, F.hour("Timestamp"), label, risk_tier_expr(F.col("IsFraud"), F.col("UserBehaviorScore")))
    return _MAPPINGS[key]
