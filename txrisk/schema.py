"""Table schema and fixed values of the transaction-risk model.

Everything in this module is data, not logic: the declared schema of the
transaction table and the lists / thresholds that the risk rules must use
verbatim so that results equal the reference behaviour.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Declared schema of the base transaction table.
# Timestamp is a zone-free timestamp: the source text has no zone and the
# reference parses it into naive datetimes.
# --------------------------------------------------------------------------
TRANSACTION = T.StructType(
    [
        T.StructField("TransactionID", T.StringType()),
        T.StructField("Timestamp", T.TimestampNTZType()),
        T.StructField("AccountID", T.StringType()),
        T.StructField("AccountName", T.StringType()),
        T.StructField("OldBalance", T.DoubleType()),
        T.StructField("NewBalance", T.DoubleType()),
        T.StructField("Amount", T.DoubleType()),
        T.StructField("CardUsed", T.StringType()),
        T.StructField("TransactionMode", T.StringType()),
        T.StructField("Location", T.StringType()),
        T.StructField("MerchantCategory", T.StringType()),
        T.StructField("DeviceType", T.StringType()),
        T.StructField("UserBehaviorScore", T.DoubleType()),
        T.StructField("TransactionStatus", T.StringType()),
        T.StructField("AmountTaken", T.DoubleType()),
        T.StructField("Hour", T.IntegerType()),
        T.StructField("IsFraud", T.IntegerType()),
        T.StructField("Risk", T.StringType()),
        T.StructField("Probability", T.DoubleType()),
    ]
)

# ---- fixed values: column aliases (target, source) -----------------------
COLUMN_ALIASES = [
    ("NewBalance", "newbalanceOrig"),
    ("OldBalance", "oldbalanceOrg"),
    ("AmountTaken", "Amount"),
]

# ---- fixed values: numeric columns filled with 0 before feature work -----
FILL_ZERO_COLUMNS = ["OldBalance", "NewBalance", "AmountTaken", "Amount"]

# ---- fixed values: country risk scores (exact, case-sensitive) -----------
COUNTRY_RISK = {
    "Russia": 1.0,
    "Nigeria": 0.9,
    "China": 0.8,
    "Ukraine": 0.9,
    "Vietnam": 0.7,
    "North Korea": 1.0,
}
DEFAULT_COUNTRY_RISK = 0.1

# ---- fixed values: high-risk merchant categories -------------------------
HIGH_RISK_MERCHANTS = ["Casino", "Digital Goods", "Cryptocurrency", "Adult", "Gambling"]

# ---- fixed values: time features -----------------------------------------
DEFAULT_HOUR = 12
DEFAULT_DAY_OF_WEEK = 0
NIGHT_BEFORE_HOUR = 6
NIGHT_FROM_HOUR = 22
WEEKEND_FROM_DAY = 5  # Monday = 0 ... Sunday = 6
LARGE_TXN_SHARE = 0.5
ROUND_AMOUNT_UNIT = 100

# ---- fixed values: the nine fraud rules ----------------------------------
RULE_COUNTRIES = ["Russia", "Nigeria", "China"]
RULE_CARD = "Virtual Card"
RULE_MODE = "Online Transfer"
RULE_AMOUNT_SHARE = 0.7
RULE_NEGATIVE_BALANCE = -500.0
RULE_DEVICES = ["ATM", "POS Terminal"]
RULE_LOW_SCORE = 0.3
RULE_CREDIT_CARD = "Credit Card"
RULE_CREDIT_AMOUNT = 3000.0
RULE_ATM_MODE = "ATM Withdrawal"
RULE_ATM_BEFORE_HOUR = 6
RULE_NAMES = [
    "rule_risk_country",
    "rule_virtual_card",
    "rule_online_transfer",
    "rule_amount_over_balance",
    "rule_negative_balance",
    "rule_atm_pos_device",
    "rule_low_behavior",
    "rule_large_credit",
    "rule_night_atm",
]

# ---- fixed values: label thinning (keep about 60 % of suspects) ----------
THIN_MULTIPLIER = 7
THIN_OFFSET = 3
THIN_MODULUS = 10
THIN_KEEP_FROM = 4

# ---- fixed values: risk tiers and bands ----------------------------------
MEDIUM_SCORE_BELOW = 0.5
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]
UNKNOWN_RISK = "UNKNOWN"
RATE_DANGER_ABOVE = 20.0
RATE_WARNING_ABOVE = 10.0

# ---- fixed values: model features ----------------------------------------
CATEGORICAL_COLUMNS = ["CardUsed", "TransactionMode", "Location", "MerchantCategory", "DeviceType"]
BASE_FEATURES = [
    "OldBalance",
    "NewBalance",
    "Amount",
    "BalanceRatio",
    "AmountToBalanceRatio",
    "IsNegativeBalance",
    "CountryRiskScore",
    "UserBehaviorScore",
    "IsNight",
    "IsWeekend",
    "LargeTransaction",
    "SuspiciousAmount",
    "IsHighRiskMerchant",
]
FOREST_TREES = 200
FOREST_DEPTH = 10
FOREST_SEED = 42

# ---- fixed values: formats -----------------------------------------------
TXN_ID_FORMAT = "TXN%05d"
ACCOUNT_ID_FORMAT = "ACC%03d"
CUSTOMER_NAME_FORMAT = "Customer %d"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
ACCOUNT_LIMIT = 10
