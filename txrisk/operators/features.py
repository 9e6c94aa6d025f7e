"""Per-row risk features.

Every feature is a stateless column expression.  Each ``*_exprs`` builder
looks at the input columns (the schema is known at plan time, so the
"column absent" branches are decided before anything runs) and returns the
new columns; ``create_features`` applies alias -> fill -> all derived
columns as three projections that Catalyst collapses into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import schema as S
from txrisk.functions.columns import flag, lookup, parse_timestamp, safe_ratio


def _has(cols, *names) -> bool:
    return all(n in cols for n in names)


# ---- P01 / P25 ------------------------------------------------------------
def add_aliases(df: DataFrame) -> DataFrame:
    """Fill a missing target column from its alias when the alias exists."""
    new = {}
    for target, source in S.COLUMN_ALIASES:
        if target not in df.columns and target not in new and source in df.columns:
            new[target] = F.col(source)
    return df.withColumns(new) if new else df


# ---- P02 -------------------------------------------------------------------
def fill_numeric(df: DataFrame) -> DataFrame:
    """Missing (NULL or NaN) balances and amounts become 0."""
    present = [c for c in S.FILL_ZERO_COLUMNS if c in df.columns]
    return df.fillna(0, subset=present) if present else df


# ---- P03-P14 as expression builders ----------------------------------------
def balance_ratio_exprs(cols) -> dict[str, Column]:
    """NewBalance / (OldBalance + 1)."""
    if not _has(cols, "OldBalance", "NewBalance"):
        return {}
    return {"BalanceRatio": safe_ratio(F.col("NewBalance"), F.col("OldBalance") + F.lit(1))}


def amount_ratio_exprs(cols) -> dict[str, Column]:
    """AmountTaken / (OldBalance + 1)."""
    if not _has(cols, "AmountTaken", "OldBalance"):
        return {}
    return {"AmountToBalanceRatio": safe_ratio(F.col("AmountTaken"), F.col("OldBalance") + F.lit(1))}


def negative_balance_exprs(cols) -> dict[str, Column]:
    """NewBalance < 0 and OldBalance > 0."""
    if not _has(cols, "NewBalance", "OldBalance"):
        return {}
    return {"IsNegativeBalance": flag((F.col("NewBalance") < 0) & (F.col("OldBalance") > 0))}


def country_risk_exprs(cols) -> dict[str, Column]:
    """Exact lookup of Location in the country risk list, else 0.1."""
    if "Location" not in cols:
        return {"CountryRiskScore": F.lit(S.DEFAULT_COUNTRY_RISK)}
    return {"CountryRiskScore": lookup(F.col("Location"), S.COUNTRY_RISK, S.DEFAULT_COUNTRY_RISK)}


def merchant_risk_exprs(cols) -> dict[str, Column]:
    """MerchantCategory in the high-risk list."""
    if "MerchantCategory" not in cols:
        return {"IsHighRiskMerchant": F.lit(0)}
    return {"IsHighRiskMerchant": flag(F.col("MerchantCategory").isin(S.HIGH_RISK_MERCHANTS))}


def parsed_timestamp(df: DataFrame) -> Column:
    """The Timestamp column as a timestamp; unparseable text -> NULL."""
    dtype = df.schema["Timestamp"].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.col("Timestamp")
    if isinstance(dtype, T.DateType):
        return F.col("Timestamp").cast("timestamp_ntz")
    return parse_timestamp(F.col("Timestamp").cast("string"))


def time_exprs(df: DataFrame) -> dict[str, Column]:
    """Timestamp, Hour, DayOfWeek (Monday = 0), IsNight, IsWeekend."""
    if "Timestamp" not in df.columns:
        return {
            "Hour": F.lit(S.DEFAULT_HOUR),
            "DayOfWeek": F.lit(S.DEFAULT_DAY_OF_WEEK),
            "IsNight": F.lit(0),
            "IsWeekend": F.lit(0),
        }
    ts = parsed_timestamp(df)
    hour = F.coalesce(F.hour(ts), F.lit(S.DEFAULT_HOUR))
    day = F.coalesce(F.weekday(ts), F.lit(S.DEFAULT_DAY_OF_WEEK))
    return {
        "Timestamp": ts,
        "Hour": hour,
        "DayOfWeek": day,
        "IsNight": flag((hour < S.NIGHT_BEFORE_HOUR) | (hour >= S.NIGHT_FROM_HOUR)),
        "IsWeekend": flag(day >= S.WEEKEND_FROM_DAY),
    }


def large_txn_exprs(cols) -> dict[str, Column]:
    """AmountTaken > OldBalance * 0.5 (strict)."""
    if not _has(cols, "AmountTaken", "OldBalance"):
        return {}
    return {"LargeTransaction": flag(F.col("AmountTaken") > F.col("OldBalance") * F.lit(S.LARGE_TXN_SHARE))}


def round_amount_exprs(cols) -> dict[str, Column]:
    """AmountTaken is a multiple of 100 (0 and filled-missing count)."""
    if "AmountTaken" not in cols:
        return {}
    return {"SuspiciousAmount": flag((F.col("AmountTaken") % S.ROUND_AMOUNT_UNIT) == 0)}


def derived_exprs(df: DataFrame) -> dict[str, Column]:
    """All P03-P14 columns in the reference order."""
    cols = df.columns
    out: dict[str, Column] = {}
    out.update(balance_ratio_exprs(cols))
    out.update(amount_ratio_exprs(cols))
    out.update(negative_balance_exprs(cols))
    out.update(country_risk_exprs(cols))
    out.update(merchant_risk_exprs(cols))
    out.update(time_exprs(df))
    out.update(large_txn_exprs(cols))
    out.update(round_amount_exprs(cols))
    return out


def _prepared(df: DataFrame) -> DataFrame:
    return fill_numeric(add_aliases(df))


def _apply(df: DataFrame, builder) -> DataFrame:
    base = _prepared(df)
    exprs = builder(base)
    return base.withColumns(exprs) if exprs else base


# ---- single-feature operators (each keeps all input columns) --------------
def add_balance_ratio(df):
    return _apply(df, lambda d: balance_ratio_exprs(d.columns))


def add_amount_ratio(df):
    return _apply(df, lambda d: amount_ratio_exprs(d.columns))


def add_negative_balance(df):
    return _apply(df, lambda d: negative_balance_exprs(d.columns))


def add_country_risk(df):
    return _apply(df, lambda d: country_risk_exprs(d.columns))


def add_merchant_risk(df):
    return _apply(df, lambda d: merchant_risk_exprs(d.columns))


def add_time_features(df):
    return _apply(df, time_exprs)


def add_large_txn(df):
    return _apply(df, lambda d: large_txn_exprs(d.columns))


def add_round_amount(df):
    return _apply(df, lambda d: round_amount_exprs(d.columns))


COUNTRY_ROWS = 10_000  # (name, double) rows: well under 1 MB
COUNTRY_SALTS = 16


def add_country_risk_join(df: DataFrame, risk_table: DataFrame, default: float = S.DEFAULT_COUNTRY_RISK) -> DataFrame:
    """P06 when the risk list is a table (Location, score).

    The table is first reduced to one row per Location so the left join never
    multiplies rows.  Its reduced size is measured: up to ``COUNTRY_ROWS`` rows
    it is broadcast and the fact is not shuffled; a longer list is replicated
    over ``COUNTRY_SALTS`` salts of a hash of the fact's row, so one frequent
    location is spread over as many partitions.
    """
    if "Location" not in df.columns:
        return df.withColumn("CountryRiskScore", F.lit(default))
    scores = risk_table.groupBy(F.col("Location").alias("_place")).agg(F.max("score").alias("_country_score"))
    if scores.count() <= COUNTRY_ROWS:
        out = df.join(F.broadcast(scores), F.col("Location") == F.col("_place"), "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COUNTRY_SALTS - 1).cast("long")))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(COUNTRY_SALTS)))
        same = (F.col("Location") == F.col("_place")) & (F.col("_salt") == F.col("_salt_of"))
        out = salted.join(scores.withColumn("_salt_of", salts), same, "left")
    return out.withColumn("CountryRiskScore", F.coalesce(F.col("_country_score"), F.lit(default))).select(
        *df.columns, "CountryRiskScore"
    )


# ---- P15 -------------------------------------------------------------------
def create_features(df: DataFrame) -> DataFrame:
    """P01-P14 in order; input columns are kept (Timestamp/Hour replaced)."""
    return _apply(df, derived_exprs)
