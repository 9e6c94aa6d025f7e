"""Rule flags, rule-based label, risk tiers and risk derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import fit_row, flag
from txrisk.operators.profile import numeric_columns


def _inputs(frame):
    """(column names, types) of a DataFrame, or names only for a plain list."""
    if isinstance(frame, DataFrame):
        return frame.columns, dict(frame.dtypes)
    return list(frame), {}


def rule_predicates(frame) -> dict[str, Column]:
    """The nine rules as boolean columns (NULL comparisons count False).

    ``frame`` is the DataFrame (or its column names).  A rule whose input
    column is absent is False.  NaN in a float input counts as missing:
    Spark orders NaN above every number, pandas compares it as False.
    """
    cols, types = _inputs(frame)

    def _c(_cols, name):
        if name not in _cols:
            return None
        if types.get(name) in ("double", "float"):
            return F.nanvl(F.col(name), F.lit(None).cast(types[name]))
        return F.col(name)

    loc, card, mode = _c(cols, "Location"), _c(cols, "CardUsed"), _c(cols, "TransactionMode")
    amt, old, new = _c(cols, "Amount"), _c(cols, "OldBalance"), _c(cols, "NewBalance")
    dev, score, hour = _c(cols, "DeviceType"), _c(cols, "UserBehaviorScore"), _c(cols, "Hour")
    false = F.lit(False)

    def guard(pred, *inputs):
        return F.coalesce(pred(), false) if all(i is not None for i in inputs) else false

    return {
        "rule_risk_country": guard(lambda: loc.isin(S.RULE_COUNTRIES), loc),
        "rule_virtual_card": guard(lambda: card == S.RULE_CARD, card),
        "rule_online_transfer": guard(lambda: mode == S.RULE_MODE, mode),
        "rule_amount_over_balance": guard(lambda: amt > old * F.lit(S.RULE_AMOUNT_SHARE), amt, old),
        "rule_negative_balance": guard(lambda: new < F.lit(S.RULE_NEGATIVE_BALANCE), new),
        "rule_atm_pos_device": guard(lambda: dev.isin(S.RULE_DEVICES), dev),
        "rule_low_behavior": guard(lambda: score < F.lit(S.RULE_LOW_SCORE), score),
        "rule_large_credit": guard(
            lambda: (card == S.RULE_CREDIT_CARD) & (amt > F.lit(S.RULE_CREDIT_AMOUNT)), card, amt
        ),
        "rule_night_atm": guard(lambda: (mode == S.RULE_ATM_MODE) & (hour < S.RULE_ATM_BEFORE_HOUR), mode, hour),
    }


def any_rule(frame) -> Column:
    """True when at least one of the nine rules fires."""
    preds = list(rule_predicates(frame).values())
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def rule_flags(df: DataFrame) -> DataFrame:
    """Nine 0/1 rule columns plus ``any_rule``."""
    preds = rule_predicates(df)
    cols = {name: p.cast("int") for name, p in preds.items()}
    cols["any_rule"] = any_rule(df).cast("int")
    return df.withColumns(cols)


def rule_hits(df: DataFrame) -> DataFrame:
    """``rule_hits`` (names of the rules that fire, in rule order) and ``n_hits``."""
    preds = rule_predicates(df)
    hits = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in preds.items()]), lambda x: x.isNotNull())
    return df.withColumns({"rule_hits": hits, "n_hits": F.size(hits)})


def thinning_keep(key: Column, method: str = "linear") -> Column:
    """P17 thinning: a deterministic stand-in for the reference's uniform draw > 0.4.

    ``linear``: pmod(key * 7 + 3, 10) >= 4 on a numeric key (the fixture rule).
    ``hash``: pmod(xxhash64(key), 10) >= 4 for any key type.
    """
    if method == "hash":
        bucket = F.pmod(F.xxhash64(key), F.lit(S.THIN_MODULUS))
    else:
        bucket = F.pmod(key * S.THIN_MULTIPLIER + S.THIN_OFFSET, F.lit(S.THIN_MODULUS))
    return bucket >= S.THIN_KEEP_FROM


def label_expr(frame, key: Column, method: str = "linear") -> Column:
    return flag(any_rule(frame) & thinning_keep(key, method))


def label_from_rules(df: DataFrame, key: str = "txn_no", method: str = "linear") -> DataFrame:
    """IsFraud = any rule AND the row survives thinning."""
    return df.withColumn("IsFraud", label_expr(df, F.col(key), method))


def risk_tier_expr(is_fraud: Column, score: Column) -> Column:
    """Fraud -> HIGH; score < 0.5 -> MEDIUM; else LOW (missing -> LOW)."""
    return (
        F.when(F.coalesce(is_fraud == 1, F.lit(False)), F.lit("HIGH"))
        .when(F.coalesce(score < S.MEDIUM_SCORE_BELOW, F.lit(False)), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def risk_tier(df: DataFrame) -> DataFrame:
    """P18 on a frame with IsFraud and UserBehaviorScore."""
    return df.withColumn("Risk", risk_tier_expr(F.col("IsFraud"), F.col("UserBehaviorScore")))


def risk_from_label(df: DataFrame, label: str = "IsFraud") -> DataFrame:
    """1 -> HIGH, 0 -> LOW, anything else -> NULL."""
    c = F.col(label)
    return df.withColumn("Risk", F.when(c == 1, F.lit("HIGH")).when(c == 0, F.lit("LOW")))


def equal_width_bounds(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Upper edges of the first two of three equal-width, right-closed bins.

    min and max come from one global aggregate (partial per task, one row to
    the driver), like fitting an estimator; the edges are then literals in
    the per-row expression.  When all values are equal the range is widened
    by 0.1 % on each side (0.001 when the value is 0), so the single value
    falls in the middle bin.  ``None`` when the column has no values.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    lo, hi = fit_row(df, F.min(x).alias("lo"), F.max(x).alias("hi"))
    if lo is None:
        return None
    if lo == hi:
        pad = 0.001 if lo == 0 else abs(lo) * 0.001
        lo, hi = lo - pad, hi + pad
    step = (hi - lo) / 3.0
    return step * 1.0 + lo, step * 2.0 + lo


def risk_equal_width(df: DataFrame, column: str | None = None) -> DataFrame:
    """P20: three equal-width bins LOW / MEDIUM / HIGH on a numeric column.

    Defaults to the first numeric column.  Missing values stay NULL.
    """
    column = column or numeric_columns(df)[0]
    x = F.col(column).cast("double")
    bounds = equal_width_bounds(df, column)
    if bounds is None:
        return df.withColumn("Risk", F.lit(None).cast("string"))
    b1, b2 = (F.lit(b) for b in bounds)
    risk = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string")).when(x <= b1, "LOW").when(x <= b2, "MEDIUM")
    return df.withColumn("Risk", risk.otherwise(F.lit("HIGH")))


def risk_source(df: DataFrame) -> str:
    """P21 branch chosen from the schema: column, label, equal_width or unknown."""
    if "Risk" in df.columns:
        return "column"
    if "IsFraud" in df.columns:
        return "label"
    if numeric_columns(df):
        return "equal_width"
    return "unknown"


def derive_risk(df: DataFrame) -> DataFrame:
    """Keep Risk; else derive it from IsFraud; else equal-width on the
    first numeric column; else leave the frame as it is (no risk at all)."""
    src = risk_source(df)
    if src == "label":
        return risk_from_label(df)
    if src == "equal_width":
        return risk_equal_width(df)
    return df
