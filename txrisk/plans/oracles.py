"""DuckDB SQL twins of the registered queries (the correctness gate).

Each string runs on DuckDB with the driver's tables registered as views.  The
``transactions`` and ``transactions_dirty`` relations are rebuilt here in
DuckDB SQL from ``events`` and ``customer``, independently of the Spark code.
"""

from __future__ import annotations

from txrisk import schema as S
from txrisk.sources import fixture as FX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_MODE_CASE = "CASE e.event_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in FX.MODES.items()) + " END"

_BASE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
base AS (
  SELECT e.event_id, e.k,
         printf('TXN%05d', e.event_id) AS TransactionID,
         e.ts AS "Timestamp",
         printf('ACC%03d', c.c_custkey) AS AccountID,
         c.c_name AS AccountName,
         c.c_acctbal AS OldBalance,
         c.c_acctbal - floor(e.value) * CAST(10.0 AS DOUBLE) AS NewBalance,
         floor(e.value) * CAST(10.0 AS DOUBLE) AS Amount,
         {_list(FX.CARDS)}[e.k % 5 + 1] AS CardUsed,
         {_MODE_CASE} AS TransactionMode,
         {_list(FX.LOCATIONS)}[c.c_nationkey % 10 + 1] AS Location,
         {_list(FX.MERCHANTS)}[e.k % 13 + 1] AS MerchantCategory,
         {_list(FX.DEVICES)}[e.event_id % 5 + 1] AS DeviceType,
         CAST(10 + (e.event_id * 37) % 90 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS UserBehaviorScore,
         CASE WHEN e.event_id % 20 < 17 THEN 'Completed' WHEN e.event_id % 20 < 19 THEN 'Failed'
              ELSE 'Pending' END AS TransactionStatus,
         floor(e.value) * CAST(10.0 AS DOUBLE) AS AmountTaken
  FROM ev e LEFT JOIN customer c ON e.user_id = c.c_custkey
)"""

_DIRTY_BASE = """
dbase AS (
  SELECT event_id, k, TransactionID,
         CASE WHEN k % 19 = 0 THEN NULL ELSE "Timestamp" END AS "Timestamp",
         AccountID, AccountName,
         CASE WHEN k % 23 = 0 THEN NULL ELSE OldBalance END AS OldBalance,
         NewBalance,
         CASE WHEN k % 17 = 0 THEN NULL ELSE Amount END AS Amount,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE CardUsed END AS CardUsed,
         TransactionMode,
         CASE WHEN event_id % 29 = 0 THEN NULL ELSE Location END AS Location,
         MerchantCategory, DeviceType,
         CASE WHEN event_id % 37 = 0 THEN NULL ELSE UserBehaviorScore END AS UserBehaviorScore,
         TransactionStatus,
         CASE WHEN k % 17 = 0 THEN NULL ELSE AmountTaken END AS AmountTaken
  FROM base
)"""


def _rules_sql(alias: str = "") -> dict[str, str]:
    p = f"{alias}." if alias else ""
    return {
        "rule_risk_country": f"{p}Location IN {_in(S.RULE_COUNTRIES)}",
        "rule_virtual_card": f"{p}CardUsed = {_q(S.RULE_CARD)}",
        "rule_online_transfer": f"{p}TransactionMode = {_q(S.RULE_MODE)}",
        "rule_amount_over_balance": f"{p}Amount > {p}OldBalance * CAST(0.7 AS DOUBLE)",
        "rule_negative_balance": f"{p}NewBalance < CAST(-500 AS DOUBLE)",
        "rule_atm_pos_device": f"{p}DeviceType IN {_in(S.RULE_DEVICES)}",
        "rule_low_behavior": f"{p}UserBehaviorScore < CAST(0.3 AS DOUBLE)",
        "rule_large_credit": f"{p}CardUsed = {_q(S.RULE_CREDIT_CARD)} AND {p}Amount > CAST(3000 AS DOUBLE)",
        "rule_night_atm": f"{p}TransactionMode = {_q(S.RULE_ATM_MODE)} AND {p}Hour < 6",
    }


def _any_rule_sql() -> str:
    return " OR ".join(f"coalesce(({r}), false)" for r in _rules_sql().values())


_LABEL = f"CAST(({_any_rule_sql()}) AND (event_id * 7 + 3) % 10 >= 4 AS INTEGER)"
_TIER = (
    "CASE WHEN coalesce(IsFraud = 1, false) THEN 'HIGH' "
    "WHEN coalesce(UserBehaviorScore < CAST(0.5 AS DOUBLE), false) THEN 'MEDIUM' ELSE 'LOW' END"
)
_COLS = ", ".join(f'"{c}"' if c == "Timestamp" else c for c in FX.COLUMNS)

FIXTURE_CTE = f"""WITH {_BASE},
hb AS (SELECT *, CAST(hour("Timestamp") AS INTEGER) AS Hour FROM base),
lb AS (SELECT *, {_LABEL} AS IsFraud FROM hb),
transactions AS (SELECT *, {_TIER} AS Risk, event_id AS txn_no FROM lb),
tx AS (SELECT {_COLS} FROM transactions)
"""

DIRTY_CTE = f"""WITH {_BASE}, {_DIRTY_BASE},
hb AS (SELECT *, CAST(hour("Timestamp") AS INTEGER) AS Hour FROM dbase),
lb AS (SELECT *, CASE WHEN event_id % 31 = 0 THEN NULL ELSE {_LABEL} END AS IsFraud FROM hb),
transactions AS (SELECT *, {_TIER} AS Risk, event_id AS txn_no FROM lb),
tx AS (SELECT {_COLS} FROM transactions)
"""


def _feature_exprs() -> dict[str, str]:
    """P03-P14 over filled columns f_* (SQL twin of create_features)."""
    country = " ".join(f"WHEN {_q(k)} THEN CAST({v} AS DOUBLE)" for k, v in S.COUNTRY_RISK.items())
    ts = '"Timestamp"'
    return {
        "BalanceRatio": "CASE WHEN OldBalance + 1 = 0 THEN NULL ELSE NewBalance / (OldBalance + 1) END",
        "AmountToBalanceRatio": "CASE WHEN OldBalance + 1 = 0 THEN NULL ELSE AmountTaken / (OldBalance + 1) END",
        "IsNegativeBalance": "CAST(coalesce(NewBalance < 0 AND OldBalance > 0, false) AS INTEGER)",
        "CountryRiskScore": f"coalesce(CASE Location {country} END, CAST(0.1 AS DOUBLE))",
        "IsHighRiskMerchant": f"CAST(coalesce(MerchantCategory IN {_in(S.HIGH_RISK_MERCHANTS)}, false) AS INTEGER)",
        "Hour": f"CAST(coalesce(hour({ts}), 12) AS INTEGER)",
        "DayOfWeek": f"CAST(coalesce(isodow({ts}) - 1, 0) AS INTEGER)",
        "IsNight": f"CAST(coalesce(hour({ts}), 12) < 6 OR coalesce(hour({ts}), 12) >= 22 AS INTEGER)",
        "IsWeekend": f"CAST(coalesce(isodow({ts}) - 1, 0) >= 5 AS INTEGER)",
        "LargeTransaction": "CAST(coalesce(AmountTaken > OldBalance * CAST(0.5 AS DOUBLE), false) AS INTEGER)",
        "SuspiciousAmount": "CAST(coalesce(AmountTaken % 100 = 0, false) AS INTEGER)",
    }


_FILLED = """filled AS (
  SELECT TransactionID, "Timestamp", AccountID, AccountName,
         coalesce(OldBalance, 0) AS OldBalance, coalesce(NewBalance, 0) AS NewBalance,
         coalesce(Amount, 0) AS Amount, CardUsed, TransactionMode, Location, MerchantCategory, DeviceType,
         UserBehaviorScore, TransactionStatus, coalesce(AmountTaken, 0) AS AmountTaken,
         Hour, IsFraud, Risk, txn_no
  FROM tx
)"""

_FEATURE_ORDER = [
    "BalanceRatio",
    "AmountToBalanceRatio",
    "IsNegativeBalance",
    "CountryRiskScore",
    "IsHighRiskMerchant",
    "DayOfWeek",
    "IsNight",
    "IsWeekend",
    "LargeTransaction",
    "SuspiciousAmount",
]


def _features_select(cols: list[str] | None = None) -> str:
    fx = _feature_exprs()
    base = [c for c in FX.COLUMNS if c != "Hour"]
    parts = [f'"{c}"' if c == "Timestamp" else c for c in base]
    parts.append(f"{fx['Hour']} AS Hour")
    parts += [f"{fx[n]} AS {n}" for n in _FEATURE_ORDER]
    if cols is not None:
        return "SELECT " + ", ".join(["TransactionID"] + [f"{fx[n]} AS {n}" for n in cols]) + " FROM filled"
    return "SELECT " + ", ".join(parts) + " FROM filled"


def _with(cte: str, extra: str = "") -> str:
    return cte.rstrip() + (",\n" + extra if extra else "") + "\n"


def _card_fraud(cte=FIXTURE_CTE) -> str:
    return (
        cte
        + """SELECT CardUsed, COUNT(*) AS total_transactions, CAST(SUM(IsFraud) AS BIGINT) AS fraud_count,
       ROUND(CAST(SUM(IsFraud) AS DOUBLE) * 100.0 / COUNT(*), 2) AS fraud_rate
FROM tx GROUP BY CardUsed"""
    )


def _value_counts(col: str, cte=FIXTURE_CTE) -> str:
    return cte + f'SELECT {col}, COUNT(*) AS "count" FROM tx WHERE {col} IS NOT NULL GROUP BY {col}'


def _rate_band(x: str) -> str:
    return f"CASE WHEN {x} > 20 THEN 'danger' WHEN {x} > 10 THEN 'warning' ELSE 'success' END"


def _first_row_rollup(fields: str, where: str = "", limit: str = "") -> str:
    return (
        FIXTURE_CTE
        + f""", firsts AS (
  SELECT AccountID, min(txn_no) AS first_no, COUNT(*) AS TransactionCount,
         CAST(coalesce(SUM(IsFraud), 0) AS BIGINT) AS FraudCount
  FROM tx {where} GROUP BY AccountID {limit}
)
SELECT f.AccountID, {fields}, f.TransactionCount, f.FraudCount,
       CASE WHEN f.FraudCount > 0 THEN 'HIGH' ELSE 'LOW' END AS RiskLevel
FROM firsts f JOIN tx t ON t.txn_no = f.first_no
WHERE f.AccountID IS NOT NULL"""
    )


def _equal_width(col: str, src: str = "tx") -> str:
    """P20 twin: right-closed equal-width thirds, pandas.cut edges."""
    return f"""mm AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}),
edges AS (
  SELECT CASE WHEN lo = hi THEN lo - (CASE WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END) ELSE lo END AS l,
         CASE WHEN lo = hi THEN hi + (CASE WHEN lo = 0 THEN 0.001 ELSE abs(lo) * 0.001 END) ELSE hi END AS h
  FROM mm
),
bounds AS (SELECT ((h - l) / 3.0) * 1.0 + l AS b1, ((h - l) / 3.0) * 2.0 + l AS b2 FROM edges),
binned AS (
  SELECT t.*, CASE WHEN t.{col} IS NULL THEN NULL WHEN CAST(t.{col} AS DOUBLE) <= b.b1 THEN 'LOW'
                   WHEN CAST(t.{col} AS DOUBLE) <= b.b2 THEN 'MEDIUM' ELSE 'HIGH' END AS EqRisk
  FROM {src} t, bounds b
)"""


_NUMERIC_COLS = ["OldBalance", "NewBalance", "Amount", "UserBehaviorScore", "AmountTaken", "Hour", "IsFraud", "txn_no"]


def _numeric_profile(cte: str, digits: int = 4) -> str:
    parts = []
    for i, c in enumerate(_NUMERIC_COLS):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", round(avg({x}), {digits}) AS mean, "
            f"round(stddev_samp({x}), {digits}) AS std, min({x}) AS \"min\", max({x}) AS \"max\" FROM tx"
        )
    return cte + "\nUNION ALL\n".join(parts)


def _profile_long(cte: str, with_risk: bool = True, digits: int = 6) -> str:
    cols = _NUMERIC_COLS
    parts = ["SELECT 'total_transactions' AS section, NULL::VARCHAR AS \"key\", CAST(COUNT(*) AS DOUBLE) AS value FROM tx"]
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts += [
            f"SELECT 'mean', '{c}', round(avg({x}), {digits}) FROM tx",
            f"SELECT 'std', '{c}', round(stddev_samp({x}), {digits}) FROM tx",
            f"SELECT 'min', '{c}', min({x}) FROM tx",
            f"SELECT 'max', '{c}', max({x}) FROM tx",
        ]
    if with_risk:
        parts += [
            "SELECT 'high_risk_count', NULL, CAST(count(*) FILTER (WHERE Risk = 'HIGH') AS DOUBLE) FROM tx",
            f"SELECT 'high_risk_amount', NULL, round(coalesce(sum(Amount) FILTER (WHERE Risk = 'HIGH'), 0), {digits}) FROM tx",
            "SELECT 'risk_distribution', Risk, CAST(COUNT(*) AS DOUBLE) FROM tx WHERE Risk IS NOT NULL GROUP BY Risk",
        ]
    else:
        parts += [
            "SELECT 'risk_distribution', 'LOW', CAST(COUNT(*) AS DOUBLE) FROM tx",
            "SELECT 'high_risk_count', NULL, CAST(0 AS DOUBLE)",
            "SELECT 'high_risk_amount', NULL, CAST(0 AS DOUBLE)",
        ]
    parts += [
        "SELECT 'card_usage', CardUsed, CAST(COUNT(*) AS DOUBLE) FROM tx WHERE CardUsed IS NOT NULL GROUP BY CardUsed",
        "SELECT 'transaction_modes', TransactionMode, CAST(COUNT(*) AS DOUBLE) FROM tx "
        "WHERE TransactionMode IS NOT NULL GROUP BY TransactionMode",
    ]
    return cte + "\nUNION ALL\n".join(parts)


_MATRIX_COLS = S.BASE_FEATURES + [f"{c}_encoded" for c in S.CATEGORICAL_COLUMNS]


def _encoded(col: str) -> str:
    v = f"coalesce(CAST({col} AS VARCHAR), 'nan')"
    return f"""enc_{col} AS (
  SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT {v} AS v FROM feats) d
)"""


STUMP_COLUMNS = [
    "IsNegativeBalance", "CountryRiskScore", "IsNight", "IsWeekend", "LargeTransaction", "SuspiciousAmount", "IsHighRiskMerchant",
    *[f"{c}_encoded" for c in S.CATEGORICAL_COLUMNS],
]


def _stump_scores() -> str:
    """The best split of one feature by the weighted Gini impurity, and every row's score by it."""
    values = " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v, IsFraud AS y FROM matrix" for i, c in enumerate(STUMP_COLUMNS))
    value = "CASE best.f " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(STUMP_COLUMNS)) + " END"
    return (
        _feature_matrix_cte(FIXTURE_CTE)
        + f""", vals AS ({values}),
total AS (SELECT count(*) FILTER (WHERE IsFraud = 0) AS n0, count(*) FILTER (WHERE IsFraud = 1) AS n1 FROM matrix),
cnt AS (SELECT f, v, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM vals GROUP BY f, v),
cum AS (SELECT f, v, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1 FROM cnt WINDOW w AS (PARTITION BY f ORDER BY v)),
sides AS (SELECT f, v, CAST(l0 AS DOUBLE) / t.n0 AS a0, CAST(l1 AS DOUBLE) / t.n1 AS a1, CAST(t.n0 - l0 AS DOUBLE) / t.n0 AS b0,
    CAST(t.n1 - l1 AS DOUBLE) / t.n1 AS b1 FROM cum, total t WHERE l0 + l1 >= 2 AND t.n0 + t.n1 - l0 - l1 >= 2),
gain AS (SELECT *, a0 * a1 / (a0 + a1) + b0 * b1 / (b0 + b1) AS impurity FROM sides),
best AS (SELECT f, v, a0, a1, b0, b1 FROM gain ORDER BY impurity, f, v LIMIT 1),
scored AS (SELECT TransactionID, IsFraud,
    CAST(CASE WHEN {value} <= best.v THEN a1 > a0 ELSE b1 > b0 END AS INTEGER) AS prediction,
    round(CASE WHEN {value} <= best.v THEN a1 / (a0 + a1) ELSE b1 / (b0 + b1) END * 100.0, 6) AS Probability FROM matrix, best)
"""
    )


def _feature_matrix_cte(cte: str) -> str:
    fx = _features_select()
    encs = ",\n".join(_encoded(c) for c in S.CATEGORICAL_COLUMNS)
    joins = " ".join(
        f"JOIN enc_{c} ON enc_{c}.v = coalesce(CAST(f.{c} AS VARCHAR), 'nan')" for c in S.CATEGORICAL_COLUMNS
    )
    codes = ", ".join(f"enc_{c}.code AS {c}_encoded" for c in S.CATEGORICAL_COLUMNS)
    base = ", ".join(f"CAST(coalesce(f.{c}, 0) AS DOUBLE) AS {c}" for c in S.BASE_FEATURES)
    return (
        _with(cte, _FILLED)
        + f""", feats AS ({fx}),
{encs},
matrix AS (SELECT f.TransactionID, f.IsFraud, {base}, {codes} FROM feats f {joins})
"""
    )


def oracles() -> dict[str, str]:
    fx = _feature_exprs()
    o: dict[str, str] = {}
    o["card_fraud"] = _card_fraud()
    o["card_fraud_sql"] = _card_fraud()
    o["card_fraud_dirty"] = _card_fraud(DIRTY_CTE)
    o["mode_risk"] = (
        FIXTURE_CTE
        + """SELECT TransactionMode, COUNT(*) AS total_count, CAST(SUM(IsFraud) AS BIGINT) AS fraud_count,
       avg(Amount) AS avg_amount, ROUND(CAST(SUM(IsFraud) AS DOUBLE) * 100.0 / COUNT(*), 2) AS fraud_rate
FROM tx GROUP BY TransactionMode"""
    )
    o["mode_risk_sql"] = o["mode_risk"]
    o["count_risk"] = _value_counts("Risk")
    o["count_card"] = _value_counts("CardUsed")
    o["count_mode"] = _value_counts("TransactionMode")
    o["count_card_dirty"] = _value_counts("CardUsed", DIRTY_CTE)
    o["fraud_rate_by_card"] = (
        FIXTURE_CTE
        + f"""SELECT CardUsed, avg(CAST(IsFraud AS DOUBLE)) * 100.0 AS fraud_rate,
       {_rate_band('avg(CAST(IsFraud AS DOUBLE)) * 100.0')} AS band
FROM tx WHERE CardUsed IS NOT NULL GROUP BY CardUsed"""
    )
    o["fraud_rate_by_card_dirty"] = o["fraud_rate_by_card"].replace(FIXTURE_CTE, DIRTY_CTE)
    o["rate_band"] = (
        FIXTURE_CTE
        + f"""SELECT CardUsed, ROUND(CAST(SUM(IsFraud) AS DOUBLE) * 100.0 / COUNT(*), 2) AS fraud_rate,
       {_rate_band('ROUND(CAST(SUM(IsFraud) AS DOUBLE) * 100.0 / COUNT(*), 2)')} AS band
FROM tx GROUP BY CardUsed"""
    )
    o["dataset_summary"] = (
        FIXTURE_CTE
        + f"""SELECT COUNT(*) AS n_rows, CAST({len(FX.COLUMNS)} AS INTEGER) AS n_columns,
       CAST(COUNT(DISTINCT AccountID) + max(CASE WHEN AccountID IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_accounts,
       avg(CAST(IsFraud AS DOUBLE)) AS fraud_mean
FROM tx"""
    )
    o["kpis_labelled"] = (
        FIXTURE_CTE
        + """SELECT COUNT(*) AS total_transactions, CAST(coalesce(SUM(IsFraud), 0) AS BIGINT) AS fraud_count,
       CASE WHEN COUNT(*) > 0 THEN CAST(coalesce(SUM(IsFraud), 0) AS DOUBLE) * 100.0 / COUNT(*) ELSE 0.0 END
         AS fraud_rate,
       avg(Amount) AS avg_transaction,
       coalesce(sum(Amount) FILTER (WHERE IsFraud = 1), 0.0) AS high_risk_amount
FROM tx"""
    )
    o["kpis_risk"] = (
        FIXTURE_CTE
        + """SELECT COUNT(*) AS total_transactions, count(*) FILTER (WHERE Risk = 'HIGH') AS fraud_count,
       CASE WHEN COUNT(*) > 0 THEN CAST(count(*) FILTER (WHERE Risk = 'HIGH') AS DOUBLE) * 100.0 / COUNT(*)
            ELSE 0.0 END AS fraud_rate,
       avg(Amount) AS avg_transaction,
       CAST(coalesce(sum(Amount) FILTER (WHERE Risk = 'HIGH'), 0.0) AS DOUBLE) AS high_risk_amount
FROM tx"""
    )
    o["high_risk_amount"] = (
        FIXTURE_CTE
        + """SELECT count(*) FILTER (WHERE Risk = 'HIGH') AS high_risk_count,
       CAST(coalesce(sum(Amount) FILTER (WHERE Risk = 'HIGH'), 0.0) AS DOUBLE) AS high_risk_amount FROM tx"""
    )
    o["risk_share"] = (
        FIXTURE_CTE
        + """, c AS (SELECT Risk, COUNT(*) AS "count" FROM tx WHERE Risk IS NOT NULL GROUP BY Risk)
SELECT Risk, "count", round_even(CAST("count" AS DOUBLE) * 100.0 / (SELECT sum("count") FROM c), 1) AS share FROM c"""
    )
    # ---- features -----------------------------------------------------------
    o["feat_alias"] = (
        FIXTURE_CTE
        + """SELECT TransactionID, OldBalance AS oldbalanceOrg, NewBalance AS newbalanceOrig, Amount,
       OldBalance, NewBalance, Amount AS AmountTaken FROM tx"""
    )
    o["feat_fill"] = (
        DIRTY_CTE
        + """SELECT TransactionID, coalesce(OldBalance, 0) AS OldBalance, coalesce(NewBalance, 0) AS NewBalance,
       coalesce(Amount, 0) AS Amount, coalesce(AmountTaken, 0) AS AmountTaken FROM tx"""
    )
    for key, col in [
        ("feat_balance_ratio", "BalanceRatio"),
        ("feat_amount_ratio", "AmountToBalanceRatio"),
        ("feat_negative_balance", "IsNegativeBalance"),
        ("feat_large_txn", "LargeTransaction"),
        ("feat_round_amount", "SuspiciousAmount"),
        ("feat_merchant_risk", "IsHighRiskMerchant"),
    ]:
        o[key] = _with(DIRTY_CTE, _FILLED) + _features_select([col])
    o["feat_country_risk"] = _with(DIRTY_CTE, _FILLED) + _features_select(["CountryRiskScore"])
    o["feat_country_risk_join"] = o["feat_country_risk"]
    o["feat_time"] = _with(DIRTY_CTE, _FILLED) + (
        "SELECT TransactionID, "
        + ", ".join(f"{fx[n]} AS {n}" for n in ["Hour", "DayOfWeek", "IsNight", "IsWeekend"])
        + ' , "Timestamp" FROM filled'
    )
    o["features_all"] = _with(FIXTURE_CTE, _FILLED) + _features_select()
    o["features_all_dirty"] = _with(DIRTY_CTE, _FILLED) + _features_select()
    # ---- rules, labels, tiers ----------------------------------------------
    rules = _rules_sql()
    o["rule_flags"] = (
        DIRTY_CTE
        + "SELECT TransactionID, "
        + ", ".join(f"CAST(coalesce(({r}), false) AS INTEGER) AS {n}" for n, r in rules.items())
        + f", CAST({_any_rule_sql()} AS INTEGER) AS any_rule FROM tx"
    )
    hits = " || ".join(f"CASE WHEN coalesce(({r}), false) THEN '{n},' ELSE '' END" for n, r in rules.items())
    counts = " + ".join(f"CAST(coalesce(({r}), false) AS INTEGER)" for r in rules.values())
    o["rule_hit_counts"] = (
        DIRTY_CTE + f"SELECT TransactionID, rtrim({hits}, ',') AS rule_hits, CAST({counts} AS INTEGER) AS n_hits FROM tx"
    )
    o["label_from_rules"] = FIXTURE_CTE + "SELECT TransactionID, IsFraud FROM tx"
    o["risk_tier"] = DIRTY_CTE + "SELECT TransactionID, IsFraud, UserBehaviorScore, Risk FROM tx"
    o["risk_from_label"] = (
        DIRTY_CTE
        + "SELECT TransactionID, IsFraud, CASE WHEN IsFraud = 1 THEN 'HIGH' WHEN IsFraud = 0 THEN 'LOW' END AS Risk FROM tx"
    )
    o["risk_equal_width"] = (
        _with(DIRTY_CTE, _equal_width("OldBalance")) + "SELECT TransactionID, OldBalance, EqRisk AS Risk FROM binned"
    )
    o["risk_chain"] = (
        _with(DIRTY_CTE, _equal_width("OldBalance"))
        + """, lv AS (SELECT * FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(Risk))
SELECT lv.Risk, CAST(count(b.EqRisk) AS BIGINT) AS "count" FROM lv LEFT JOIN binned b ON b.EqRisk = lv.Risk
GROUP BY lv.Risk"""
    )
    o["format_ids"] = """SELECT event_id, printf('TXN%05d', event_id) AS TransactionID,
       printf('ACC%03d', user_id) AS AccountID, printf('Customer %d', user_id) AS AccountName FROM events"""
    o["format_timestamp"] = (
        FIXTURE_CTE + "SELECT TransactionID, strftime(\"Timestamp\", '%Y-%m-%d %H:%M:%S') AS TimestampText FROM tx"
    )
    # ---- filters ------------------------------------------------------------
    o["filter_account"] = FIXTURE_CTE + "SELECT * FROM tx WHERE AccountID = 'ACC007'"
    o["filter_high_risk"] = FIXTURE_CTE + "SELECT * FROM tx WHERE Risk = 'HIGH'"
    o["filter_fraud"] = FIXTURE_CTE + "SELECT * FROM tx WHERE IsFraud = 1"
    o["filter_isin"] = FIXTURE_CTE + f"SELECT * FROM tx WHERE Location IN {_in(S.RULE_COUNTRIES)}"
    # ---- accounts -----------------------------------------------------------
    o["account_summary_all"] = _first_row_rollup("t.AccountName, t.NewBalance")
    o["account_summary_top10"] = _first_row_rollup("t.AccountName, t.NewBalance", limit="ORDER BY first_no LIMIT 10")
    o["account_details"] = _first_row_rollup(
        "t.AccountName, t.OldBalance, t.NewBalance", where="WHERE AccountID = 'ACC007'"
    )
    o["first_txn_per_account"] = (
        FIXTURE_CTE + "SELECT t.* FROM tx t JOIN (SELECT min(txn_no) AS n FROM tx GROUP BY AccountID) f ON t.txn_no = f.n"
    )
    o["first_accounts"] = FIXTURE_CTE + "SELECT AccountID FROM tx GROUP BY AccountID ORDER BY min(txn_no) LIMIT 10"
    o["distinct_accounts"] = FIXTURE_CTE + "SELECT DISTINCT AccountID FROM tx"
    o["account_index"] = o["distinct_accounts"]
    o["account_lookup_many"] = (
        FIXTURE_CTE
        + """SELECT AccountID, count(*) AS n_rows, sum(Amount) AS amount, CAST(sum(IsFraud) AS BIGINT) AS fraud
FROM tx WHERE AccountID IN (SELECT AccountID FROM tx GROUP BY AccountID ORDER BY min(txn_no) LIMIT 10) GROUP BY AccountID"""
    )
    # ---- profile ------------------------------------------------------------
    o["numeric_profile"] = _numeric_profile(FIXTURE_CTE)
    o["numeric_profile_dirty"] = _numeric_profile(DIRTY_CTE)
    o["profile_long"] = _profile_long(FIXTURE_CTE)
    o["profile_long_no_risk"] = _profile_long(FIXTURE_CTE, with_risk=False)
    figures = """COUNT(*) AS n, CAST(SUM(IsFraud) AS BIGINT) AS fraud_count,
       ROUND(CAST(SUM(IsFraud) AS DOUBLE) * 100.0 / COUNT(*), 2) AS fraud_rate, avg(Amount) AS avg_amount,
       COUNT(IsFraud) AS labelled, avg(CAST(IsFraud AS DOUBLE)) * 100.0 AS fraud_share,
       coalesce(sum(Amount) FILTER (WHERE IsFraud = 1), 0.0) AS fraud_amount"""
    rollup = "\nUNION ALL\n".join(
        [
            f"SELECT 'CardUsed' AS dimension, CardUsed AS \"value\", {figures} FROM tx GROUP BY CardUsed",
            f"SELECT 'TransactionMode', TransactionMode, {figures} FROM tx GROUP BY TransactionMode",
            f"SELECT 'Risk', Risk, {figures} FROM tx GROUP BY Risk",
            f"SELECT 'ALL', NULL, {figures} FROM tx",
        ]
    )
    o["dashboard_rollup"] = FIXTURE_CTE + rollup
    o["dashboard_rollup_nan"] = DIRTY_CTE + rollup
    # ---- model data preparation --------------------------------------------
    o["label_encode"] = (
        _feature_matrix_cte(DIRTY_CTE)
        + "SELECT TransactionID, "
        + ", ".join(f"{c}_encoded" for c in S.CATEGORICAL_COLUMNS)
        + " FROM matrix"
    )
    o["feature_matrix"] = _feature_matrix_cte(FIXTURE_CTE) + "SELECT * EXCLUDE (IsFraud) FROM matrix"
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
        for c in _MATRIX_COLS
    )
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _MATRIX_COLS)
    o["standardize"] = (
        _feature_matrix_cte(FIXTURE_CTE) + f", st AS (SELECT {stats} FROM matrix)\nSELECT TransactionID, {scaled} FROM matrix, st"
    )
    o["class_weights"] = (
        FIXTURE_CTE
        + """, c AS (SELECT IsFraud, COUNT(*) AS n FROM tx GROUP BY IsFraud)
SELECT IsFraud, n AS "count",
       CAST((SELECT sum(n) FROM c) AS DOUBLE) / (CAST((SELECT count(*) FROM c) AS DOUBLE) * n) AS weight FROM c"""
    )
    # ---- sources ------------------------------------------------------------
    o["scan_transactions"] = FIXTURE_CTE + "SELECT * FROM tx"
    o["csv_round_trip"] = FIXTURE_CTE + "SELECT * FROM tx"
    o["load_or_materialize"] = FIXTURE_CTE + "SELECT * FROM tx"
    o["scan_csv_inferred"] = (
        FIXTURE_CTE
        + """SELECT TransactionID, strftime("Timestamp", '%Y-%m-%d %H:%M:%S') AS "Timestamp", AccountID, AccountName,
       OldBalance, NewBalance, Amount, CardUsed, TransactionMode, Location, MerchantCategory, DeviceType,
       UserBehaviorScore, TransactionStatus, AmountTaken, CAST(Hour AS BIGINT) AS Hour,
       CAST(IsFraud AS BIGINT) AS IsFraud, Risk, txn_no
FROM tx"""
    )
    o["stream_features"] = o["features_all"]
    o["feature_matrix_nan"] = _feature_matrix_cte(DIRTY_CTE) + "SELECT * EXCLUDE (IsFraud) FROM matrix"
    o["count_card_nan"] = _value_counts("CardUsed", DIRTY_CTE)
    o["count_score_nan"] = _value_counts("UserBehaviorScore", DIRTY_CTE)
    o["card_fraud_sql_nan"] = o["card_fraud_dirty"]
    o["mode_risk_sql_nan"] = DIRTY_CTE + o["mode_risk"][len(FIXTURE_CTE) :]
    o["feat_time_text"] = f'SELECT TransactionID, "Hour", DayOfWeek, IsNight, IsWeekend FROM ({o["feat_time"]}) t'
    o["feat_time_layout"] = f"""WITH f AS (SELECT *, CAST(substr(TransactionID, 4) AS BIGINT) % 7 AS layout,
  CAST(substr(TransactionID, 4) AS BIGINT) AS n FROM ({o["feat_time"]}) t),
g AS (SELECT *, "Timestamp" IS NOT NULL AND layout = (SELECT arg_min(layout, n) FROM f WHERE "Timestamp" IS NOT NULL) AS good FROM f)
SELECT TransactionID, CASE WHEN good THEN "Hour" ELSE 12 END AS "Hour", CASE WHEN good THEN DayOfWeek ELSE 0 END AS DayOfWeek,
  CASE WHEN good THEN IsNight ELSE 0 END AS IsNight, CASE WHEN good THEN IsWeekend ELSE 0 END AS IsWeekend FROM g"""
    o["profile_incremental"] = o["profile_long"]
    o["numeric_profile_incremental"] = o["numeric_profile"]
    o["dataset_summary_sketch"] = (
        FIXTURE_CTE
        + """SELECT COUNT(*) AS n_rows, 19 AS n_columns, TRUE AS accounts_near, avg(CAST(IsFraud AS DOUBLE)) AS fraud_mean FROM tx"""
    )
    o["first_accounts_by_files"] = o["first_accounts"]
    o["published_table"] = o["load_or_materialize"]
    o["stream_accounts"] = o["account_summary_all"]
    o["label_ranks"] = (
        FIXTURE_CTE
        + """SELECT 'TXN-' || TransactionID AS "value", CAST(row_number() OVER (ORDER BY TransactionID) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT TransactionID FROM tx) t"""
    )
    o["scan_csv_quoted"] = "SELECT page_id, url, html FROM pages"
    o["scan_csv_reordered"] = o["csv_round_trip"]
    scored = _stump_scores()
    o["train_stump"] = scored + """SELECT prediction, Probability, count(*) AS n_rows, CAST(sum(IsFraud) AS BIGINT) AS n_fraud
FROM scored GROUP BY prediction, Probability"""
    o["score_stump"] = scored + "SELECT TransactionID, prediction, Probability FROM scored"
    o["stump_accuracy"] = scored + "SELECT round(avg(CASE WHEN prediction = IsFraud THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM scored"
    for key, column, k in (("top_accounts", "AccountID", 20), ("top_ids", "TransactionID", 5)):
        o[key] = FIXTURE_CTE + f"""SELECT {column}, count(*) AS "count" FROM tx WHERE {column} IS NOT NULL
GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT {k}"""
    o["model_round_trip"] = FIXTURE_CTE + "SELECT count(*) AS n_rows, count(*) AS n_same FROM tx"
    o["profile_report"] = o["profile_long"]
    o["accounts_json"] = (
        "WITH acc AS ("
        + _first_row_rollup("t.AccountName, t.NewBalance", limit="ORDER BY first_no LIMIT 10").rstrip()
        + """)
SELECT CAST(to_json(struct_pack(AccountID := AccountID, AccountName := AccountName, NewBalance := NewBalance,
       TransactionCount := TransactionCount, FraudCount := FraudCount, RiskLevel := RiskLevel)) AS VARCHAR) AS json
FROM acc"""
    )
    upload = _with(FIXTURE_CTE, _equal_width("Amount"))
    o["upload_risk_counts"] = (
        upload
        + """, lv AS (SELECT * FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(Risk))
SELECT lv.Risk, CAST(count(b.EqRisk) AS BIGINT) AS "count" FROM lv LEFT JOIN binned b ON b.EqRisk = lv.Risk
GROUP BY lv.Risk"""
    )
    o["upload_kpis"] = (
        upload
        + """SELECT COUNT(*) AS total_transactions, count(*) FILTER (WHERE EqRisk = 'HIGH') AS fraud_count,
       CAST(count(*) FILTER (WHERE EqRisk = 'HIGH') AS DOUBLE) * 100.0 / COUNT(*) AS fraud_rate,
       avg(Amount) AS avg_transaction,
       CAST(coalesce(sum(Amount) FILTER (WHERE EqRisk = 'HIGH'), 0.0) AS DOUBLE) AS high_risk_amount
FROM binned"""
    )
    return o
