"""Property tests: random rows, Spark result == a plain-Python restatement of the rules."""

from __future__ import annotations

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from txrisk import schema as S
from txrisk.operators import features as FE
from txrisk.operators import rules as R

SCHEMA = (
    "i int, OldBalance double, NewBalance double, Amount double, Location string, MerchantCategory string, "
    "Timestamp string, CardUsed string, TransactionMode string, DeviceType string, UserBehaviorScore double"
)

money = st.one_of(st.none(), st.integers(-2000, 60000).map(float), st.just(-1.0), st.just(0.0))
text = lambda values: st.one_of(st.none(), st.sampled_from(values))
stamp = st.one_of(
    st.none(),
    st.just("garbage"),
    st.datetimes(min_value=dt.datetime(2020, 1, 1), max_value=dt.datetime(2030, 1, 1)).map(
        lambda d: d.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")
    ),
)
row = st.tuples(
    money,
    money,
    money,
    text(["Russia", "Nigeria", "China", "Ukraine", "Vietnam", "North Korea", "russia", "Texas", "UK"]),
    text(["Casino", "Digital Goods", "Cryptocurrency", "Adult", "Gambling", "Retail", "ATM"]),
    stamp,
    text(["Credit Card", "Debit Card", "Virtual Card"]),
    text(["ATM Withdrawal", "Online Transfer", "POS Swipe"]),
    text(["ATM", "POS Terminal", "Mobile"]),
    st.one_of(st.none(), st.floats(0.1, 0.99)),
)


def expected_features(old, new, amt, loc, merch, ts):
    old, new, amt = (0.0 if v is None else v for v in (old, new, amt))
    parsed = None
    if ts is not None:
        try:
            parsed = dt.datetime.strptime(ts, "%Y-%m-%d %H:%M:%S")
        except ValueError:
            parsed = None
    hour = parsed.hour if parsed else 12
    day = parsed.weekday() if parsed else 0
    return (
        None if old + 1 == 0 else new / (old + 1),
        None if old + 1 == 0 else amt / (old + 1),
        int(new < 0 and old > 0),
        S.COUNTRY_RISK.get(loc, 0.1),
        int(merch in S.HIGH_RISK_MERCHANTS),
        hour,
        day,
        int(hour < 6 or hour >= 22),
        int(day >= 5),
        int(amt > old * 0.5),
        int(amt % 100 == 0),
    )


def expected_any_rule(old, new, amt, loc, card, mode, dev, score, hour):
    def gt(a, b):
        return a is not None and b is not None and a > b

    return int(
        loc in ("Russia", "Nigeria", "China")
        or card == "Virtual Card"
        or mode == "Online Transfer"
        or (amt is not None and old is not None and amt > old * 0.7)
        or gt(-500.0, new)
        or dev in ("ATM", "POS Terminal")
        or gt(0.3, score)
        or (card == "Credit Card" and gt(amt, 3000.0))
        or (mode == "ATM Withdrawal" and hour is not None and hour < 6)
    )


FEATURES = [
    "BalanceRatio",
    "AmountToBalanceRatio",
    "IsNegativeBalance",
    "CountryRiskScore",
    "IsHighRiskMerchant",
    "Hour",
    "DayOfWeek",
    "IsNight",
    "IsWeekend",
    "LargeTransaction",
    "SuspiciousAmount",
]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=60))
def test_features_and_rules_match_python(spark, rows):
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    feats = FE.create_features(df).orderBy("i").collect()
    flags = R.rule_flags(df.withColumn("Hour", FE.time_exprs(df)["Hour"])).orderBy("i").collect()
    for (i, old, new, amt, loc, merch, ts, card, mode, dev, score), f, g in zip(data, feats, flags):
        got = tuple(f[c] for c in FEATURES)
        want = expected_features(old, new, amt, loc, merch, ts)
        assert got == want, (i, got, want)
        hour = f["Hour"]
        assert g["any_rule"] == expected_any_rule(old, new, amt, loc, card, mode, dev, score, hour), i
