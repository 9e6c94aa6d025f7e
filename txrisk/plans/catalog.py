"""The query catalog: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables through the ``transactions`` fixture
(events joined with customer) or data Spark derives from them, over the
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk import schema as S
from txrisk.functions.columns import fit_row, format_account_id, format_customer_name, format_timestamp, format_txn_id, rate_band
from txrisk.operators import accounts, analytics, features, model, profile, rules
from txrisk.operators.time_layout import parse_time_column
from txrisk.plans.dashboard import dashboard_rollup
from txrisk.session import fresh_path
from txrisk.sources import io, publish
from txrisk.sources.account_index import AccountIndex, build_account_index
from txrisk.sources.fixture import read_table, transactions
from txrisk.sources.ledger import FileLedger
from txrisk.streaming.account_stream import run_account_stream
from txrisk.streaming.features_stream import run_feature_stream

Query = Callable[[SparkSession, str], DataFrame]

ACCOUNT = "ACC007"


def _tx(spark, sf):
    return transactions(spark, sf)


def _dirty(spark, sf):
    return transactions(spark, sf, dirty=True)


def _only(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("TransactionID", *cols)


def _alias_input(spark, sf):
    """The fixture under the alternative column names of P01."""
    tx = _tx(spark, sf)
    return tx.select(
        "TransactionID",
        F.col("OldBalance").alias("oldbalanceOrg"),
        F.col("NewBalance").alias("newbalanceOrig"),
        "Amount",
    )


def _country_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(S.COUNTRY_RISK.items()), "Location string, score double")


def _scan_csv(spark, sf):
    tx = _tx(spark, sf)
    path = io.write_transactions(tx, fresh_path(spark, "transactions-csv"), "csv")
    return io.read_transactions(spark, path, "csv", schema=tx.schema)


def _scan_parquet(spark, sf):
    tx = _tx(spark, sf)
    path = io.write_transactions(tx, fresh_path(spark, "transactions-parquet"), "parquet")
    return io.read_transactions(spark, path, "parquet")


def _scan_inferred(spark, sf):
    tx = _tx(spark, sf).withColumn("Timestamp", format_timestamp(F.col("Timestamp")))
    path = io.write_transactions(tx, fresh_path(spark, "upload") + ".csv", "csv")
    return io.read_csv_inferred(spark, path)


UPLOAD_COLUMNS = ["TransactionID", "Amount", "OldBalance", "CardUsed", "TransactionMode"]


def _upload(spark, sf):
    """An uploaded CSV without Risk or IsFraud: the reference's upload path.

    Written as CSV from the whole fixture and read back with inferred types;
    its first numeric column is Amount.
    """
    tx = _tx(spark, sf).select(*UPLOAD_COLUMNS)
    path = io.write_transactions(tx, fresh_path(spark, "upload") + ".csv", "csv")
    return io.read_csv_inferred(spark, path)


def _load_or_materialize(spark, sf):
    path = fresh_path(spark, "materialized")
    return io.load_or_materialize(spark, path, lambda: _tx(spark, sf))


# The model queries share one forest: it is trained once for a session and the
# files that its tables have at that moment.
_MODELS: dict[tuple, object] = {}


def _trained(spark, sf):
    key = _listing(spark, sf)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = model.train_model(_tx(spark, sf))
    return _MODELS[key]


def _train_model(spark, sf):
    """Every row's class and percentage by the forest."""
    return model.score_transactions(_trained(spark, sf), _tx(spark, sf)).select("TransactionID", "prediction", "Probability")


def _train_accuracy(spark, sf):
    return model.train_accuracy(_trained(spark, sf), _tx(spark, sf))


# A forest of one tree with one split, over the features of few values, is what SQL can find, too.
STUMP_COLUMNS = [
    "IsNegativeBalance", "CountryRiskScore", "IsNight", "IsWeekend", "LargeTransaction", "SuspiciousAmount", "IsHighRiskMerchant",
    *[f"{c}_encoded" for c in S.CATEGORICAL_COLUMNS],
]
_STUMPS: dict[tuple, object] = {}


def _stump(spark, sf):
    key = _listing(spark, sf)
    if key not in _STUMPS:
        _STUMPS.clear()
        _STUMPS[key] = model.train_model(_tx(spark, sf), trees=1, depth=1, columns=STUMP_COLUMNS, bootstrap=False)
    return _STUMPS[key]


def _train_stump(spark, sf):
    """The leaves of the one split: their class, percentage, rows and fraud."""
    scored = model.score_transactions(_stump(spark, sf), _tx(spark, sf)).withColumn("Probability", F.round("Probability", 6))
    return scored.groupBy("prediction", "Probability").agg(F.count("*").alias("n_rows"), F.sum("IsFraud").alias("n_fraud"))


def _score_stump(spark, sf):
    scored = model.score_transactions(_stump(spark, sf), _tx(spark, sf))
    return scored.select("TransactionID", "prediction", F.round("Probability", 6).alias("Probability"))


def _stump_accuracy(spark, sf):
    return model.train_accuracy(_stump(spark, sf), _tx(spark, sf)).select(F.round("accuracy", 9).alias("accuracy"))


def _model_round_trip(spark, sf):
    """The stored and loaded model scores every row as the trained one does."""
    tx = _tx(spark, sf)
    trained = _trained(spark, sf)
    loaded = model.load_or_train(tx, model.save_model(trained, fresh_path(spark, "model")))
    a, b = (model.score_transactions(m, tx) for m in (trained, loaded))
    b = b.select("TransactionID", F.struct("prediction", "Probability").alias("other"))
    both = a.join(b, "TransactionID", "full")
    same = F.struct("prediction", "Probability") == F.col("other")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(same, F.lit(False))).alias("n_same"))


def _score_transactions(spark, sf):
    return model.score_transactions(_trained(spark, sf), _tx(spark, sf))


def _profile_report(spark, sf):
    """The nested report, read back as rows."""
    report = profile.profile_report(_tx(spark, sf))
    entries = [
        F.array(
            F.struct(F.lit(s).alias("section"), F.lit(None).cast("string").alias("key"), F.col(s).cast("double").alias("value"))
        )
        for s in ("total_transactions", "high_risk_count", "high_risk_amount")
    ]
    for s in ("risk_distribution", "card_usage", "transaction_modes"):
        entries.append(F.expr(f"transform(map_entries({s}), e -> struct('{s}' AS section, e.key AS key, double(e.value) AS value))"))
    for k in ("mean", "std", "min", "max"):
        entries.append(F.expr(f"transform(map_entries(summary_stats), e -> struct('{k}' AS section, e.key AS key, e.value.{k} AS value))"))
    rows = report.select(F.inline(F.concat(*entries)))
    rounded = F.when(F.col("section").isin("mean", "std", "high_risk_amount"), F.round("value", 6)).otherwise(F.col("value"))
    return rows.select("section", "key", rounded.alias("value"))


def _nan(spark, sf):
    """The gapped table with NaN instead of NULL in its numbers, the label among them."""
    df = _dirty(spark, sf).withColumn("IsFraud", F.col("IsFraud").cast("double"))
    numbers = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in numbers})


TIME_LAYOUTS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd h:mm a", "dd-MMM-yyyy HH:mm", "yyyyMMdd HH:mm:ss", "MMM d, yyyy HH:mm", "M/d/yyyy H:mm", "yyyy/MM/dd HH:mm",
]


def _many_layouts(spark, sf):
    """The gapped table with its timestamps as text in many layouts."""
    text = F.element_at(F.array(*[F.date_format("Timestamp", x) for x in TIME_LAYOUTS]), (F.col("txn_no") % len(TIME_LAYOUTS) + 1).cast("int"))
    return _dirty(spark, sf).withColumn("Timestamp", text)


def _time_text(spark, sf):
    """Every row read by its own layout."""
    return _only(features.add_time_features(_many_layouts(spark, sf)), "Hour", "DayOfWeek", "IsNight", "IsWeekend")


def _time_layout(spark, sf):
    """All rows read by the layout of the first; the others are missing."""
    return _only(features.add_time_features(parse_time_column(_many_layouts(spark, sf))), "Hour", "DayOfWeek", "IsNight", "IsWeekend")


def _scan_quoted(spark, sf):
    """Texts with quotes, commas and line breaks through CSV and back."""
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return io.read_csv_inferred(spark, io.write_transactions(pages, fresh_path(spark, "pages") + ".csv", "csv"))


def _scan_reordered(spark, sf):
    """A stored CSV whose columns stand in another order."""
    tx = _tx(spark, sf)
    path = io.write_transactions(tx.select(*reversed(tx.columns)), fresh_path(spark, "transactions-reordered"), "csv")
    return io.read_transactions(spark, path, "csv", schema=tx.schema)


# The account index is written once for a session and the files that its tables have at that moment.
_INDEXES: dict[tuple, AccountIndex] = {}


def _listing(spark, sf) -> tuple:
    files = [f for t in ("events", "customer") for f in read_table(spark, sf, t).inputFiles()]
    return (spark.sparkContext.applicationId, tuple(sorted(files)))


def _account_index(spark, sf) -> AccountIndex:
    key = _listing(spark, sf)
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = build_account_index(_tx(spark, sf), fresh_path(spark, "account-index"))
    return _INDEXES[key]


def _account_lookup(spark, sf):
    """The rows of the first accounts on the page, all found through the index."""
    index = _account_index(spark, sf)
    first = [r["AccountID"] for r in analytics.first_accounts(_tx(spark, sf)).collect()]
    return index.rows_of(*first).groupBy("AccountID").agg(F.count("*").alias("n_rows"), F.sum("Amount").alias("amount"), F.sum("IsFraud").alias("fraud"))


def _grown_ledger(spark, sf) -> FileLedger:
    """The table written in two parts, with a ledger that reads each part once."""
    tx, folder = _tx(spark, sf), fresh_path(spark, "growing")
    ledger = FileLedger(spark, folder, folder + "-ledger")
    for part in (0, 1):
        io.write_transactions(tx.where(F.col("txn_no") % 2 == part), folder, mode="append")
        ledger.extend()
    return ledger


def _sketched_summary(spark, sf):
    """The ledger's summary, with how far its estimate of the accounts is from the exact count."""
    exact = fit_row(_tx(spark, sf), F.countDistinct("AccountID"))[0]
    near = F.abs(F.col("n_accounts") - F.lit(exact)) <= F.lit(0.04 * exact + 1)
    return _grown_ledger(spark, sf).dataset_summary().select("n_rows", "n_columns", near.alias("accounts_near"), "fraud_mean")


def _first_accounts_by_files(spark, sf):
    """The first accounts of the table stored in its order: from its first files."""
    folder = fresh_path(spark, "by-order")
    _tx(spark, sf).repartitionByRange(8, "txn_no").write.parquet(folder)
    ledger = FileLedger(spark, folder, folder + "-ledger")
    ledger.extend()
    return ledger.first_accounts()[0]


def _published_table(spark, sf):
    """The current version of a table after a second version was published."""
    path = fresh_path(spark, "published")
    publish.open_or_build_table(spark, path, lambda: _tx(spark, sf).where("IsFraud = 1"))
    publish.publish_table(_tx(spark, sf), path)
    return publish.open_or_build_table(spark, path, lambda: _tx(spark, sf).limit(0))


def _label_ranks(spark, sf):
    """Codes of a column with as many values as rows, all with one beginning: ranked in ranges."""
    ids = _tx(spark, sf).select(F.concat(F.lit("TXN-"), F.col("TransactionID")).alias("value")).distinct()
    return model.distinct_ranks(ids, "value", "code", parts=16)


def _standardize(spark, sf):
    matrix = model.feature_matrix(_tx(spark, sf))
    cols = [c for c in matrix.columns if c != "TransactionID"]
    return model.standardize(matrix, cols, digits=6)


def _format_ids(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id",
        format_txn_id(F.col("event_id")).alias("TransactionID"),
        format_account_id(F.col("user_id")).alias("AccountID"),
        format_customer_name(F.col("user_id")).alias("AccountName"),
    )


def _rate_band(spark, sf):
    return analytics.card_fraud(_tx(spark, sf)).select("CardUsed", "fraud_rate", rate_band(F.col("fraud_rate")).alias("band"))


def _rule_hits(spark, sf):
    hits = rules.rule_hits(_dirty(spark, sf))
    return hits.select("TransactionID", F.array_join("rule_hits", ",").alias("rule_hits"), "n_hits")


def _feat(builder, *cols):
    """A single-feature query over the gapped table (exercises the missing-value rules)."""

    def run(spark, sf):
        return _only(builder(_dirty(spark, sf)), *cols)

    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        # ---- aggregates (A01-A08, A11, A12, P24, P29) ------------------------
        "card_fraud": lambda s, sf: analytics.card_fraud(_tx(s, sf)),
        "card_fraud_sql": lambda s, sf: analytics.card_fraud_sql(_tx(s, sf)),
        "card_fraud_dirty": lambda s, sf: analytics.card_fraud(_dirty(s, sf)),
        "mode_risk": lambda s, sf: analytics.mode_risk(_tx(s, sf)),
        "mode_risk_sql": lambda s, sf: analytics.mode_risk_sql(_tx(s, sf)),
        "count_risk": lambda s, sf: analytics.risk_counts(_tx(s, sf)),
        "count_card": lambda s, sf: analytics.value_counts(_tx(s, sf), "CardUsed"),
        "count_mode": lambda s, sf: analytics.value_counts(_tx(s, sf), "TransactionMode"),
        "count_card_dirty": lambda s, sf: analytics.value_counts(_dirty(s, sf), "CardUsed"),
        "fraud_rate_by_card": lambda s, sf: analytics.fraud_rate_by_card(_tx(s, sf)),
        "fraud_rate_by_card_dirty": lambda s, sf: analytics.fraud_rate_by_card(_dirty(s, sf)),
        "rate_band": _rate_band,
        "dataset_summary": lambda s, sf: analytics.dataset_summary(_tx(s, sf)),
        "kpis_labelled": lambda s, sf: analytics.kpis_labelled(_tx(s, sf)),
        "kpis_risk": lambda s, sf: analytics.kpis_risk(rules.derive_risk(_tx(s, sf))),
        "high_risk_amount": lambda s, sf: analytics.high_risk_amount(_tx(s, sf)),
        "risk_share": lambda s, sf: analytics.risk_share(_tx(s, sf)),
        "dashboard_rollup": lambda s, sf: dashboard_rollup(_tx(s, sf)),
        # ---- features (P01-P15) --------------------------------------------
        "feat_alias": lambda s, sf: features.add_aliases(_alias_input(s, sf)),
        "feat_fill": lambda s, sf: _only(
            features.fill_numeric(_dirty(s, sf)), "OldBalance", "NewBalance", "Amount", "AmountTaken"
        ),
        "feat_balance_ratio": _feat(features.add_balance_ratio, "BalanceRatio"),
        "feat_amount_ratio": _feat(features.add_amount_ratio, "AmountToBalanceRatio"),
        "feat_negative_balance": _feat(features.add_negative_balance, "IsNegativeBalance"),
        "feat_country_risk": _feat(features.add_country_risk, "CountryRiskScore"),
        "feat_country_risk_join": lambda s, sf: _only(
            features.add_country_risk_join(_dirty(s, sf), _country_table(s)), "CountryRiskScore"
        ),
        "feat_merchant_risk": _feat(features.add_merchant_risk, "IsHighRiskMerchant"),
        "feat_time": _feat(features.add_time_features, "Hour", "DayOfWeek", "IsNight", "IsWeekend", "Timestamp"),
        "feat_large_txn": _feat(features.add_large_txn, "LargeTransaction"),
        "feat_round_amount": _feat(features.add_round_amount, "SuspiciousAmount"),
        "features_all": lambda s, sf: features.create_features(_tx(s, sf)),
        "features_all_dirty": lambda s, sf: features.create_features(_dirty(s, sf)),
        # ---- rules, labels, tiers (P16-P24) ----------------------------------
        "rule_flags": lambda s, sf: _only(rules.rule_flags(_dirty(s, sf)), *S.RULE_NAMES, "any_rule"),
        "rule_hit_counts": _rule_hits,
        "label_from_rules": lambda s, sf: _only(rules.label_from_rules(_tx(s, sf).drop("IsFraud")), "IsFraud"),
        "risk_tier": lambda s, sf: _only(
            rules.risk_tier(_dirty(s, sf).drop("Risk")), "IsFraud", "UserBehaviorScore", "Risk"
        ),
        "risk_from_label": lambda s, sf: _only(rules.risk_from_label(_dirty(s, sf).drop("Risk")), "IsFraud", "Risk"),
        "risk_equal_width": lambda s, sf: _only(
            rules.risk_equal_width(_dirty(s, sf).drop("Risk", "IsFraud")), "OldBalance", "Risk"
        ),
        "risk_chain": lambda s, sf: analytics.risk_counts(_dirty(s, sf).drop("Risk", "IsFraud")),
        "format_ids": _format_ids,
        "format_timestamp": lambda s, sf: _tx(s, sf).select(
            "TransactionID", format_timestamp(F.col("Timestamp")).alias("TimestampText")
        ),
        # ---- filters (F01-F04) ------------------------------------------------
        "filter_account": lambda s, sf: _account_index(s, sf).rows_of(ACCOUNT),
        "filter_high_risk": lambda s, sf: analytics.filter_high_risk(_tx(s, sf)),
        "filter_fraud": lambda s, sf: analytics.filter_fraud(_tx(s, sf)),
        "filter_isin": lambda s, sf: analytics.filter_isin(_tx(s, sf), "Location", S.RULE_COUNTRIES),
        # ---- accounts (A09, A10, W01, W04, W05) -----------------------------
        "account_summary_top10": lambda s, sf: accounts.account_summary(_tx(s, sf)),
        "account_summary_all": lambda s, sf: accounts.account_summary(_tx(s, sf), limit=None),
        "account_details": lambda s, sf: accounts.account_details(_account_index(s, sf).rows_of(ACCOUNT), ACCOUNT),
        "account_lookup_many": _account_lookup,
        "account_index": lambda s, sf: analytics.distinct_accounts(s.read.parquet(f"{_account_index(s, sf).path}/rows")),
        "first_txn_per_account": lambda s, sf: accounts.first_txn_per_account(_tx(s, sf)),
        "first_accounts": lambda s, sf: analytics.first_accounts(_tx(s, sf)),
        "distinct_accounts": lambda s, sf: analytics.distinct_accounts(_tx(s, sf)),
        # ---- profile (A05, A13) -----------------------------------------------
        "numeric_profile": lambda s, sf: profile.numeric_profile(_tx(s, sf), digits=4),
        "numeric_profile_dirty": lambda s, sf: profile.numeric_profile(_dirty(s, sf), digits=4),
        "profile_long": lambda s, sf: profile.profile_long(_tx(s, sf)),
        "profile_long_no_risk": lambda s, sf: profile.profile_long(_tx(s, sf).drop("Risk")),
        "profile_report": _profile_report,
        # ---- model (M01-M05, A14, A15, X01) -----------------------------------
        "label_encode": lambda s, sf: _only(
            model.label_encode(_dirty(s, sf)), *[f"{c}_encoded" for c in S.CATEGORICAL_COLUMNS]
        ),
        "feature_matrix": lambda s, sf: model.feature_matrix(_tx(s, sf)),
        "standardize": _standardize,
        "class_weights": lambda s, sf: model.class_weights(_tx(s, sf)),
        "train_model": _train_model,
        "train_accuracy": _train_accuracy,
        "model_round_trip": _model_round_trip,
        "score_transactions": _score_transactions,
        "train_stump": _train_stump,
        "score_stump": _score_stump,
        "stump_accuracy": _stump_accuracy,
        "top_accounts": lambda s, sf: profile.top_values(_tx(s, sf), "AccountID", 20),
        "top_ids": lambda s, sf: profile.top_values(_tx(s, sf), "TransactionID", 5),
        # ---- sources and sinks (S01, S02, S04, S05, S09) ------------------------
        "scan_transactions": _scan_parquet,
        "csv_round_trip": _scan_csv,
        "scan_csv_inferred": _scan_inferred,
        "load_or_materialize": _load_or_materialize,
        "accounts_json": lambda s, sf: io.as_json(accounts.account_summary(_tx(s, sf))),
        # ---- the upload path: S02 -> P21 (equal width) -> A03 / A08 ----------------
        "upload_risk_counts": lambda s, sf: analytics.risk_counts(_upload(s, sf)),
        "upload_kpis": lambda s, sf: analytics.kpis_risk(rules.derive_risk(_upload(s, sf))),
        # ---- streaming (X02) ----------------------------------------------------
        "stream_features": lambda s, sf: run_feature_stream(s, sf),
        # ---- NaN, text dates and CSV forms -----------------------------------------
        "feature_matrix_nan": lambda s, sf: model.feature_matrix(_nan(s, sf)),
        "count_card_nan": lambda s, sf: analytics.value_counts(_nan(s, sf), "CardUsed"),
        "count_score_nan": lambda s, sf: analytics.value_counts(_nan(s, sf), "UserBehaviorScore"),
        "dashboard_rollup_nan": lambda s, sf: dashboard_rollup(_nan(s, sf)),
        "card_fraud_sql_nan": lambda s, sf: analytics.card_fraud_sql(_nan(s, sf)),
        "mode_risk_sql_nan": lambda s, sf: analytics.mode_risk_sql(_nan(s, sf)),
        "feat_time_text": _time_text,
        "feat_time_layout": _time_layout,
        "label_ranks": _label_ranks,
        # ---- figures kept by file, published versions, accounts on a stream -----------
        "profile_incremental": lambda s, sf: _grown_ledger(s, sf).profile_long(),
        "numeric_profile_incremental": lambda s, sf: _grown_ledger(s, sf).numeric_profile(digits=4),
        "dataset_summary_sketch": _sketched_summary,
        "first_accounts_by_files": _first_accounts_by_files,
        "published_table": _published_table,
        "stream_accounts": lambda s, sf: run_account_stream(s, sf),
        "scan_csv_quoted": _scan_quoted,
        "scan_csv_reordered": _scan_reordered,
    }
    return q
