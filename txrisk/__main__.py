"""Command line: the numbers the reference's pages and API show, as JSON.

    python -m txrisk dashboard --sf /root/testdata/sf0.01 [--upload data.csv]
    python -m txrisk dashboard --table transactions.parquet
    python -m txrisk accounts  --sf DIR            # /api/accounts (first 10)
    python -m txrisk account ACC007 --sf DIR       # /api/accounts/<id>
    python -m txrisk upload data.csv               # /api/upload-csv analysis
    python -m txrisk train --sf DIR --model PATH   # load the model, or train and store it
    python -m txrisk init --sf DIR --table PATH --model PATH   # start-up: table + summary + model

Everything is computed by Spark; only the aggregated results are brought to the
driver for printing, all their rows (``--limit N``: the first N accounts).
"""

from __future__ import annotations

import argparse
import json
import sys

from txrisk.operators import accounts, analytics, model, profile
from txrisk.plans.dashboard import dashboard, page_records
from txrisk.session import build_session
from txrisk.sources import io
from txrisk.sources.fixture import transactions


def _base(spark, args):
    if args.table:
        return io.read_transactions(spark, args.table, io.table_format(args.table))
    return transactions(spark, args.sf)


def _print(obj) -> None:
    json.dump(obj, sys.stdout, indent=2, default=str)
    sys.stdout.write("\n")


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="txrisk")
    parser.add_argument("command", choices=["dashboard", "accounts", "account", "upload", "train", "init"])
    parser.add_argument("arg", nargs="?", help="account id (account) or CSV path (upload)")
    parser.add_argument("--sf", default="/root/testdata/sf0.01", help="folder with events/customer parquet")
    parser.add_argument("--table", help="a stored transaction table (.parquet folder or .csv)")
    parser.add_argument("--upload", help="an uploaded CSV shown instead of the base table")
    parser.add_argument("--model", help="model folder (train)")
    parser.add_argument("--trees", type=int, default=200)
    parser.add_argument("--limit", type=int, default=10, help="accounts to list (0: all)")
    parser.add_argument("--master", default=None)
    args = parser.parse_args(argv)

    spark = build_session(args.master, app="txrisk-cli")
    if args.command == "dashboard":
        if args.upload:
            page = dashboard(_base(spark, args), io.read_csv_inferred(spark, args.upload))
            _print({name: io.to_records(df) for name, df in page.items()})
        else:
            # base table: every figure from one roll-up scan plus the accounts scan
            _print(page_records(_base(spark, args), args.limit or None))
    elif args.command == "accounts":
        _print({"accounts": io.to_records(accounts.account_summary(_base(spark, args), args.limit or None))})
    elif args.command == "account":
        rows = io.to_records(accounts.account_details(_base(spark, args), args.arg), 1)
        _print({"account": rows[0]} if rows else {"error": "Account not found"})
        return 0 if rows else 1
    elif args.command == "upload":
        try:
            df = io.read_csv_inferred(spark, args.arg)
        except io.UploadError as exc:
            _print({"success": False, "error": str(exc)})
            return 2
        report = io.as_json(profile.profile_report(df)).first()["json"]  # keeps column and count order
        _print({"success": True, "analysis": json.loads(report)})
    elif args.command == "init":
        if not (args.table and args.model):
            parser.error("init needs --table PATH and --model PATH")
        base = transactions(spark, args.sf)
        table = io.load_or_materialize(spark, args.table, lambda: base, io.table_format(args.table), base.schema)
        summary = io.to_records(analytics.dataset_summary(table), 1)[0]
        fitted = model.load_or_train(table, args.model, trees=args.trees)
        _print({"table": args.table, "summary": summary, "model": args.model, "loaded": fitted is not None})
    elif args.command == "train":
        if not args.model:
            parser.error("train needs --model PATH")
        base = _base(spark, args)
        fitted = model.load_or_train(base, args.model, trees=args.trees)
        _print({"model": args.model, "accuracy": model.train_accuracy(fitted, base).first()["accuracy"]})
    return 0


if __name__ == "__main__":
    sys.exit(main())
