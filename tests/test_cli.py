"""The command line gives the page / API numbers as JSON."""

from __future__ import annotations

import json

from places import SF001

from txrisk.__main__ import main


def run(capsys, *argv):
    code = main(list(argv))
    return code, json.loads(capsys.readouterr().out)


def test_account_and_missing(spark, capsys):
    code, out = run(capsys, "account", "ACC007", "--sf", SF001)
    assert code == 0 and out["account"]["AccountID"] == "ACC007"
    code, out = run(capsys, "account", "NOPE", "--sf", SF001)
    assert code == 1 and out == {"error": "Account not found"}


def test_dashboard_figures(spark, capsys):
    code, out = run(capsys, "dashboard", "--sf", SF001)
    assert code == 0
    assert len(out["accounts"]) == 10
    assert {r["CardUsed"] for r in out["card_fraud"]} == {r["CardUsed"] for r in out["card_usage"]}
    assert out["kpis"][0]["total_transactions"] == 1000


def test_upload_rejected(spark, capsys):
    code, out = run(capsys, "upload", "x.txt")
    assert code == 2 and out == {"success": False, "error": "Please upload a CSV file"}


def test_init_materializes_then_reuses(spark, capsys, tmp_out):
    table, path = tmp_out("cli-table"), tmp_out("cli-model")
    code, out = run(capsys, "init", "--sf", SF001, "--table", table, "--model", path, "--trees", "3")
    assert code == 0 and out["summary"]["n_rows"] == 1000
    code, again = run(capsys, "init", "--sf", SF001, "--table", table, "--model", path, "--trees", "3")
    assert again["summary"] == out["summary"]
