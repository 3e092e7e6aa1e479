"""Folders of mixed files: kinds by content, tables by kind, and what couldn't be read."""

import json

import pytest
from test_documents import INVOICE, A

from ledgerkit.sources import registry

CHARGES = "Completed\nMay 1, 2026\nMy Card ****1234 -$1.50\nOrder #114-0000001-0000001\n"
EXPORT = "Transaction Date,Post Date,Description,Category,Type,Amount,Memo\n05/01/2026,05/02/2026,SHOP,Food,Sale,-1.50,\nbroken\n"
RECEIPT = {"date": "2026-05-01", "warehouse": "A", "items": [{"item_number": "1", "description": "d", "amount": "1.00", "taxable": False}], "subtotal": "1.00", "tax": "0.00", "total": "1.00", "tender": {"card_type": "VI", "card_ending": "1"}}
MANIFEST = {"site": "s", "run_date": "2026-05-01", "files": []}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    (root / "deeper").mkdir()
    texts = {"a.txt": A, "b.txt": INVOICE, "c.txt": CHARGES, "deeper/d.csv": "﻿" + EXPORT, "e.json": json.dumps(RECEIPT), "manifest.json": json.dumps(MANIFEST), "f.txt": "nothing known", "g.json": json.dumps(RECEIPT | {"total": "2.00"}), "h.json": "{broken", "empty.txt": "", "i.txt": A.replace("New Balance", "Balance")}
    for name, text in texts.items():
        (root / name).write_text(text)
    return registry.discover(spark, root.as_uri())


def test_kinds(files):
    got = {r["name"]: r.kind for r in files.filter("name <> 'empty.txt'").collect()}
    assert got == {"a.txt": "statement", "b.txt": "invoice", "c.txt": "charges", "d.csv": "export", "e.json": "receipt", "manifest.json": "manifest", "f.txt": None, "g.json": "receipt", "h.json": None, "i.txt": "statement"}


def test_tables(files):
    tables = registry.parse(files)
    assert {k: t.count() for k, t in tables.items()} == {"export": 2, "statement": 2, "invoice": 1, "charges": 1, "receipt": 2, "manifest": 1}
    assert tables["charges"].first().cents == 150 and tables["export"].filter("state = 'posted'").first().cents == 150


def test_quarantine(files):
    got = {(r.file.rsplit("/", 1)[1], r.kind, r.problem) for r in registry.quarantine(files).collect()}
    assert got - {("empty.txt", None, "unknown kind")} == {("f.txt", None, "unknown kind"), ("h.json", None, "unknown kind"), ("g.json", "receipt", "off"), ("i.txt", "statement", "incomplete"), ("d.csv", "export", "1 bad lines")}


def test_a_new_parser(files, monkeypatch):
    monkeypatch.setattr(registry, "PARSERS", dict(registry.PARSERS))

    @registry.parser("invoice")
    def short(rows):
        return rows.selectExpr("file", "length(text) AS n")

    assert registry.parse(files)["invoice"].first().n == len(INVOICE)


def test_manifest_by_hand(spark):
    entry = {"file": "x.txt", "kind": "statement", "card_id": None, "period_start": None, "period_end": None, "note": ""}
    docs = [(1, "s", "d", json.dumps({"site": "s", "run_date": "d", "files": [entry, entry | {"file": "y.json", "card_id": "c"}, entry | {"file": "z", "period_start": "2026-02", "period_end": "2026-01"}]})), (2, "s", "d", json.dumps({"site": "t", "run_date": "e", "files": []})), (3, "s", "d", None), (4, "s", "d", '{"site": "s"}')]
    listing = [(1, n) for n in ("x.txt", "y.json", "y.png", "session1.json", "guard.log", "manifest.json", "stray.pdf")] + [(2, "q.py"), (3, "w.txt")]
    rows = registry.manifest_problems(spark.createDataFrame(docs, "run int, site string, run_date string, text string"), spark.createDataFrame(listing, "run int, name string"), spark.createDataFrame([("d",)], "card string")).collect()
    assert {tuple(r) for r in rows} == {(1, "z", "not found"), (1, "y.json", "unknown card"), (1, "z", "wrong period"), (1, "stray.pdf", "unlisted"), (2, None, "other site"), (2, None, "other date"), (3, None, "no manifest"), (4, None, "no manifest")}
