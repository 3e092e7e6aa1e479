"""Exports in four layouts, read from files."""

import datetime

import pytest

from ledgerkit.sources import exports

D = datetime.date
FILES = {
    "a.csv": '﻿Transaction Date,Post Date,Description,Category,Type,Amount,Memo\r\n03/04/2025,03/05/2025,"GREEN GROCER, INC",Food,Sale,-12.34,\r\n,03/06/2025,Thank you for paying,,Payment,50.00,by phone\r\n03/07/2025,,HELD BACK,Food,Sale,-1.00,\r\n03/07/2025,03/08/2025,BROKEN,Food,Sale,1.2.3,\r\n',
    "b.csv": 'Status,Date,Description,Debit,Credit,Member Name\nCleared,04/01/2025,"SHOP ""ONE""",$ 20.50,,PAT DOE\nPENDING,04/02/2025,LATER,1.00,,PAT DOE\nCleared,04/03/2025,PAYMENT,,-$ 1,204.99,PAT DOE\nCleared,04/04/2025,BIG BUY,$ 2,000,000.10,,PAT DOE\nCleared,04/05/2025,NOTHING,,,PAT DOE\nCleared,04/06/2025,UNCLEAR,1,2,3,4,PAT DOE\nCleared,04/07/2025\n',
    "c.csv": "Date,Description,Card Member,Account #,Amount\n05/01/2025,BOOKS   AND  MORE,KIM ROE,-1,30.00\n05/02/2025,ODD CREDIT,KIM ROE,-1,-4.00\n05/03/2025,NO AMOUNT,KIM ROE,-1,\n",
    "d.csv": ",".join(exports.CHECKING) + '\n1,6/1/2025,5/31/2025,Debit,Posted,-40.00,,,RENT #12,Home,ACH,1000.00,,Direct  Debit #77\n2,6/2/2025,,Credit,Pending,10.00,,,SOON,,ACH,,,\n3,6/3/2025,,Credit,posted,"1,500.00",,,PAY,,ACH,"2,500.00",,\n',
    "e.csv": "Some,Other,Header\n1,2,3\n",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exports")
    for name, body in FILES.items():
        (folder / name).write_bytes(body.encode())
    got = exports.export_rows(exports.read_exports(spark, str(folder))).collect()
    return {(r.file[-5], r.line): r for r in got}


def test_states(rows):
    want = {("a", 2): "posted", ("a", 3): "posted", ("a", 4): "pending", ("a", 5): "bad", ("b", 2): "posted", ("b", 3): "pending", ("b", 4): "posted", ("b", 5): "posted", ("b", 6): "empty", ("b", 7): "bad", ("b", 8): "bad", ("c", 2): "posted", ("c", 3): "posted", ("c", 4): "empty", ("d", 2): "posted", ("d", 3): "pending", ("d", 4): "posted", ("e", 2): "bad"}
    assert {k: r.state for k, r in rows.items()} == want


def test_cards(rows):
    got = {k: (r.txn_date, r.post_date, r.cents, r.description, r.type, r.needs_review, r.member) for k, r in rows.items() if r.state == "posted" and r.layout != "checking"}
    assert got == {
        ("a", 2): (D(2025, 3, 4), D(2025, 3, 5), 1234, "GREEN GROCER, INC", "purchase", False, None),
        ("a", 3): (None, D(2025, 3, 6), -5000, "Thank you for paying", "payment", False, None),
        ("b", 2): (D(2025, 4, 1), D(2025, 4, 1), 2050, 'SHOP "ONE"', "purchase", False, "PAT DOE"),
        ("b", 4): (D(2025, 4, 3), D(2025, 4, 3), -120499, "PAYMENT", "payment", False, "PAT DOE"),
        ("b", 5): (D(2025, 4, 4), D(2025, 4, 4), 200000010, "BIG BUY", "purchase", False, "PAT DOE"),
        ("c", 2): (D(2025, 5, 1), D(2025, 5, 1), 3000, "BOOKS AND MORE", "purchase", False, "KIM ROE"),
        ("c", 3): (D(2025, 5, 2), D(2025, 5, 2), -400, "ODD CREDIT", "credit", False, "KIM ROE"),
    }
    assert rows["a", 3].memo == "by phone" and rows["a", 2].category == "Food"


def test_checking(rows):
    assert [(r.txn_date, r.cents, r.type, r.bank_type, r.balance, r.category) for r in (rows["d", 2], rows["d", 4])] == [
        (D(2025, 5, 31), 4000, "purchase", "ach|direct debit", 100000, "Home"),
        (None, -150000, "deposit", "ach|", 250000, None),
    ]
