"""Statements, invoices, charge lists and receipts: by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerkit.sources import orders, statements

D = datetime.date


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


A = """chase.com
Opening/Closing Date 12/06/25 - 01/05/26
Previous Balance $100.00
Payment, Credits -$100.00
Purchases +$.60
Cash Advances $0.00
Balance Transfers $0.00
Fees Charged $0.00
Interest Charged $0.00
New Balance $.60
Sapphire Reserve
PURCHASE
12/31 NOT YET 1.00
ACCOUNT ACTIVITY (CONTINUED)
12/07 NO SECTION 2.00
Payments and Other Credits
12/20 Payment Thank You -100.00
Order Number 9-9
Order Number 1-1
PAT O'HARA TRANSACTIONS THIS CYCLE (CARD 1)
PURCHASE
01/02 SHOP  ONE .60
02/30 NO SUCH DAY 1.00
2026 Totals Year-to-Date
01/03 OUTSIDE 5.00
Order Number 3-3
AACCCCOOUUNNTT AACCTTIIVVIITTYY
01/04 AGAIN INSIDE 6.00
"""


def test_statement_a(spark):
    st = statements.card_statements(files(spark, a=A))
    (s,) = st.collect()
    assert (s.layout, s.state, s.period_start, s.period_end, s.due_date, s.minimum_due) == ("a", "ok", D(2025, 12, 6), D(2026, 1, 5), None, None)
    assert (s.payments, s.purchases, s.new_balance, s.math_delta, s.products) == (10000, 60, 60, 0, ["SAPPHIRE RESERVE"])
    got = [tuple(r)[2:] for r in statements.activity_lines(st).orderBy("line_no").collect()]
    assert got == [
        (1, "UNKNOWN", D(2025, 12, 7), "NO SECTION", 200, None, None),
        (2, "PAYMENTS AND OTHER CREDITS", D(2025, 12, 20), "Payment Thank You", -10000, "1-1", None),
        (3, "PURCHASE", D(2026, 1, 2), "SHOP  ONE", 60, None, "PAT O'HARA"),
        (4, "PURCHASE", None, "NO SUCH DAY", 100, None, "PAT O'HARA"),
        (5, "PURCHASE", D(2026, 1, 4), "AGAIN INSIDE", 600, None, "PAT O'HARA"),
    ]


def test_statement_without_a_figure(spark):
    text = A.replace("Purchases +$.60\n", "").replace("12/06/25 -", "13/06/25 -")
    st = statements.card_statements(files(spark, a=text, b="nothing", c=None))
    (s,) = st.collect()
    assert s.state == "incomplete" and s.missing == ["purchases", "period"]
    assert statements.activity_lines(st).count() == 0


def test_statement_b_ends_for_good(spark):
    lines = ["Citi", "Billing Period: 01/01/26-01/31/26", "x Previous balance $1.00", "Payments -$1.00 Credits -$0.00", "Purchases +$2.00", "Cash advances +$0.00", "Fees +$0.00", "Interest +$0.00", "New balance $2.00"]
    lines += ["Date Date Description Amount", "Standard Purchases", "ALEX B. EXAMPLE", "No Activity", "01/04 01/05 SHOP $2.00", "Payments, Credits and Adjustments", "01/06 PAID -$1.00", "Fees Charged", "Date Date Description Amount", "01/07 01/07 LATE $3.00"]
    st = statements.card_statements(files(spark, b="\n".join(lines)))
    got = [(r.section, r.txn_date, r.description, r.cents, r.holder) for r in statements.activity_lines(st).orderBy("line_no").collect()]
    assert got == [("PURCHASE", D(2026, 1, 4), "SHOP", 200, "ALEX B. EXAMPLE"), ("PAYMENTS AND OTHER CREDITS", D(2026, 1, 6), "PAID", -100, None)]


def test_judged(spark):
    other = A.replace("01/05/26", "02/05/26").replace("New Balance $.60", "New Balance $.61")
    st = statements.card_statements(files(spark, a=A, b=A, c=other, d=other, e=A.replace("Fees Charged", "Fee")))
    expected = spark.createDataFrame([("a", "k", "Big Sapphire Reserve", D(2026, 1, 5)), ("b", "k", "Big Sapphire Reserve", D(2026, 1, 5)), ("c", "k", "sapphire reserve", D(2026, 1, 5)), ("d", "m", "Prime Visa", None), ("e", "k", "x", None)], "file string, card string, product string, period_end date")
    stored = spark.createDataFrame([("k", D(2026, 2, 5))], "card string, period_end date")
    got = {r.file: (r.verdict, r.problems) for r in statements.judged(st, expected, stored).collect()}
    assert got == {"a": ("store", []), "b": ("stored", []), "c": ("stored", ["another period", "math"]), "d": ("refused", ["another product", "math"]), "e": ("incomplete", ["another product"])}


def test_bank_sections(spark):
    text = "\n".join(["My  Checking: XX12", "01/01/26 Beginning Balance $1.00", "Previous Balance as of 01/01/26 is $1.00", "Other: XXX99", "Total Deposits $9.00", "MY CHECKING: XXX12 (continued)", "Total Deposits $2.00", "Total Withdrawals -$-0.50", "Total Deposits $8.00", "01/31/26 Ending Balance $2.50", "Ending Balance as of 01/31/26 is $2.50"])
    accounts = spark.createDataFrame([("a", ["my checking"], "12"), ("b", ["my checking"], "34"), ("c", ["other"], None)], "account string, names array<string>, ending string")
    rows = spark.createDataFrame([("f", text, x) for x in "abc"] + [("g", None, "a")], "file string, text string, account string")
    got = {(r.file, r.account): r for r in statements.bank_statements(rows, accounts).collect()}
    a = got["f", "a"]
    assert (a.state, a.ending, a.period_start, a.period_end, a.opening, a.deposits, a.closing) == ("ok", "12", D(2026, 1, 1), D(2026, 1, 31), 100, 200, 250)
    assert got["f", "b"].state == got["g", "a"].state == "no section" and got["f", "c"].state == "incomplete" and "opening" in got["f", "c"].missing


@pytest.mark.parametrize("raw, want", [("AACCCCOOUUNNTT XXYY aab", "ACCOUNT XY aab"), (" B`alance ", "Balance"), ("1111 99", "11 99"), ("", "")])
def test_clean_line(spark, raw, want):
    assert spark.range(1).select(statements.clean_line(F.lit(raw)).alias("x")).first().x == want


INVOICE = """Order placed May 3, 2026 Order # 114-1234567-7654321
Pat Example Visa ending in 1234
Item(s) Subtotal: $70.00
Shipping & Handling: $5.00
Total before tax: $72.00
Estimated tax to be
collected: $1.00
Gift Card Amount: -$3.00
Grand Total: $70.00
Arriving tomorrow
2 of Wide
Lamp
Sold by: Lamps
some note below the seller
$20.00
7
$9.99
Qty: 3 Odd Cup
$10.00
Pen
$4.00
10
Return window closed
© shop[LINKS]
page 1: https://x/dp/B000000001?q=asin_title_0_0
page 1: https://x/gp/product/B000000002
"""


def test_invoice(spark):
    (i,) = orders.invoices(files(spark, f=INVOICE)).collect()
    assert (i.state, i.order_id, i.order_date, i.payment_method, i.card_ending) == ("ok", "114-1234567-7654321", D(2026, 5, 3), "Visa", "1234")
    assert (i.subtotal, i.shipping, i.tax, i.promotions, i.gift_card, i.rewards, i.grand_total, i.problems) == (7000, 500, 100, 300, 300, 0, 7000, ["items"])
    assert [(x.line_no, x.title, x.seller, x.quantity, x.total, x.unit, x.sku) for x in i["items"]] == [
        (1, "Wide Lamp", "Lamps", 2, 2000, 1000, "B000000001"),
        (2, "7", None, 1, 999, 999, None),
        (3, "Odd Cup", None, 3, 1000, 1000, None),
        (4, "Pen", None, 10, 4000, 400, None),
    ]


def test_invoice_states(spark):
    got = {r.file: r for r in orders.invoices(files(spark, a="nothing", b=None, c=INVOICE.replace("Grand Total", "Total"), d="")).collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "no order", "b": "no order", "c": "no total", "d": "no order"}


def test_charge_list(spark):
    text = "\n".join(["Card ****1 -$1.00", "May 1, 2026", "My  Card ****1234 -$1,000.50", "Order #114-0000001-0000001 Order #114-0000009-0000009", "My Card ****1234 +$2.00", "In progress", "My Card ****1234 -$3.00 Order #114-0000002-0000002", "Completed", "My Card ****12345 -$4.00 Order #114-0000003-0000003", "My Card ****12345 -$4.00", "Order #114-0000003-0000003"])
    rows = orders.charge_lines(files(spark, f=text, g="", h=None)).orderBy("line_no").collect()
    ref = "114-000000{0}-000000{0}".format
    assert [(r.line_no, r.charge_date, r.card_name, r.card_ending, r.cents, r.order_ref, r.occurrence) for r in rows] == [
        (1, D(2026, 5, 1), "My Card", "1234", 100050, ref(1), 0),
        (2, D(2026, 5, 1), "My Card", "1234", -200, ref(2), 0),
        (3, D(2026, 5, 1), "My Card", "12345", 400, ref(3), 0),
        (4, D(2026, 5, 1), "My Card", "12345", 400, ref(3), 1),
    ]
    assert len({r.dedupe_key for r in rows}) == 4


def test_receipts(spark):
    item = lambda **x: {"item_number": None, "description": "d", "amount": "1.00", "taxable": False} | x
    good = {"date": "2026-05-01", "warehouse": "A  B", "items": [item(item_number="7", amount="10.00"), item(item_number="7", amount="5.00"), item(amount="-2.00", applies_to_item_number="7"), item(amount="1.00", is_instant_savings=True)], "subtotal": "12.00", "tax": "0.50", "total": "12.50", "tender": {"card_type": "XX", "card_ending": None}}
    docs = {"good": good, "off": good | {"total": "12.51"}, "bad": {k: v for k, v in good.items() if k != "tax"}, "empty": good | {"items": []}}
    got = {r.file: r for r in orders.receipts(files(spark, **{k: json.dumps(v) for k, v in docs.items()}, text="no json", none=None)).collect()}
    assert {k: r.state for k, r in got.items()} == {"good": "ok", "off": "off", "bad": "bad", "empty": "bad", "text": "bad", "none": "bad"}
    g = got["good"]
    assert (g.receipt_id, g.order_discount, g.card_type) == ("2026-05-01|A B|1250", 100, "XX") and [(x.cents, x.discount) for x in g["items"]] == [(1000, 200), (500, 0)]
    assert got["off"].problems == ["total"]
