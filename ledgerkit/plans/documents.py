"""Registered queries of the document sources: tables printed as statements, invoices and lists, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions import extract
from ledgerkit.operators import orders as matching_orders
from ledgerkit.operators import terms
from ledgerkit.plans.adapters import BANK_SQL, TXN_SQL, bank, cents, table, txn
from ledgerkit.plans.registration import registrar
from ledgerkit.sources import orders, registry, statements

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

#: Statements print two-digit years of this century; 28 years keep the calendar.
_SHIFT = 336

# Card statements: a file for each account and fiscal year (July to June), in the layout account % 3.

_FILES_SQL = f"""{TXN_SQL}, p AS (SELECT *, CAST(day + INTERVAL {_SHIFT} MONTH AS DATE) AS d FROM txn),
f AS (SELECT *, year(d) + CASE WHEN month(d) > 6 THEN 1 ELSE 0 END AS y, ['a', 'b', 'c'][1 + account % 3] AS layout FROM p)"""
_FILE_SQL = "account || '-' || y"


def _money(c) -> F.Column:
    return F.format_number((c.cast("decimal(24,2)") / 100).cast("decimal(24,2)"), 2)


def _dollars(c) -> F.Column:
    return F.concat(F.when(c < 0, "-$").otherwise("$"), _money(F.abs(c)))


def _text(*parts) -> F.Column:
    """Lines one below the other; null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def printed_statements(spark, d) -> DataFrame:
    """file, text of every account's statements."""
    t = txn(spark, d).withColumn("day", F.add_months("day", _SHIFT))
    t = t.withColumn("y", F.year("day") + (F.month("day") > 6).cast("int")).withColumn("layout", F.element_at(F.array(*map(F.lit, "abc")), (F.col("account") % 3 + 1).cast("int")))
    date, shop, k = F.date_format("day", "MM/dd"), F.concat(F.lit("SHOP NO "), F.col("grp")), F.col("layout")
    a = F.concat_ws("\n", F.concat_ws(" ", date, shop, F.concat(F.when(F.col("cents") < 0, "-").otherwise(""), _money(F.abs("cents")))), F.when(F.col("cents") > 0, F.concat(F.lit("Order Number 114-"), F.col("id"))))
    b = F.concat_ws(" ", date, date, shop, _dollars(F.col("cents")))
    c = F.concat(F.date_format("day", "MM/dd/yy"), F.lit("* "), shop, F.lit(" "), _dollars(F.col("cents")), F.lit("⧫\ndetail of the shop"))
    t = t.withColumn("shown", F.when(k == "a", a).when(k == "b", b).otherwise(c))
    rows = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(side, F.struct("id", "shown")))), lambda x: x.shown), "\n")
    out, into = F.coalesce(F.sum(F.when(F.col("cents") > 0, F.col("cents"))), F.lit(0)), F.coalesce(-F.sum(F.when(F.col("cents") < 0, F.col("cents"))), F.lit(0))
    g = t.groupBy("account", "y", "layout").agg(rows(F.col("cents") < 0).alias("payments"), rows(F.col("cents") > 0).alias("purchases"), out.alias("out"), into.alias("into"))
    out, into = F.col("out"), F.col("into")
    opening = 100_000 + into
    new, y, n = opening + out - into, F.col("y"), F.date_diff(F.make_date("y", F.lit(6), F.lit(30)), F.make_date(F.col("y") - 1, F.lit(6), F.lit(30)))
    line = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    yy = lambda c: F.substring(c.cast("string"), 3, 2)
    a = _text(
        "www.chase.com", line("Opening/Closing Date 07/01/", y - 1, " - 06/30/", yy(y)), line("Previous Balance ", _dollars(opening)), line("Payment, Credits -", _dollars(into)), line("Purchases +", _dollars(out)),
        "Cash Advances $0.00", "B`alance Transfers .00", "Fees Charged $0.00", "Interest Charged $0.00", line("New Balance ", _dollars(new)), line("Payment Due Date: 07/25/", yy(y)), "Minimum Payment Due: $35.00", "Purchases +$9.99",
        "07/04 BEFORE THE TABLE 1.00", "AACCCCOOUUNNTT AACCTTIIVVIITTYY", "PAYMENTS AND OTHER CREDITS", F.col("payments"), "ALEX  EXAMPLE TRANSACTIONS THIS CYCLE (CARD 0000)", "PURCHASE", F.col("purchases"), f"{2000} Totals Year-to-Date", "07/05 AFTER THE TABLE 1.00",
    )
    b = _text(
        "www.citi.example", line("Billing Period: 07/01/", yy(y - 1), "-06/30/", yy(y)), "Minimum payment due: $41.00", line("Payment due date: 07/23/", yy(y)), line("Previous balance ", _dollars(opening)), line("your Minimum Payment Payments -", _dollars(into)),
        "Credits -$0.00", line("Purchases +", _dollars(out)), "Cash advances +$0.00", "Fees +$0.00", "Interest +$0.00", line("New balance ", _dollars(new)), "Date Date Description Amount", "Payments, Credits and Adjustments", F.col("payments"),
        "Standard Purchases", "ALEX EXAMPLE", F.col("purchases"), "Fees Charged", "07/05 07/05 AFTER THE TABLE $1.00",
    )
    c = _text(
        line("Closing Date06/30/", yy(y)), "Account Ending0-00000 americanexpress.com", "Previous Balance $0.00", line("Days in Billing Period:", n), line("Payment Due Date 07/10/", yy(y)), "Minimum Payment Due $40.00", "counseling services, call us. Account Total",
        line("Previous Balance ", _dollars(opening)), line("Payments/Credits -", _dollars(into)), line("New Charges +", _dollars(out)), "Fees +$0.00", "Interest Charged +$0.00", line("New Balance = ", _dollars(new)), "Payments Amount",
        "Detail *Indicates posting date", F.col("payments"), "\fNew Charges", "ALEX EXAMPLE", "Card Ending 0-00000", F.col("purchases"), "2000 Fees and Interest Totals Year-to-Date", "07/05/20 AFTER THE TABLE $1.00",
    )
    return g.select(F.concat_ws("-", "account", "y").alias("file"), F.when(k == "a", a).when(k == "b", b).otherwise(c).alias("text"))


@query(f"""WITH {_FILES_SQL}, s AS (SELECT {_FILE_SQL} AS file, layout, y, sum(greatest(cents, 0)) AS purchases, sum(greatest(-cents, 0)) AS payments FROM f GROUP BY ALL)
SELECT file, layout, 'ok' AS state, make_date(y - 1, 7, 1) AS period_start, make_date(y, 6, 30) AS period_end,
make_date(y, 7, CASE layout WHEN 'a' THEN 25 WHEN 'b' THEN 23 ELSE 10 END) AS due_date, CASE layout WHEN 'a' THEN 3500 WHEN 'b' THEN 4100 ELSE 4000 END AS minimum_due,
CAST(100000 + payments AS BIGINT) AS previous_balance, CAST(payments AS BIGINT) AS payments, CAST(purchases AS BIGINT) AS purchases, CAST(100000 + purchases AS BIGINT) AS new_balance, 0 AS math_delta, 0 AS n_missing FROM s""")
def card_statements(spark, d):
    """Summaries of statements in three layouts."""
    rows = statements.card_statements(printed_statements(spark, d))
    return rows.select("file", "layout", "state", "period_start", "period_end", "due_date", "minimum_due", "previous_balance", "payments", "purchases", "new_balance", "math_delta", F.size("missing").alias("n_missing"))


@query(f"""WITH {_FILES_SQL}
SELECT {_FILE_SQL} AS file, layout, CAST(row_number() OVER (PARTITION BY account, y ORDER BY cents > 0, id) AS BIGINT) AS line_no,
CASE WHEN cents > 0 THEN 'PURCHASE' ELSE 'PAYMENTS AND OTHER CREDITS' END AS section, d AS txn_date, 'SHOP NO ' || grp AS description, cents,
CASE WHEN layout = 'a' AND cents > 0 THEN '114-' || id END AS order_ref, CASE WHEN cents > 0 THEN 'ALEX EXAMPLE' END AS holder FROM f""")
def statement_activity(spark, d):
    """Activity lines of statements in three layouts; years come from the closing dates."""
    return statements.activity_lines(statements.card_statements(printed_statements(spark, d)))


# Bank statements: a file for each account and month, its section interrupted by a page break.

_BANK_FILES_SQL = f"""{BANK_SQL}, b AS (SELECT account, date_trunc('month', day) AS m, sum(greatest(-cents, 0)) AS deposits, sum(greatest(cents, 0)) AS withdrawals FROM bank GROUP BY ALL)"""


@query(f"""WITH {_BANK_FILES_SQL}
SELECT account || '-' || strftime(m, '%Y%m') AS file, account, 'ok' AS state, lpad(CAST(account AS VARCHAR), 4, '0') AS ending, CAST(m AS DATE) AS period_start, last_day(m) AS period_end, 150000 AS opening,
CAST(deposits + CASE WHEN account % 2 = 0 THEN 42 ELSE 0 END AS BIGINT) AS deposits, CAST(withdrawals AS BIGINT) AS withdrawals,
CAST(150000 + deposits - withdrawals AS BIGINT) AS closing, CASE WHEN account % 2 = 0 THEN 42 ELSE 0 END AS math_delta FROM b""")
def bank_statement_sections(spark, d):
    """The checking section of monthly bank statements; a dividend that the closing balance leaves out shows in math_delta."""
    b = bank(spark, d).withColumn("m", F.trunc("day", "month"))
    b = b.groupBy("account", "m").agg(F.sum(F.greatest(-F.col("cents"), F.lit(0))).alias("into"), F.sum(F.greatest("cents", F.lit(0))).alias("out"))
    start, end = F.date_format("m", "MM/dd/yy"), F.date_format(F.last_day("m"), "MM/dd/yy")
    ending = F.lpad(F.col("account").cast("string"), 4, "0")
    closing = 150_000 + F.col("into") - F.col("out")
    line = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    text = _text(
        "SUMMARY OF ACCOUNTS", "Savings: XXXXXX9999", line(start, " Beginning Balance $5.00"), line(end, " Ending Balance $5.00"), line("Everyday  checking: XXXXXX", ending), line(start, " Beginning Balance $1,500.00"),
        line(start, " External Deposit $0.00 $1,500.00"), line("End of Page 1\fEveryday Checking: XXXXXX", ending, " (Continued)"), line(end, " Ending Balance ", _dollars(closing)), line("Previous Balance as of ", start, " is $1,500.00"),
        line("Total Deposits ", _dollars(F.col("into"))), line("Total Withdrawals ", _dollars(F.col("out"))), F.when(F.col("account") % 2 == 0, "Total Dividends Earned $0.42"), line("Ending Balance as of ", end, " is ", _dollars(closing)),
        "End of statement", "Total Deposits $77.00",
    )
    files = b.select(F.concat_ws("-", "account", F.date_format("m", "yyyyMM")).alias("file"), "account", text.alias("text"))
    accounts = b.select("account", F.array(F.lit(" everyday Checking"), F.lit("")).alias("names"), ending.alias("ending")).distinct()
    rows = statements.bank_statements(files, accounts)
    return rows.select("file", "account", "state", "ending", "period_start", "period_end", "opening", "deposits", "withdrawals", "closing", "math_delta")


# Invoices: one for each order, its titles wrapped, quantities before the title or below the price.

_INVOICE_SQL = """li AS (SELECT l_orderkey AS k, l_partkey AS part, l_suppkey AS supp, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS line_no,
  l_linenumber % 3 AS mode, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, 'B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS sku FROM lineitem),
it AS (SELECT *, CASE WHEN mode = 2 THEN 1 ELSE q END AS quantity, CASE WHEN mode = 1 THEN p * q ELSE p END AS total, CASE WHEN mode = 0 AND p % q = 0 THEN p // q ELSE p END AS unit,
  CASE WHEN k % 2 = 0 OR count(DISTINCT sku) OVER (PARTITION BY k) = count(*) OVER (PARTITION BY k) THEN sku END AS found FROM li)"""
_INVOICE_ID = "'114-' || lpad(CAST(k AS VARCHAR), 7, '0') || '-0000001'"


def printed_invoices(spark, d) -> DataFrame:
    """file, text of every order's invoice."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("q"), cents("l_extendedprice").alias("p")
    )
    mode, sku = F.col("n") % 3, F.concat(F.lit("B"), F.lpad(F.col("part").cast("string"), 9, "0"))
    title = F.concat(F.when(mode == 0, F.concat(F.lit("Qty: "), F.col("q"), F.lit(" "))).otherwise(""), F.lit("Part of a wide\nassortment "), F.col("part"))
    shown = _text("Delivered October 5", "Your package was left near the door.", title, F.concat(F.lit("Sold by: Supplier "), F.col("supp")), "Return or replace items: Eligible", _dollars(F.col("p")), F.when(mode == 1, F.col("q").cast("string")))
    total = F.when(mode == 1, F.col("p") * F.col("q")).otherwise(F.col("p"))
    rows = li.withColumns({"shown": shown, "total": total, "sku": sku}).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "part", "supp", "q", "p", "shown", "sku"))).alias("rows"), F.sum("total").alias("subtotal"))
    line = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    placed = F.transform("rows", lambda r, i: F.concat(F.lit("page 1: https://shop.example/dp/"), r.sku, F.when(F.col("k") % 2 == 0, F.concat(F.lit("?ref_=x_asin_title_"), i, F.lit("_0"))).otherwise("")))
    sub = F.col("subtotal")
    day = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("day"))
    text = _text(
        "Order Summary", line("Order placed ", F.col("day"), " Order # 114-", F.lpad(F.col("k").cast("string"), 7, "0"), "-0000001"), line("Alex Example Prime Visa••••0000 Item(s) Subtotal: ", _dollars(sub)), line("[ADDRESS] Total before tax: ", _dollars(sub - 100)),
        "United States Estimated tax to be $1.35", "collected:", line("Grand Total: ", _dollars(sub + 35)), F.array_join(F.transform("rows", lambda r: r.shown), "\n"), "Back to top", "Conditions of Use", line("© Shop[LINKS]"), F.array_join(placed, "\n"),
    )
    return rows.join(day, "k").select(F.col("k").cast("string").alias("file"), text.alias("text"))


@query(f"""WITH {_INVOICE_SQL} SELECT {_INVOICE_ID} AS order_id, line_no, 'Part of a wide assortment ' || part AS title, 'Supplier ' || supp AS seller, quantity, total, unit, found AS sku FROM it""")
def invoice_items(spark, d):
    """Items of every invoice, with their article numbers from the links."""
    rows = orders.each(orders.invoices(printed_invoices(spark, d)), "items", "i")
    return rows.select("order_id", "i.line_no", "i.title", "i.seller", "i.quantity", "i.total", "i.unit", "i.sku")


@query(f"""WITH {_INVOICE_SQL}, s AS (SELECT k, CAST(sum(total) AS BIGINT) AS subtotal, count(*) AS n FROM it GROUP BY k)
SELECT {_INVOICE_ID} AS order_id, 'ok' AS state, CAST(o_orderdate AS DATE) AS order_date, 'Prime Visa' AS payment_method, '0000' AS card_ending, subtotal, 100 AS promotions, 135 AS tax, subtotal + 35 AS grand_total, CAST(n AS INTEGER) AS n_items, 0 AS n_problems
FROM s JOIN orders ON k = o_orderkey""")
def invoices(spark, d):
    """Amounts of every invoice; promotions follow from the total before tax."""
    rows = orders.invoices(printed_invoices(spark, d))
    return rows.select("order_id", "state", "order_date", "payment_method", "card_ending", "subtotal", "promotions", "tax", "grand_total", F.size("items").alias("n_items"), F.size("problems").alias("n_problems"))


_CHARGES_SQL = f"""{TXN_SQL}, c AS (SELECT account, id, day, cents, CASE WHEN id % 3 > 0 THEN '114-' || lpad(CAST(id AS VARCHAR), 7, '0') || '-0000001' END AS ref FROM txn),
n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day DESC, id) AS line_no, row_number() OVER (PARTITION BY account, day, cents, ref ORDER BY id) - 1 AS occ FROM c)"""


@query(f"""WITH {_CHARGES_SQL} SELECT CAST(account AS VARCHAR) AS file, line_no, day AS charge_date, 'Prime Visa' AS card_name, '0000' AS card_ending, cents, ref AS order_ref, CAST(occ AS INTEGER) AS occurrence,
sha256(day || '|' || cents || '|' || coalesce(ref, '') || '|Prime Visa|0000|' || occ) AS dedupe_key FROM n""")
def charge_list(spark, d):
    """Every account's charges, printed as a list under headings of days, and read back with keys."""
    t = txn(spark, d)
    ref = F.concat(F.lit("Order #114-"), F.lpad(F.col("id").cast("string"), 7, "0"), F.lit("-0000001"))
    charge = F.concat(F.lit("Prime  Visa ****0000 "), F.when(F.col("cents") > 0, "-$").otherwise("+$"), _money(F.abs("cents")))
    shown = F.when(F.expr("id % 3 = 1"), F.concat(charge, ref)).when(F.expr("id % 3 = 2"), F.concat(charge, F.lit("\nSubtotal $57.49\n"), ref, F.lit("\n"), ref)).otherwise(charge)
    days = t.select("account", "day", "id", shown.alias("shown")).groupBy("account", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "shown"))), lambda x: x.shown), "\n").alias("shown"))
    lists = days.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("day", F.concat_ws("\n", F.date_format("day", "MMMM d, yyyy"), "shown").alias("shown"))), asc=False).alias("days"))
    text = _text("Prime Visa ****0000 -$9.99 before any day", "Pending", "May 1, 2030", "Prime Visa ****0000 -$1.00", "Completed since", F.array_join(F.transform("days", lambda x: x.shown), "\n\f"))
    return orders.charge_lines(lists.select(F.col("account").cast("string").alias("file"), text.alias("text")))


_RECEIPTS_SQL = """r AS (SELECT l_orderkey AS k, CAST(l_partkey AS VARCHAR) AS number, l_linenumber AS n, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS off FROM lineitem),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY n, number, c, off) AS INTEGER) AS line_no, row_number() OVER (PARTITION BY k, number ORDER BY n, c, off) AS nth,
  sum(CASE WHEN n % 2 = 0 THEN off ELSE 0 END) OVER (PARTITION BY k, number) AS own, sum(CASE WHEN n % 2 = 1 THEN off ELSE 0 END) OVER (PARTITION BY k) AS whole FROM r)"""


@query(f"""WITH {_RECEIPTS_SQL} SELECT CAST(k AS VARCHAR) AS file, CASE WHEN k % 5 = 0 THEN 'off' ELSE 'ok' END AS state, line_no, number AS item_number, c AS cents, CAST(CASE WHEN nth = 1 THEN own ELSE 0 END AS BIGINT) AS discount,
CAST(whole AS BIGINT) AS order_discount, 'Visa' AS card_type FROM o""")
def receipt_items(spark, d):
    """Orders as receipt transcripts: savings of even lines name their item, those of odd ones don't. Every fifth total is wrong."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("number"), cents("l_extendedprice").alias("c"), cents("l_discount").alias("off"))
    plain = lambda c: F.concat(F.when(c < 0, "-").otherwise(""), F.call_function("div", F.abs(c), F.lit(100)), F.lit("."), F.lpad((F.abs(c) % 100).cast("string"), 2, "0"))
    field = lambda number, text, amount, instant, to: F.struct(number.alias("item_number"), text.alias("description"), amount.alias("amount"), F.lit(True).alias("taxable"), instant.alias("is_instant_savings"), to.alias("applies_to_item_number"))
    nothing, no = F.lit(None).cast("string"), F.lit(False)
    # The amounts are printed before the shuffle, the rest of a line after it.
    li = li.withColumns({"price": plain(F.col("c")), "less": plain(F.when(F.col("n") % 2 == 0, -F.col("off")).otherwise(F.col("off")))})
    rows = li.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "number", "c", "off", "price", "less"))).alias("rows"), F.sum(F.col("c") - F.col("off")).alias("subtotal"))
    item = lambda r: field(r.number, F.lit("THING"), r.price, no, nothing)
    saved = lambda r: F.when((r.off > 0) & (r.n % 2 == 0), field(nothing, F.lit("TPD"), r.less, no, r.number)).when(r.off > 0, field(nothing, F.lit("SAVINGS"), r.less, F.lit(True), nothing))
    items = F.array_compact(F.flatten(F.transform("rows", lambda r: F.array(item(r), saved(r)))))
    doc = F.struct(F.lit("2026-10-05").alias("date"), F.lit("SOME  WHERE").alias("warehouse"), items.alias("items"), plain(F.col("subtotal")).alias("subtotal"), F.lit("1.00").alias("tax"), plain(F.col("subtotal") + 100 + (F.col("k") % 5 == 0).cast("int")).alias("total"), F.struct(F.lit("vi").alias("card_type"), F.lit("0000").alias("card_ending")).alias("tender"))
    read = orders.receipts(rows.select(F.col("k").cast("string").alias("file"), F.to_json(doc).alias("text")))
    return orders.each(read, "items", "i").select("file", "state", "order_discount", "card_type", "i.line_no", "i.item_number", "i.cents", "i.discount")


# Orders and their charges: each purchase by one kind of evidence, none of them ambiguous here.

_MATCH_SQL = f"""{TXN_SQL}, o AS (SELECT id, day, cents, id % 3 AS kind, 'CARD ' || lpad(CAST(account AS VARCHAR), 8, '0') AS card FROM txn WHERE type = 'purchase'),
u AS (SELECT *, count(*) OVER (PARTITION BY card, cents) AS n FROM o)"""


def _order_tables(spark, d):
    o = txn(spark, d).filter("type = 'purchase'").withColumn("card", F.concat(F.lit("CARD "), F.lpad(F.col("account").cast("string"), 8, "0")))
    o = o.withColumn("n", F.count("*").over(Window.partitionBy("card", "cents"))).filter("n = 1")
    ref = F.concat(F.lit("114-"), F.col("id"))
    txns = o.select("id", F.date_add("day", (F.col("id") % 4).cast("int")).alias("day"), F.date_add("day", 5).alias("post_day"), "cents", "type", F.when(F.expr("id % 3 = 0"), ref).alias("order_ref"), F.col("card").alias("product"))
    orders_ = o.filter("id % 7 > 0").select("id", ref.alias("ref"), "day", F.col("cents").alias("total"), F.lower("card").alias("payment"))
    charges = o.filter("id % 3 = 1").select((F.col("id") + 10_000_000).alias("id"), ref.alias("ref"), "day", "cents", "card")
    user = o.filter("id % 11 = 0").select("id", F.col("id").alias("order_id"))
    return txns, orders_, charges, user


@query(f"""WITH {_MATCH_SQL}, r AS (SELECT *, id % 7 > 0 AS there FROM u WHERE n = 1 AND id % 11 > 0)
SELECT id, CASE WHEN there THEN id END AS order_id, CASE WHEN kind = 1 THEN id + 10000000 END AS charge_id,
CASE WHEN NOT there THEN 'charge_only' WHEN kind = 2 THEN 'window' ELSE 'exact' END AS method, CASE WHEN there AND kind = 2 THEN 0.8 ELSE 1.0 END AS confidence FROM r WHERE there OR kind = 1""")
def order_matches(spark, d):
    """Purchases and the orders they paid, by order number, by the merchant's list, or by the order's total."""
    return matching_orders.match_orders(*_order_tables(spark, d), -1, 5)[0].withColumn("confidence", F.col("confidence").cast("decimal(2,1)"))


@query(f"""WITH {_MATCH_SQL} SELECT id, CASE kind WHEN 0 THEN 'not_imported' WHEN 1 THEN 'no_invoice' ELSE 'no_order' END AS reason FROM u WHERE n = 1 AND id % 11 > 0 AND id % 7 = 0""")
def order_reviews(spark, d):
    """Purchases of orders whose invoices are missing."""
    return matching_orders.match_orders(*_order_tables(spark, d), -1, 5)[1].select("id", "reason")


@query(f"""WITH {_MATCH_SQL} SELECT id FROM u WHERE n = 1 AND id % 7 > 0 AND id % 11 > 0 AND id % 3 = 2 AND day < DATE '2001-01-01' AND id % 5 = 0""")
def uncharged_orders(spark, d):
    """Orders of tracked cards without a charge after the days of grace: those whose purchases were taken away."""
    txns, orders_, charges, user = _order_tables(spark, d)
    matches, _ = matching_orders.match_orders(txns.filter("not (id % 3 = 2 and id % 5 = 0)"), orders_, charges, user, -1, 5)
    matched = matches.select("id", "order_id").unionByName(user)
    return matching_orders.uncharged_orders(orders_, matched, F.lit("2001-01-14").cast("date"), 14, ["My Card 0", "CARD"])


@query(f"""WITH {_MATCH_SQL} SELECT id, id AS order_id FROM u WHERE n = 1 AND id % 4 < 3""")
def receipt_matches(spark, d):
    """Receipts and the purchases of their totals up to two days later; each account's cents are its own."""
    txns, orders_, _, user = _order_tables(spark, d)
    own = lambda df, c: df.withColumn(c, F.col(c) * 100_000 + F.col("id") % 100_000)
    receipts = own(txns.select("id", F.date_sub("day", (F.col("id") % 4).cast("int")).alias("day"), F.col("cents").alias("total"), F.lit("Visa").alias("payment")), "total")
    rows = own(txns.select("id", "day", "cents", "type", F.lit("warehouse").alias("group")), "cents")
    return matching_orders.match_receipts(receipts, rows, user.filter("false"), F.lit("2001-01-01").cast("date"), 14)[0]


# Free text.

_WORDS = extract.NUMBER_WORDS | dict.fromkeys(extract.ZERO_WORDS, 0)
_NUMBERS_SQL = "[" + ", ".join(f"{{'w': '{w}', 'n': {n}}}" for w, n in _WORDS.items()) + "]"


@query(rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(translate(text, '‘’“”–—−', '''''""---'), '[®™©]', '', 'g'), '(\w)-\s*\n\s*(\w)', '\1\2', 'g')), '\s+', ' ', 'g')) AS s FROM documents),
w AS (SELECT unnest({_NUMBERS_SQL}, recursive := true)),
n AS (SELECT doc_id, CAST(replace(unnest(regexp_extract_all(s, '(?:^|[^0-9.])((?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?)', 1)), ',', '') AS DOUBLE) AS number FROM t
      UNION SELECT doc_id, CAST(w.n AS DOUBLE) FROM (SELECT doc_id, unnest(regexp_extract_all(s, '[a-z]+(?:-[a-z]+)?')) AS tok FROM t) JOIN w ON w.w = tok)
SELECT DISTINCT doc_id, number FROM n""")
def document_numbers(spark, d):
    """Every number that a document states, in digits or words."""
    return table(spark, d, "documents").select("doc_id", F.explode(extract.stated_numbers(F.col("text"))).alias("number"))


_TERMS_SQL = r"""b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
k AS (SELECT DISTINCT array_to_string(w[1:1 + item_id % 3], ' ') AS term FROM b WHERE len(w) > 3)"""


@query(rf"""WITH {_TERMS_SQL}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
g AS (SELECT doc_id, n, unnest(range(0, CAST(len(w) - n + 1 AS BIGINT))) AS pos, w FROM d, (VALUES (1), (2), (3)) s(n) WHERE len(w) >= n),
r AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + n], ' ') AS run FROM g)
SELECT doc_id, term, count(*) AS n, CAST(min(pos) AS INTEGER) AS first FROM r JOIN k ON run = term GROUP BY doc_id, term""")
def term_scan(spark, d):
    """Which of the benchmark items' first words, one to three of them, each document holds, and how often."""
    w = terms.words(F.col("text"))
    known = table(spark, d, "benchmark").select("item_id", w.alias("w")).filter("size(w) > 3").select(F.array_join(F.slice("w", F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), " ").alias("term"))
    return terms.scan(table(spark, d, "documents"), known)


# Manifests: a run folder for each account, its files those of its orders.


@query(rf"""WITH {TXN_SQL}, f AS (SELECT account AS run, id || '.txt' AS file, id, day FROM txn),
l AS (SELECT run, file, id FROM f WHERE id % 7 > 0 UNION ALL SELECT run, file, id FROM f WHERE id % 7 > 0 AND id % 10 = 0), bad AS (SELECT DISTINCT run FROM f WHERE run % 13 = 0)
SELECT run, CAST(NULL AS VARCHAR) AS file, 'no manifest' AS problem FROM bad
UNION ALL SELECT run, file, 'listed twice' FROM l WHERE run % 13 > 0 GROUP BY run, file HAVING count(*) > 1
UNION ALL SELECT DISTINCT run, file, 'not found' FROM l WHERE run % 13 > 0 AND id % 4 = 0
UNION ALL SELECT DISTINCT run, file, 'unknown card' FROM l WHERE run % 13 > 0 AND id % 9 = 1
UNION ALL SELECT DISTINCT run, file, 'wrong period' FROM l WHERE run % 13 > 0 AND id % 8 = 3
UNION ALL SELECT run, file, 'unlisted' FROM f WHERE run % 13 > 0 AND id % 7 = 0 AND id % 4 > 0""")
def manifest_problems(spark, d):
    """What is wrong with the manifests of run folders: repeated, missing, strange and unlisted files."""
    t = txn(spark, d).select(F.col("account").alias("run"), F.concat("id", F.lit(".txt")).alias("file"), "id", "day")
    some = F.when(F.col("id") % 3 == 0, F.lit(None).cast("string"))
    card = F.when(F.col("id") % 9 == 1, "strange").otherwise(some.otherwise("known"))
    day = lambda n: F.date_add("day", n).cast("string")
    entry = F.struct("file", F.lit("statement").alias("kind"), card.alias("card_id"), F.when(F.col("id") % 8 == 3, day(9)).otherwise(day(0)).alias("period_start"), day(5).alias("period_end"), F.lit("").alias("note"))
    twice = t.filter("id % 7 > 0").withColumn("e", F.explode(F.when(F.col("id") % 10 == 0, F.array(entry, entry)).otherwise(F.array(entry))))
    lists = t.select("run").distinct().join(twice.groupBy("run").agg(F.collect_list("e").alias("files")), "run", "left")
    doc = F.to_json(F.struct(F.lit("shop").alias("site"), F.lit("2026-10-05").alias("run_date"), F.coalesce("files", F.array().cast("array<struct<file:string,kind:string,card_id:string,period_start:string,period_end:string,note:string>>")).alias("files")))
    manifests = lists.select("run", F.lit("shop").alias("site"), F.lit("2026-10-05").alias("run_date"), F.when(F.col("run") % 13 > 0, doc).otherwise("no json").alias("text"))
    listing = t.filter("id % 4 > 0").select("run", F.col("file").alias("name")).unionByName(t.select("run", F.lit("manifest.json").alias("name")))
    return registry.manifest_problems(manifests, listing, spark.createDataFrame([("known",)], "card string"))
