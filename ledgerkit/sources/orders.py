"""Order documents: invoices, lists of charges and receipts.

A file is one row. An invoice's items need a state machine with a look at the line after a price; it is a fold over the array of
the file's lines, inside the row. A charge list inherits its dates and sections from the lines above: windows over the file's lines.
Receipts are JSON by a fixed schema. Documents that can't be read keep their row, with a state and the problems found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.money import to_cents
from ledgerkit.operators.ingest import occurrence_keys
from ledgerkit.sources.statements import lines_of

# Labels and line formats as the documents print them.
_MONEY = r"-?\$[\d,]+\.\d{2}"
_ORDER = r"Order placed\s+([A-Z][a-z]+ \d{1,2}, \d{4})\s+Order #\s*(\d{3}-\d{7}-\d{7})"
_PAYMENT = (
    r"((?:(?:Prime|Amazon|Chase|Citi|Costco|Capital One|Apple)\s+)?(?:Visa|Mastercard|MasterCard|American Express|Amex|Discover|Store Card|Card))"
    r"\s*(?:••••|\*{4}|ending in\s*)(\d{4,5})"
)
AMOUNTS = {
    "subtotal": r"Item\(s\) Subtotal:",
    "shipping": r"Shipping & Handling:",
    "total_before_tax": r"Total before tax:",
    "tax": r"Estimated tax to be\s+(?:collected:)?",
    "grand_total": r"Grand Total:",
    "promotions": r"(?:Promotion|Your Coupon Savings|Discount)s?(?: Applied)?:",
    "gift_card": r"Gift Card Amount:",
    "rewards": r"(?:Rewards Points|Amazon Points|Reward Points)(?: Applied)?:",
}
_STATUS = (
    r"(?i)^(?:Delivered\b|Arriving\b|Shipped\b|Not yet shipped|Your package\b|Package was\b|Out for delivery|Return or replace items|Return items|Return window|Back to top$|"
    r"Order Summary$|View related transactions|United States$|collected:$|Ship to\b|Refunded$|Refund issued|Replacement ordered)"
)
_FOOTER = r"^(?:Conditions of Use|©)"
_SELLER = r"^Sold by:\s*(.+)$"
_QUANTITY = r"(?i)^(?:Qty:\s*(\d+)\s*|(\d+)\s+of\s+)"
_LINK = r"/(?:dp|gp/product)/([A-Z0-9]{10})\b"
_LINK_AT = _LINK + r"[^\s]*?asin_title_(\d+)_\d+"
_DAY = r"^((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})\b"
_CHARGE = r"([A-Za-z][A-Za-z .&'-]*?)\s*\*{4}(\d{4,5})\s+([-+])\$([\d,]+\.\d{2})"
_CHARGE_ORDER = r"Order #\s*([A-Z0-9]{3}-\d{7}-\d{7})"
CARD_TYPES = {"VI": "Visa", "MC": "Mastercard", "AX": "American Express", "DS": "Discover"}
# End of the fixed values.

_ITEM = "struct<title:string,seller:string,quantity:int,total:bigint,unit:bigint>"
RECEIPT = (
    "date string, warehouse string, items array<struct<item_number:string,description:string,amount:string,taxable:boolean,is_instant_savings:boolean,applies_to_item_number:string>>, "
    "subtotal string, tax string, total string, tender struct<card_type:string,card_ending:string>"
)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _long_day(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("MMMM d, yyyy")).cast("date")


def _let(x: Column, of) -> Column:
    """``of(x)`` with x worked out once: inside lambdas equal expressions aren't shared, and a fold would repeat them for every mention."""
    return F.get(F.transform(F.array(x), of), 0)


def _found_once(text: Column, pattern: str, group: int = 1) -> Column:
    return _let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def _amount(text: Column) -> Column:
    """``to_cents``, with a short way for plain amounts of two decimals."""
    return F.when(text.rlike(r"^-?\d{1,14}\.\d\d$"), F.translate(text, ".", "").cast("long")).otherwise(to_cents(text))


def _price(line: Column) -> Column:
    """Cents of a line that is ``_MONEY`` and nothing else."""
    digits = F.translate(line, "$,.", "")
    return F.when(F.length(line) <= 18, digits.cast("long")).otherwise(to_cents(line))


def each(rows: DataFrame, column: str, name: str) -> DataFrame:
    """A row as ``name`` for each of the structs in ``column``, as explode gives them.

    The optimizer puts a filter of explode's empty arrays below it, which works the whole column out twice more; explode_outer has no such filter.
    """
    return rows.withColumn(name, F.explode_outer(column)).filter(F.col(name).isNotNull())


def item_lines(lines: Column) -> Column:
    """Items of an invoice's lines: titles run over lines up to the seller, a price ends an item, and a bare number right below it multiplies.

    A title may begin with its quantity, which the price then covers. Lines of status and footer are skipped. The fold only tells what a line
    is, cheap tests first; the last item waits in the state for its number, and quantities are read once for each item.
    """
    found = "struct<title:string,seller:string,total:bigint,times:int>"
    quantity = lambda title: F.coalesce(_found_once(title, _QUANTITY), _found_once(title, _QUANTITY, 2)).cast("int")
    alone = lambda title: F.coalesce(quantity(title), F.lit(1)) == 1
    done = lambda s: F.when(s.last.isNull(), s["items"]).otherwise(F.concat(s["items"], F.array(s.last)))

    def step(s: Column, line: Column) -> Column:
        state = lambda items, last, title, seller, waits: F.struct(items.alias("items"), last.alias("last"), title.alias("title"), seller.alias("seller"), waits.alias("waits"))
        no, nobody = F.lit(False), F.lit(None).cast("string")
        item = lambda title, seller, total, times: F.struct(title.alias("title"), seller.alias("seller"), total.alias("total"), times.alias("times"))
        price = (line.startswith("$") | line.startswith("-$")) & (s.title != "") & line.rlike(f"^{_MONEY}$")
        footer = line.startswith("Conditions of Use") | line.startswith("©")
        return (
            F.when(s.waits & line.rlike(r"^\d{1,3}$") & alone(s.last.title), state(s["items"], item(s.last.title, s.last.seller, s.last.total, line.cast("int")), s.title, s.seller, no))
            .when(line.startswith("Sold by:") & _found(line, _SELLER).isNotNull(), state(s["items"], s.last, s.title, F.trim(_found(line, _SELLER)), no))
            .when(price, state(done(s), item(s.title, s.seller, _price(line), F.lit(None).cast("int")), F.lit(""), nobody, F.lit(True)))
            .when(s.seller.isNotNull() | footer | line.rlike(_STATUS), state(s["items"], s.last, s.title, s.seller, no))
            .otherwise(state(s["items"], s.last, F.when(s.title == "", line).otherwise(F.concat(s.title, F.lit(" "), line)), s.seller, no))
        )

    def read(x: Column, n: Column) -> Column:
        each = F.when(x.total % F.nullif(n, F.lit(0)) == 0, F.try_divide(x.total, n).cast("long"))
        return F.struct(
            F.trim(F.regexp_replace(x.title, _QUANTITY, "")).alias("title"), x.seller.alias("seller"), F.coalesce(x.times, n, F.lit(1)).alias("quantity"),
            F.when(x.times.isNotNull(), x.total * x.times).otherwise(x.total).alias("total"), F.when(x.times.isNotNull(), x.total).otherwise(F.coalesce(each, x.total)).alias("unit"),
        ).cast(_ITEM)

    start = F.expr(f"named_struct('items', cast(array() as array<{found}>), 'last', cast(null as {found}), 'title', '', 'seller', cast(null as string), 'waits', false)")
    return F.transform(F.aggregate(lines, start, step, done), lambda x: _let(quantity(x.title), lambda n: read(x, n)))


def invoices(files: DataFrame) -> DataFrame:
    """One row per file (file, text): file, state, order_id, order_date, payment_method, card_ending, the amounts in cents, items, problems.

    Text ends with "[LINKS]" and a line for each link, if it has any. Promotions follow from subtotal, shipping and total before tax
    where those are printed. state is ok, no order or no total; problems name sums that don't add up. Items have line_no from 1, title, seller,
    quantity, total, unit and sku: the link that names the item's place, else the link at its place if there are as many links as items.
    """
    parts = files.select("file", F.split("text", r"\[LINKS\]", 2).alias("parts"))
    rows = parts.select("file", F.get("parts", 0).alias("body"), F.filter(F.split(F.coalesce(F.get("parts", 1), F.lit("")), r"\R", -1), lambda x: F.trim(x) != "").alias("links"))
    lines = lines_of(F.col("body"), lambda x: F.trim(x))
    rows = rows.withColumn("lines", lines)
    begins = F.greatest(F.array_position(F.transform("lines", lambda x: x.startswith("Grand Total")), F.lit(True)), F.lit(1)).cast("int") + 1
    amount = {k: F.abs(to_cents(_found(F.col("body"), rf"{label}\s*({_MONEY})"))) for k, label in AMOUNTS.items()}
    rows = rows.select("file", "body", "links", *[v.alias(k) for k, v in amount.items()], item_lines(F.slice("lines", begins, F.greatest(F.size("lines"), F.lit(1)))).alias("found"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    at = F.transform("links", lambda u: F.struct(_found_once(u, _LINK_AT).alias("sku"), _found_once(u, _LINK_AT, 2).cast("int").alias("at")))
    each = F.array_distinct(F.array_compact(F.transform("links", lambda u: _found_once(u, _LINK))))
    rows = rows.select(
        "file", "subtotal", "grand_total", zero("shipping").alias("shipping"), zero("tax").alias("tax"), zero("gift_card").alias("gift_card"), zero("rewards").alias("rewards"),
        F.coalesce(F.col("subtotal") + zero("shipping") - F.col("total_before_tax"), zero("promotions")).alias("promotions"),
        _found(F.col("body"), _ORDER, 2).alias("order_id"), _long_day(_found(F.col("body"), _ORDER)).alias("order_date"),
        _squeeze(_found(F.col("body"), _PAYMENT)).alias("payment_method"), _found(F.col("body"), _PAYMENT, 2).alias("card_ending"), "found", at.alias("placed"), each.alias("each"),
    )
    own = lambda t, i: F.get(F.filter(t.placed, lambda p: p["at"] == i), 0).sku
    sku = lambda t, i: F.coalesce(own(t, i), F.when(F.size(t.each) == F.size(t.found), F.get(t.each, i)))
    items = _let(F.struct("found", "placed", "each"), lambda t: F.transform(t.found, lambda x, i: F.struct((i + 1).alias("line_no"), x.title.alias("title"), x.seller.alias("seller"), x.quantity.alias("quantity"), x.total.alias("total"), x.unit.alias("unit"), sku(t, i).alias("sku"))))
    rows = rows.withColumn("items", items)
    together = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x.total)
    due = F.expr("subtotal + shipping + tax - promotions - gift_card - rewards")
    state = F.when(F.col("order_id").isNull() | F.col("order_date").isNull(), "no order").when(F.col("grand_total").isNull(), "no total").otherwise("ok")
    problems = F.array_compact(F.array(F.when(together != F.col("subtotal"), F.lit("items")), F.when(due != F.col("grand_total"), F.lit("total"))))
    return rows.select("file", state.alias("state"), "order_id", "order_date", "payment_method", "card_ending", "subtotal", "shipping", "tax", "promotions", "gift_card", "rewards", "grand_total", "items", problems.alias("problems"))


def charge_lines(files: DataFrame) -> DataFrame:
    """file, line_no, charge_date, card_name, card_ending, cents, order_ref, occurrence, dedupe_key of every charge on lists (file, text).

    A day's heading holds until the next one; pending sections are skipped up to "Completed". The first order number at or below a charge,
    above the next, is the charge's. Money out prints as a minus and counts as positive. Equal charges of a file get keys of their own.
    """
    lines = files.select("file", F.posexplode(lines_of(F.col("text"), lambda x: F.trim(x))).alias("at", "line"))
    w = Window.partitionBy("file").orderBy("at")
    line = F.col("line")
    turn = F.when(line.rlike(r"(?i)^(?:Pending|In progress)\b"), True).when(line.rlike(r"^Completed\b"), False)
    day = F.when(turn.isNull(), _found(line, _DAY))
    lines = lines.select("*", (turn.isNull() & day.isNull()).alias("plain"), F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False)).alias("pending"), _long_day(F.last(day, ignorenulls=True).over(w)).alias("day"))
    charge = F.col("plain") & ~F.col("pending") & F.col("day").isNotNull() & line.rlike(_CHARGE)
    lines = lines.withColumn("charge", charge).withColumn("line_no", F.sum(F.col("charge").cast("int")).over(w))
    cents = to_cents(F.regexp_extract("line", _CHARGE, 4))
    row = F.when(F.col("charge"), F.struct(F.col("day").alias("charge_date"), _squeeze(F.regexp_extract("line", _CHARGE, 1)).alias("card_name"), F.regexp_extract("line", _CHARGE, 2).alias("card_ending"), F.when(F.regexp_extract("line", _CHARGE, 3) == "-", cents).otherwise(-cents).alias("cents")))
    order = F.when(F.col("plain"), _found(line, _CHARGE_ORDER))
    kept = lines.select("file", "line_no", "at", row.alias("row"), order.alias("order")).filter((F.col("line_no") > 0) & (F.col("row").isNotNull() | F.col("order").isNotNull()))
    folded = kept.groupBy("file", "line_no").agg(F.max("row").alias("row"), F.min_by("order", F.when(F.col("order").isNotNull(), F.col("at"))).alias("order_ref"))
    rows = folded.select("file", "line_no", "row.*", "order_ref")
    return occurrence_keys(rows, ["charge_date", "cents", "order_ref", "card_name", "card_ending"], ["line_no"], "file")


def receipts(files: DataFrame) -> DataFrame:
    """One row per transcript (file, text): file, state, receipt_id, date, warehouse, items, order_discount, subtotal, tax, total, card_type, card_ending, problems.

    Negative or instant-savings lines become the discount of the first item with the number they name, else of the order. state is ok,
    bad (no JSON of this shape) or off (the sums don't add up, so nothing is to be stored).
    """
    rows = files.select("file", F.from_json("text", RECEIPT).alias("r")).select("file", "r.*")
    # What a line is and its cents are worked out once for each line.
    judged = lambda x, cents: F.struct(x.alias("x"), cents.alias("cents"), (F.coalesce(x.is_instant_savings, F.lit(False)) | (cents < 0)).alias("saves"))
    rows = rows.withColumn("items", F.transform("items", lambda x: _let(_amount(x.amount), lambda cents: judged(x, cents))))
    whole = F.coalesce(F.size("items") > 0, F.lit(False)) & F.coalesce(F.forall("items", lambda i: i.cents.isNotNull() & i.x.description.isNotNull() & i.x.taxable.isNotNull()), F.lit(False))
    figures = [_amount(F.col(c)).alias(c) for c in ("subtotal", "tax", "total")]
    bought = F.transform(F.filter("items", lambda i: ~i.saves), lambda i: F.struct(i.x.item_number.alias("item_number"), i.x.description.alias("description"), i.cents.alias("cents"), i.x.taxable.alias("taxable")))
    savings = F.transform(F.filter("items", lambda i: i.saves), lambda i: F.struct(i.x.applies_to_item_number.alias("number"), F.abs(i.cents).alias("cents")))
    rows = rows.select("file", F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).cast("date").alias("date"), _squeeze(F.col("warehouse")).alias("warehouse"), F.coalesce(whole, F.lit(False)).alias("whole"), bought.alias("bought"), savings.alias("savings"), *figures, "tender")
    total = lambda column, keep: F.aggregate(F.filter(column, keep), F.lit(0).cast("long"), lambda a, x: a + x.cents)
    numbers = F.transform("bought", lambda x: x.item_number)
    named = lambda s: F.coalesce(F.array_contains(F.col("numbers"), s.number), F.lit(False))
    rows = rows.withColumn("numbers", numbers)
    first = lambda x, i: F.array_position(F.col("numbers"), x.item_number) == i + 1
    items = F.transform("bought", lambda x, i: F.struct((i + 1).alias("line_no"), x.item_number.alias("item_number"), x.description.alias("description"), x.cents.alias("cents"), x.taxable.alias("taxable"), F.when(F.coalesce(first(x, i), F.lit(False)), total("savings", lambda s: s.number == x.item_number)).otherwise(F.lit(0).cast("long")).alias("discount")))
    rows = rows.select("*", items.alias("items"), total("savings", lambda s: ~named(s)).alias("order_discount"))
    spent = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x.cents - x.discount) - F.col("order_discount")
    problems = F.array_compact(F.array(F.when(spent != F.col("subtotal"), F.lit("items")), F.when(F.expr("subtotal + tax <> total"), F.lit("total"))))
    bad = ~F.col("whole") | F.col("date").isNull() | F.col("warehouse").isNull() | F.expr("subtotal + tax + total is null") | F.col("tender").isNull()
    kind = F.upper(F.col("tender.card_type"))
    names = F.get(F.array(*map(F.lit, CARD_TYPES.values())), (F.array_position(F.array(*map(F.lit, CARD_TYPES)), kind) - 1).cast("int"))
    return rows.select(
        "file", F.when(bad, "bad").when(F.size(problems) > 0, "off").otherwise("ok").alias("state"), F.concat_ws("|", F.col("date").cast("string"), "warehouse", F.col("total").cast("string")).alias("receipt_id"), "date", "warehouse", "items", "order_discount",
        "subtotal", "tax", "total", F.coalesce(names, F.col("tender.card_type")).alias("card_type"), F.col("tender.card_ending").alias("card_ending"), problems.alias("problems"),
    )
