"""Printed statements: cards in three layouts, and the sections of a bank's monthly statement.

A file is one row of text. Its summary is read by patterns over that text, without a shuffle; activity lines are exploded,
and what a line inherits from those above it (whether the table has begun, its section, the cardholder) is carried forward by
windows over the file's lines: one shuffle by file. A statement that lacks a figure is kept with the names of what it lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerkit.functions.money import to_cents

# Labels, headings and line formats as the issuers print them.
_AMOUNT = r"[-+]?\$?(?:\d[\d,]*)?\.\d{2}"  # under a dollar also ".60"
_DOLLARS = r"\$([\d,]+\.\d{2})"
_SIGNED = r"(-?\$[\d,]+\.\d{2})"
_SP = r"[^\S\n]"
FIGURES = ["previous_balance", "payments", "credits", "purchases", "cash_advances", "balance_transfers", "fees", "interest", "new_balance"]
_NAME = r"^[A-Z][A-Z .'-]{2,60}$"


@dataclass(frozen=True)
class Layout:
    """How a card's statement is printed. Figures that a layout doesn't print are 0; patterns have their value as group 1."""

    marks: tuple[str, str]  # the first as printed, the second in any case
    figures: dict[str, str]
    period: str
    due: str
    minimum: str
    line: str
    sections: dict[str, str]
    products: tuple[str, ...]


A = Layout(
    ("Opening/Closing Date", "chase.com"),
    {
        name: rf"(?m)^{label}{_SP}+({_AMOUNT})$"
        for name, label in {
            "previous_balance": "Previous Balance",
            "payments": "Payment, Credits",
            "purchases": "Purchases",
            "cash_advances": "Cash Advances",
            "balance_transfers": "Balance Transfers",
            "fees": "Fees Charged",
            "interest": "Interest Charged",
            "new_balance": "New Balance",
        }.items()
    },
    rf"Opening/Closing Date{_SP}+(\d{{2}}/\d{{2}}/\d{{2,4}}){_SP}*-{_SP}*(\d{{2}}/\d{{2}}/\d{{2,4}})",
    rf"Payment Due Date:?{_SP}+(\d{{2}}/\d{{2}}/\d{{2,4}})",
    rf"Minimum Payment Due:?{_SP}+({_AMOUNT})",
    rf"^(\d{{2}})/(\d{{2}})\s+(.+?)\s+({_AMOUNT})$",
    {s: s for s in ("PAYMENTS AND OTHER CREDITS", "PURCHASE", "PURCHASES", "CASH ADVANCES", "BALANCE TRANSFERS", "FEES CHARGED", "INTEREST CHARGED", "ADJUSTMENTS")},
    ("PRIME VISA", "SAPPHIRE RESERVE", "FREEDOM UNLIMITED"),
)
B = Layout(
    ("Billing Period:", "citi"),
    {
        "previous_balance": rf"Previous balance{_SP}+{_DOLLARS}",
        "payments": rf"Payments{_SP}+-{_DOLLARS}",
        "credits": rf"Credits{_SP}+-{_DOLLARS}",
        "purchases": rf"Purchases{_SP}+\+{_DOLLARS}",
        "cash_advances": rf"Cash advances{_SP}+\+{_DOLLARS}",
        "fees": rf"Fees{_SP}+\+{_DOLLARS}",
        "interest": rf"Interest{_SP}+\+{_DOLLARS}",
        "new_balance": rf"New balance{_SP}+{_DOLLARS}",
    },
    rf"Billing Period:{_SP}*(\d{{2}}/\d{{2}}/\d{{2}}){_SP}*-{_SP}*(\d{{2}}/\d{{2}}/\d{{2}})",
    rf"Payment due date:{_SP}*(\d{{2}}/\d{{2}}/\d{{2,4}})",
    rf"Minimum payment due:{_SP}*{_DOLLARS}",
    rf"^(\d{{2}})/(\d{{2}})(?:\s+\d{{2}}/\d{{2}})?\s+(.+?)\s+{_SIGNED}$",
    {"Payments, Credits and Adjustments": "PAYMENTS AND OTHER CREDITS", "Standard Purchases": "PURCHASE"},
    ("COSTCO ANYWHERE",),
)
C = Layout(
    ("Account Ending", "americanexpress.com"),
    {
        "previous_balance": rf"Previous Balance{_SP}+{_DOLLARS}",
        "payments": rf"Payments/Credits{_SP}+-{_DOLLARS}",
        "purchases": rf"New Charges{_SP}+\+{_DOLLARS}",
        "fees": rf"Fees{_SP}+\+{_DOLLARS}",
        "interest": rf"Interest Charged{_SP}+\+{_DOLLARS}",
        "new_balance": rf"New Balance{_SP}+=?{_SP}*{_DOLLARS}",
    },
    r"Closing Date\s*(\d{2}/\d{2}/\d{2})",
    r"Payment Due Date\s*(\d{2}/\d{2}/\d{2})",
    rf"Minimum Payment Due\s*{_DOLLARS}",
    rf"^(\d{{2}})/(\d{{2}})/\d{{2}}\*?\s+(.+?)\s+{_SIGNED}⧫?$",
    {"Payments": "PAYMENTS AND OTHER CREDITS", "Credits": "CREDITS", "New Charges": "PURCHASE", "Fees": "FEES CHARGED", "Interest Charged": "INTEREST CHARGED"},
    ("PLATINUM CARD", "GOLD CARD"),
)
LAYOUTS = {"a": A, "b": B, "c": C}
_ORDER_MARKS = ("Order placed", "Order #")
_HEADING = r"(?i)^(.+?):\s*X+(\d{2,4})(?:\s*\(Continued\))?\s*$"
_MONEY = r"(-?\$-?[\d,]+\.\d{2})$"
BANK_FIGURES = {
    "begins": rf"^(\d{{2}}/\d{{2}}/\d{{2}})\s+Beginning Balance\s+{_MONEY}",
    "ends": rf"^(\d{{2}}/\d{{2}}/\d{{2}})\s+Ending Balance\s+{_MONEY}",
    "opening": rf"^Previous Balance as of \S+ is {_MONEY}",
    "deposits": rf"^Total Deposits {_MONEY}",
    "withdrawals": rf"^Total Withdrawals {_MONEY}",
    "dividends": rf"^Total Dividends Earned {_MONEY}",
    "closing": rf"^Ending Balance as of \S+ is {_MONEY}",
}
# End of the fixed values.


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text of the text files below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def single(token: Column) -> Column:
    """A token of four or more characters whose characters all come in pairs (bold print) loses the second of each."""
    return F.when(token.rlike(r"^(?:(.)\1){2,}$"), F.regexp_replace(token, r"(.)\1", "$1")).otherwise(token)


def clean_line(line: Column) -> Column:
    """A printed line without stray backticks, outer space and doubled print."""
    bare = F.regexp_replace(F.regexp_replace(line, "`", ""), r"^\s+|\s+$", "")
    return F.array_join(F.transform(F.split(bare, " ", -1), single), " ")


def lines_of(text: Column, clean=clean_line) -> Column:
    """The lines of a text with page breaks, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\R|[\x1C-\x1E]", -1), clean), lambda x: x != "")


def text_kind(text: Column) -> Column:
    """What a text file is by its own words: invoice, a, b or c for a card's statement, null for none."""
    holds = lambda c, *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    kind = F.when(holds(text, *_ORDER_MARKS), "invoice")
    for name, layout in LAYOUTS.items():
        kind = kind.when(F.contains(text, F.lit(layout.marks[0])) & F.contains(F.lower(text), F.lit(layout.marks[1])), name)
    return kind


def _mdy(c: Column) -> Column:
    """``M/D/YY`` or ``M/D/YYYY``; a day that doesn't exist is null."""
    year = F.regexp_extract(c, r"(\d+)$", 1)
    full = F.concat(F.regexp_extract(c, r"^(.*/)\d+$", 1), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year))
    return F.try_to_timestamp(full, F.lit("MM/dd/yyyy")).cast("date")


def _found(text: Column, pattern: str | Column, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    found = F.regexp_extract(text, pattern, group) if isinstance(pattern, str) else F.call_function("regexp_extract", text, pattern, F.lit(group))
    return F.nullif(found, F.lit(""))


def _of_layout(value) -> Column:
    """``value(layout)``, a pattern or name, of the row's own layout; null for none. One expression then reads all layouts."""
    out = F.lit(None).cast("string")
    for name, layout in reversed(LAYOUTS.items()):
        out = F.when(F.col("layout") == name, F.lit(value(layout))).otherwise(out)
    return out


def card_statements(files: DataFrame) -> DataFrame:
    """One row per card statement among ``files`` (file, text): file, layout, state, missing, period_start, period_end, due_date, minimum_due,
    the figures in cents, math_delta, products, lines.

    state is ``ok`` or ``incomplete``; ``missing`` names what isn't printed. Layout a prints payments and credits as one figure, as does c.
    """
    kept = files.select("file", F.col("text").alias("printed"), lines_of(F.col("text")).alias("lines"), text_kind(F.col("text")).alias("layout")).filter(F.col("layout").isin(*LAYOUTS))
    kept = kept.withColumn("text", F.array_join("lines", "\n"))
    # Of several summary blocks, the one of the whole account counts.
    total = _found(F.col("text"), r"(?s)((?:^|(?<=\n))[^\n]*Account Total.*)")
    kept = kept.withColumn("body", F.when(F.col("layout") == "c", F.coalesce(total, F.col("text"))).otherwise(F.col("text")))
    c = F.col("layout") == "c"
    kept = kept.withColumns({f"p_{n}": _of_layout(lambda x, n=n: x.figures.get(n)) for n in FIGURES})
    # The strings first, then what they mean, so that each is looked for once.
    looked = lambda of, where="text", group=1: F.call_function("regexp_extract", F.col(where), of, F.lit(group))
    kept = kept.select(
        "file", "layout", "lines", *[F.when(F.col(f"p_{n}").isNotNull(), looked(F.col(f"p_{n}"), "body")).alias(n) for n in FIGURES], looked(_of_layout(lambda x: x.period)).alias("first"),
        F.when(~c, looked(F.when(c, B.period).otherwise(_of_layout(lambda x: x.period)), group=2)).alias("second"), F.regexp_extract("text", r"Days in Billing Period:\s*(\d+)", 1).alias("days"),
        looked(_of_layout(lambda x: x.due)).alias("due"), looked(_of_layout(lambda x: x.minimum)).alias("minimum"), F.upper("printed").alias("printed"),
    )
    products = F.split(_of_layout(lambda x: "|".join(x.products)), r"\|")
    rows = kept.select(
        "file", "layout", "lines", _mdy(F.col("first")).alias("first"), _mdy(F.col("second")).alias("second"), F.col("days").try_cast("int").alias("days"), _mdy(F.col("due")).alias("due_date"), F.abs(to_cents(F.col("minimum"))).alias("minimum_due"),
        *[F.when(F.col(n).isNull(), F.lit(0).cast("long")).otherwise(F.abs(to_cents(F.col(n)))).alias(n) for n in FIGURES], F.filter(products, lambda p: F.contains(F.col("printed"), p)).alias("products"),
    )
    rows = rows.withColumns({"period_start": F.when(c, F.date_sub("first", F.col("days") - 1)).otherwise(F.col("first")), "period_end": F.when(c, F.col("first")).otherwise(F.col("second"))})
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in FIGURES], F.when(F.col("period_start").isNull() | F.col("period_end").isNull(), F.lit("period"))))
    rows = rows.withColumn("missing", missing).withColumn("state", F.when(F.size("missing") == 0, "ok").otherwise("incomplete"))
    delta = F.expr("previous_balance - payments - credits + purchases + cash_advances + balance_transfers + fees + interest - new_balance")
    return rows.select("file", "layout", "state", "missing", "period_start", "period_end", "due_date", "minimum_due", *FIGURES, delta.alias("math_delta"), "products", "lines")


def activity_lines(statements: DataFrame) -> DataFrame:
    """file, layout, line_no, section, txn_date, description, cents, order_ref, holder of the activity of ``card_statements``.

    Lines of a and b print no year: a month after the closing month belongs to the year before. A day that doesn't exist is null.
    """
    lines = statements.select("file", "layout", "period_end", F.posexplode(F.when(F.col("state") == "ok", F.col("lines"))).alias("at", "line"))
    a, b, c = (F.col("layout") == k for k in "abc")
    line, upper = F.col("line"), F.upper("line")
    w = Window.partitionBy("file").orderBy("at")
    carried = lambda value: F.last(value, ignorenulls=True).over(w)
    so_far = lambda flag: F.coalesce(F.max(flag).over(w), F.lit(False))

    opens = F.when(a, (line == "ACCOUNT ACTIVITY") | line.startswith("ACCOUNT ACTIVITY ")).when(b, line.startswith("Date Date Description"))
    opens = opens.otherwise(line.startswith("Detail") & (F.contains(line, F.lit("posting date")) | F.contains(line, F.lit("Pay Over Time"))))
    closes = F.when(a, line.rlike("Totals Year-to-Date|INTEREST CHARGES")).when(b, line.rlike("^(?:Fees Charged|TOTAL FEES|Interest charge calculation)")).otherwise(line.rlike(r"^(?:\d{4} Fees and Interest Totals|Interest Charge Calculation)"))
    lines = lines.select("*", opens.alias("opens"), closes.alias("closes"), F.lag("line").over(w).alias("before"))
    lines = lines.withColumn("begun", so_far(F.col("opens")))
    # a may close and open again; b ends at the first close after it began, c at the first close at all.
    ended = so_far(F.col("closes") & ~F.col("opens") & (c | F.col("begun")))
    table = F.when(a, F.coalesce(carried(F.when(F.col("opens"), True).when(F.col("closes"), False)), F.lit(False))).otherwise(~ended)
    lines = lines.withColumn("table", table).withColumn("inside", F.col("table") & F.col("begun") & ~(F.col("opens") & ~c))

    heading = F.trim(F.regexp_replace("line", " Amount$", ""))
    section = lambda layout, of: F.get(F.array(*map(F.lit, layout.sections.values())), (F.array_position(F.array(*map(F.lit, layout.sections)), of) - 1).cast("int"))
    bare = line.endswith("Amount") | heading.isin("New Charges", "Fees", "Interest Charged")
    named = F.when(a & F.col("inside"), section(A, upper)).when(b & F.col("inside"), section(B, line)).when(c & F.col("table") & bare, section(C, heading))
    lines = lines.withColumn("named", named)
    pattern = _of_layout(lambda x: x.line)
    activity = _found(line, pattern).isNotNull()
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    plain = F.col("named").isNull()
    card = _found(line, r"^([A-Z][A-Z .'-]+?)\s+TRANSACTIONS THIS CYCLE\b")
    holder = F.when(a & F.col("inside") & plain, squeeze(card)).when(b & F.col("inside") & plain & (line != "No Activity") & ~activity & line.rlike(_NAME), squeeze(line))
    holder = holder.when(c & F.col("table") & plain & line.startswith("Card Ending") & F.col("before").rlike(_NAME), squeeze(F.col("before")))
    order = F.when(a & F.col("inside") & plain & card.isNull(), _found(line, r"^Order Number\s+(\S+)"))
    lines = lines.select("*", carried(F.col("named")).alias("section"), holder.alias("held"), carried(holder).alias("holder"), order.alias("order"))
    counts = activity & F.col("inside") & plain & F.col("held").isNull() & F.col("order").isNull() & (~c | F.col("section").isNotNull())
    lines = lines.withColumn("counts", counts).withColumn("line_no", F.sum(F.col("counts").cast("int")).over(w))

    kept = lines.filter((F.col("counts") | F.col("order").isNotNull()) & (F.col("line_no") > 0))
    part = lambda i: F.when(F.col("counts"), F.call_function("regexp_extract", F.col("line"), pattern, F.lit(i)))
    kept = kept.select("file", "layout", "line_no", "at", "order", "counts", "period_end", F.coalesce("section", F.lit("UNKNOWN")).alias("section"), "holder", part(1).cast("int").alias("month"), part(2).cast("int").alias("day"), part(3).alias("text"), part(4).alias("amount"), F.when(c, F.substring("line", 7, 2).try_cast("int")).alias("yy"))
    year = F.when(F.col("yy").isNotNull(), F.col("yy") + 2000).otherwise(F.year("period_end") - (F.col("month") > F.month("period_end")).cast("int"))
    on = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, F.col("month"), F.col("day")), F.lit("yyyy-MM-dd")).cast("date")
    holder_of = F.when((F.col("layout") == "a") | (F.col("section") == "PURCHASE"), F.col("holder"))
    row = F.when(F.col("counts"), F.struct("section", on.alias("txn_date"), F.trim("text").alias("description"), to_cents(F.col("amount")).alias("cents"), holder_of.alias("holder")))
    # An order number belongs to the line above it; of several the last counts.
    folded = kept.select("file", "layout", "line_no", "at", row.alias("row"), "order").groupBy("file", "layout", "line_no").agg(F.max("row").alias("row"), F.max_by("order", F.when(F.col("order").isNotNull(), F.col("at"))).alias("order_ref"))
    return folded.select("file", "layout", "line_no", "row.section", "row.txn_date", "row.description", "row.cents", "order_ref", "row.holder")


def judged(statements: DataFrame, expected: DataFrame, stored: DataFrame) -> DataFrame:
    """``statements`` with verdict and problems. expected: file, card, product, period_end as a manifest states them; stored: card, period_end.

    The document wins over the manifest: another period is used with a note, another product is refused. verdict is store, stored (already),
    refused or incomplete; of two files of a card and period the first by name is stored. Figures that don't add up are noted.
    """
    rows = statements.join(expected.withColumnRenamed("period_end", "stated_end"), "file").join(stored.select("card", "period_end", F.lit(True).alias("known")), ["card", "period_end"], "left")
    wrong = (F.size("products") > 0) & ~F.exists("products", lambda p: F.contains(F.upper("product"), p))
    verdict = F.when(F.col("state") != "ok", "incomplete").when(wrong, "refused").when(F.col("known"), "stored").otherwise("store")
    first = F.row_number().over(Window.partitionBy("card", "period_end", "verdict").orderBy("file"))
    rows = rows.withColumn("verdict", verdict)
    rows = rows.withColumn("verdict", F.when((F.col("verdict") == "store") & (first > 1), "stored").otherwise(F.col("verdict")))
    notes = F.array_compact(F.array(F.when(wrong, F.lit("another product")), F.when(F.col("stated_end") != F.col("period_end"), F.lit("another period")), F.when(F.col("math_delta") != 0, F.lit("math"))))
    return rows.drop("known").withColumn("problems", notes)


def bank_statements(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """file, account, state, missing, ending, period_start, period_end, opening, deposits, withdrawals, closing, math_delta of an account's section.

    files: file, text, account; accounts: account, names (as headings print them), ending (of the number; empty for any). A heading that isn't the
    account's, or the end of the statement, ends its section; "(Continued)" resumes it. deposits include dividends. state is ok, incomplete or no section.
    """
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    names = F.array_except(F.transform("names", lambda n: squeeze(F.upper(n))), F.array(F.lit("")))
    lines = files.join(accounts.select("account", names.alias("names"), F.coalesce("ending", F.lit("")).alias("wanted")), "account")
    lines = lines.select("file", "account", "names", "wanted", F.posexplode_outer(lines_of(F.col("text"), squeeze)).alias("at", "line"))
    w = Window.partitionBy("file", "account").orderBy("at")
    line = F.coalesce("line", F.lit(""))
    number = _found(line, _HEADING, 2)
    own = F.array_contains("names", squeeze(F.upper(F.regexp_extract(line, _HEADING, 1)))) & number.endswith(F.col("wanted"))
    turn = F.when(number.isNotNull(), own).when(F.upper(line).startswith("END OF STATEMENT"), False)
    lines = lines.select("file", "account", "at", line.alias("line"), F.when(own, number).alias("ending"), number.isNull().alias("plain"), F.coalesce(F.last(turn, ignorenulls=True).over(w), F.lit(False)).alias("current"))
    shown = F.col("plain") & F.col("current")
    first = lambda name, group: F.min_by(F.when(shown, _found(F.col("line"), BANK_FIGURES[name], group)), F.when(shown & F.col("line").rlike(BANK_FIGURES[name]), F.col("at"))).alias(name)
    found = lines.groupBy("file", "account").agg(F.max_by("ending", F.when(F.col("ending").isNotNull(), F.col("at"))).alias("ending"), *[first(n, 1) for n in BANK_FIGURES])
    needed = [n for n in BANK_FIGURES if n != "dividends"]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in needed]))
    state = F.when(F.col("ending").isNull(), "no section").when(F.size(missing) > 0, "incomplete").otherwise("ok")
    money = {n: to_cents(F.col(n)) for n in ("opening", "withdrawals", "closing")} | {"deposits": to_cents(F.col("deposits")) + F.coalesce(to_cents(F.col("dividends")), F.lit(0))}
    rows = found.select("file", "account", state.alias("state"), missing.alias("missing"), "ending", _mdy(F.col("begins")).alias("period_start"), _mdy(F.col("ends")).alias("period_end"), *[money[n].alias(n) for n in ("opening", "deposits", "withdrawals", "closing")])
    return rows.withColumn("math_delta", F.expr("opening + deposits - withdrawals - closing"))
