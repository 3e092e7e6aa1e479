"""Activity exports of cards and checking accounts: CSV in four layouts, told apart by their header, as one table of rows.

A file is read whole (an export is small; there may be many) and exploded to lines, so that its header decides for its own
lines and every row keeps its place. Nothing is dropped silently: ``state`` says what became of each line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.functions.money import to_cents
from ledgerkit.functions.text import clean_description
from ledgerkit.operators.classify import card_row_type

# The headers of the layouts.
LAYOUT_A = ["Transaction Date", "Post Date", "Description", "Category", "Type", "Amount", "Memo"]
LAYOUT_B = ["Status", "Date", "Description", "Debit", "Credit", "Member Name"]
LAYOUT_C = ["Date", "Description", "Amount"]  # at least these
CHECKING = ["Transaction ID", "Posting Date", "Effective Date", "Transaction Type", "Posting Status", "Amount", "Check Number", "Reference Number", "Description", "Transaction Category", "Type", "Balance", "Memo", "Extended Description"]

#: A comma that stands outside of quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def fields(line: Column) -> Column:
    """Fields of a CSV line, trimmed, without their quotes."""
    bare = lambda f: F.when(f.rlike(r'^\s*".*"\s*$'), F.regexp_replace(F.regexp_replace(f, r'^\s*"|"\s*$', ""), '""', '"')).otherwise(f)
    return F.transform(F.split(line, _COMMA, -1), lambda f: F.trim(bare(f)))


def layout(header: Column) -> Column:
    """a, b, c or checking by a file's header; null for none of them."""
    same = lambda names: header == F.array(*map(F.lit, names))
    flexible = F.forall(F.array(*map(F.lit, LAYOUT_C)), lambda n: F.array_contains(header, n)) & ~F.array_contains(header, "Post Date") & ~F.array_contains(header, "Status")
    return F.when(same(CHECKING), "checking").when(same(LAYOUT_A), "a").when(same(LAYOUT_B), "b").when(flexible, "c")


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """file, line (the header is line 1), header, fields, layout of every line with text below a header."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return with_headers(files.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("at", "value")))


def with_headers(lines: DataFrame) -> DataFrame:
    """As ``read_exports`` from lines (file, at from 0, value)."""
    header = lines.filter("at = 0").select("file", fields(F.col("value")).alias("header"))
    rows = lines.filter("at > 0 and trim(value) <> ''").join(header, "file")
    return rows.select("file", (F.col("at") + 1).alias("line"), "header", fields(F.col("value")).alias("fields"), layout(F.col("header")).alias("layout"))


#: One amount and an empty field beside it; unquoted thousands commas may have cut the amount into several fields.
_DEBIT, _CREDIT = r"^([^,]+(?:,[^,]+)*),$", r"^,([^,]+(?:,[^,]+)*)$"


def mended(row: Column) -> Column:
    """Fields of a layout B line with debit and credit in one field each. Null where two of them can't be told apart."""
    amounts = F.array_join(F.slice(row, 4, F.size(row) - 4), ",")
    debit, credit = F.regexp_extract(amounts, _DEBIT, 1), F.regexp_extract(amounts, _CREDIT, 1)
    whole = F.concat(F.slice(row, 1, 3), F.array(debit, credit), F.slice(row, -1, 1))
    return F.when(F.size(row) == 6, row).when((F.size(row) > 6) & ((debit == "") != (credit == "")), whole)


def bank_type(kind: Column, extended: Column) -> Column:
    """``type|kind`` in lower case, without digits and number signs."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.lower(F.concat(squeeze(F.coalesce(kind, F.lit(""))), F.lit("|"), squeeze(F.regexp_replace(F.coalesce(extended, F.lit("")), r"[#\d]+", " "))))


def export_rows(lines: DataFrame) -> DataFrame:
    """Rows of exports: file, line, layout, state, txn_date, post_date, cents (out positive), description, description_clean, type,
    needs_review, category, memo, member, bank_type, balance.

    state: posted, pending (no post date, or its status says so), empty (no amount), bad (a field that can't be read, or an unknown layout).
    Layout a prints money out as negative, as does checking; b has a column for each side; c has the sign already.
    """
    rows = lines.withColumn("cells", F.when(F.col("layout") == "b", mended(F.col("fields"))).otherwise(F.col("fields")))
    rows = rows.withColumn("cells", F.when(F.col("layout").isNotNull() & (F.size("cells") >= F.size("header")), F.col("cells")))

    def cell(name: str) -> Column:
        return F.get("cells", (F.array_position("header", name) - 1).cast("int"))

    def by(a, b, c, checking) -> Column:
        """The cell (or column) of the row's layout; null where it is blank."""
        k, pick = F.col("layout"), lambda x: cell(x) if isinstance(x, str) else F.lit(x)
        value = F.when(k == "a", pick(a)).when(k == "b", pick(b)).when(k == "c", pick(c)).when(k == "checking", pick(checking))
        return F.when(value != "", value)

    # Cells by their meaning first, so that each is looked up once.
    rows = rows.select(
        "file", "line", "layout", F.col("cells").isNull().alias("unread"), by("Amount", "Debit", "Amount", "Amount").alias("amount"), by(None, "Credit", None, None).alias("credit"),
        by("Post Date", "Date", "Date", "Posting Date").alias("posted_on"), by("Transaction Date", "Date", "Date", "Effective Date").alias("done_on"), F.lower(by(None, "Status", None, "Posting Status")).alias("status"),
        F.coalesce(by("Description", "Description", "Description", "Description"), F.lit("")).alias("description"), by("Type", None, None, "Type").alias("kind"), by(None, None, None, "Extended Description").alias("extended"),
        by("Category", None, None, "Transaction Category").alias("category"), by("Memo", None, None, None).alias("memo"), by(None, "Member Name", "Card Member", None).alias("member"), by(None, None, None, "Balance").alias("balance"),
    )
    k, date = F.col("layout"), lambda c: F.try_to_timestamp(F.col(c), F.lit("M/d/yyyy")).cast("date")
    plain = to_cents(F.coalesce("amount", "credit"))
    rows = rows.withColumns({"plain": plain, "txn_date": date("done_on"), "post_date": date("posted_on"), "description": F.when(k == "c", F.regexp_replace("description", r"\s+", " ")).otherwise(F.col("description"))})
    side = F.when(k == "c", F.col("plain")).when(k == "b", F.when(F.col("amount").isNotNull(), F.abs("plain")).otherwise(-F.abs("plain"))).otherwise(-F.col("plain"))
    rows = rows.withColumn("cents", side)
    pending = F.when(k == "a", F.col("posted_on").isNull()).when(k == "b", F.coalesce(F.col("status") == "pending", F.lit(False))).when(k == "checking", F.coalesce(F.col("status") != "posted", F.lit(True))).otherwise(False)
    unread = F.col("post_date").isNull() | F.col("cents").isNull()
    state = F.when(F.col("unread"), "bad").when(pending, "pending").when(F.coalesce("amount", "credit").isNull(), "empty").when(unread, "bad").otherwise("posted")
    checking = k == "checking"
    rows = rows.withColumns({"state": state, "x": card_row_type(F.col("description"), F.when(k == "a", F.col("kind")), F.col("cents"))})
    return rows.select(
        "file", "line", "layout", "state", "txn_date", "post_date", "cents", "description", clean_description(F.col("description")).alias("description_clean"),
        F.when(checking, F.when(F.col("cents") > 0, "purchase").otherwise("deposit")).otherwise(F.col("x.type")).alias("type"), F.when(checking, False).otherwise(F.col("x.needs_review")).alias("needs_review"),
        "category", "memo", "member", F.when(checking, bank_type(F.col("kind"), F.col("extended"))).alias("bank_type"), to_cents(F.col("balance")).alias("balance"),
    )
