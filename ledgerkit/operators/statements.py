"""Statement lines and the rows that exports have for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions.text import clean_description, normalize_raw
from ledgerkit.operators.classify import card_row_type
from ledgerkit.operators.matching import candidates, greedy, similar_descriptions

SLACK_DAYS = 3


def link_lines(lines: DataFrame, rows: DataFrame, slack: int = SLACK_DAYS) -> DataFrame:
    """line_id, row_id: statement lines in order of (period_end, line_no) take the nearest free row of their card with equal cents and a like description.

    lines: id, card, period_end, line_no, day, cents, text; rows: id, card, day, cents, text.
    """
    raw = lambda df: df.withColumn("raw", normalize_raw(F.col("text"))).withColumn("clean", clean_description(F.col("text")))
    alike = similar_descriptions(F.col("l_raw"), F.col("r_raw")) | (F.col("l_clean") == F.col("r_clean"))
    pairs = candidates(raw(lines), raw(rows), ["card", "cents"], -slack, slack, alike)
    return greedy(pairs, ["l_card", "l_cents"], ["l_period_end", "l_line_no"]).select(F.col("l_id").alias("line_id"), F.col("r_id").alias("row_id"))


def rows_of_lines(lines: DataFrame, links: DataFrame) -> DataFrame:
    """Rows for the lines that no export has: dedupe_key, card, day, cents, text, type, needs_review. Lines have a section."""
    left = lines.join(links.select(F.col("line_id").alias("id")), "id", "left_anti")
    key = F.sha2(F.concat_ws("|", F.lit("stmt"), "card", F.col("period_end").cast("string"), F.col("line_no").cast("string")), 256)
    kind = card_row_type(F.col("text"), F.lit(None).cast("string"), F.col("cents"))
    fixed = F.when(F.col("section") == "FEES CHARGED", "fee").when(F.col("section") == "INTEREST CHARGED", "interest").when(F.col("section") == "CREDITS", F.when(F.upper("text").rlike(r"\bCREDIT\b"), "credit").otherwise("refund"))
    return left.select(key.alias("dedupe_key"), "card", "day", "cents", "text", F.coalesce(fixed, kind["type"]).alias("type"), (fixed.isNull() & kind["needs_review"]).alias("needs_review"))
