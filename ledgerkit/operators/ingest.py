"""Idempotent ingestion: stable keys, insert-missing, gates, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_keys(rows: DataFrame, identity: Sequence[str], order: Sequence[str], file: str | None = None) -> DataFrame:
    """``occurrence`` (from 0, among equal rows of a file) and ``dedupe_key`` = sha256 of identity and occurrence.

    Two equal rows of a file get two keys; the same rows read again get the same keys.
    """
    by = [*identity, file] if file else list(identity)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity], F.col("occurrence").cast("string"))
    return rows.withColumn("occurrence", nth).withColumn("dedupe_key", F.sha2(text, 256))


def insert_missing(new: DataFrame, stored: DataFrame, key: str = "dedupe_key") -> DataFrame:
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def new_files(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files (with ``content``) whose bytes haven't been imported, each content once."""
    return files.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"]).join(imported.select("sha256"), "sha256", "left_anti")


def last_write_wins(writes: DataFrame, key: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """The last value of each key; a null value deletes the key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return writes.withColumn("__n", F.row_number().over(w)).filter((F.col("__n") == 1) & F.col(value).isNotNull()).drop("__n")


def coverage_gaps(rows: DataFrame, requested: DataFrame, slack: int = 10) -> DataFrame:
    """Accounts whose first row comes more than ``slack`` days after the start asked for."""
    first = rows.groupBy("account").agg(F.min("day").alias("first_day"))
    return requested.join(first, "account").withColumn("gap", F.datediff("first_day", "start")).filter(F.col("gap") > slack).select("account", "start", "first_day", "gap")


def gate(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``problems``: names of the checks a row fails (a null check fails). Accepted rows have none."""
    failed = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]
    return rows.withColumn("problems", F.array_compact(F.array(*failed)))


def statement_math(s: str = "") -> Column:
    """Previous balance and the period's parts give the new balance."""
    c = lambda n: F.col(s + n)
    return c("previous_balance") - c("payments") - c("credits") + c("purchases") + c("cash_advances") + c("balance_transfers") + c("fees") + c("interest") == c("new_balance")
