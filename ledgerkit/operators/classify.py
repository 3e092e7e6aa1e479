"""Ordered first-match classification, overrides, memo tables, merchant dimension, links."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions.bounds import config_table


@dataclass(frozen=True)
class Rule:
    """A user rule precedes seed rules; then priority, then id. ``anchored`` patterns match at the start."""

    id: int
    pattern: str
    target: str
    priority: int = 100
    user: bool = False
    anchored: bool = True
    money_in_only: bool = False


def ordered(rules: Sequence[Rule]) -> list[Rule]:
    for r in rules:
        re.compile(r.pattern)  # a rule that doesn't compile is refused before a plan is built
    return sorted(rules, key=lambda r: (not r.user, r.priority, r.id))


def first_match(rules: Sequence[Rule], text: Column, cents: Column | None = None) -> Column:
    """Struct (rule, target) of the first rule that matches, else null: one CASE with literal patterns."""
    out = None
    for r in ordered(rules):
        hit = text.rlike(f"(?i)^(?:{r.pattern})" if r.anchored else f"(?i)(?:{r.pattern})")
        if r.money_in_only and cents is not None:
            hit = hit & (cents < 0)
        value = F.struct(F.lit(r.id).alias("rule"), F.lit(r.target).alias("target"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("struct<rule:int,target:string>") if out is None else out


# The wordings that give a card row its type.
PAYMENT = r"\b(PAYMENT|AUTOPAY|AUTO PAY|THANK YOU)\b"
PAYMENT_BACK = r"\b(PAYMENT REVERSAL|RETURNED PAYMENT|CREDIT BALANCE REFUND)\b"
INTEREST = r"\bINTEREST\b"
FEE = r"\b(ANNUAL (MEMBERSHIP )?FEE|LATE FEE|FOREIGN TRANSACTION FEE|FOREIGN TRANS FEE|RETURNED PAYMENT FEE|BALANCE TRANSFER FEE|CASH ADVANCE FEE)\b"
REWARD = r"\b(REDEMPTION|REWARDS?|CASH BACK|POINTS)\b"
CREDIT = r"\b(STATEMENT CREDIT|CREDIT)\b"


def card_row_type(text: Column, issuer_type: Column, cents: Column) -> Column:
    """Struct (type, needs_review) of a card row, by sign (positive is money out), wording and the issuer's own type.

    Money in that nothing explains is a credit to review; 0 cents count as money in.
    """
    words, issuer = F.upper(text), F.lower(F.trim(F.coalesce(issuer_type, F.lit(""))))
    says = words.rlike
    out = (
        F.when((issuer == "reversal") | (says(PAYMENT_BACK) & ~says(FEE)), "payment")
        .when(says(INTEREST) & (issuer.isin("fee", "") | words.contains("CHARGE")), "interest")
        .when((issuer == "fee") | says(FEE), "fee")
        .when(issuer == "adjustment", "adjustment")
        .otherwise("purchase")
    )
    back = (
        F.when((issuer == "payment") | says(PAYMENT), "payment")
        .when(issuer == "return", "refund")
        .when(says(REWARD), "reward")
        .when(issuer == "adjustment", "adjustment")
        .when(says(CREDIT), "credit")
    )
    return F.struct(F.when(cents > 0, out).otherwise(F.coalesce(back, F.lit("credit"))).alias("type"), ((cents <= 0) & back.isNull()).alias("needs_review"))


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, field: str, into: str) -> DataFrame:
    """The last override of a key and field wins over the computed value."""
    w = Window.partitionBy("target_key").orderBy(F.desc("created_at"), F.desc("id"))
    last = overrides.filter(F.col("field") == field).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(F.col("target_key").alias(key), F.col("value").alias("__value"))
    out = rows.join(last, key, "left")
    return out.withColumn(into, F.coalesce("__value", into)).withColumn("overridden", F.col("__value").isNotNull()).drop("__value")


def precedence(*sources: tuple[str, Column]) -> Column:
    """Struct (value, source) of the first source that gives a value."""
    return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.cast("string").alias("value"), F.lit(name).alias("source"))) for name, v in sources])


def merchant_dimension(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert by name: the first transaction of a name sets group and category; values that are there replace stored ones."""
    w = Window.partitionBy("name").orderBy("id")
    first = seen.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("name", F.col("grp").alias("__grp"), F.col("category").alias("__category"))
    return stored.join(first, "name", "full").select("name", F.coalesce("__grp", "grp").alias("grp"), F.coalesce("__category", "category").alias("category"))


def memo_misses(rows: DataFrame, memo: DataFrame, key: str, version: str) -> DataFrame:
    """Distinct keys that no answer of this version covers: what a classifier would be asked."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().join(memo.filter(F.col("version") == version).select(key), key, "left_anti")


def apply_labels(rows: DataFrame, labels: DataFrame, key: str, least: float = 0.7) -> DataFrame:
    """Labels joined on; a row goes to review when its label is missing, unsure or uncategorized."""
    out = rows.join(labels.select(key, "label", "confidence"), key, "left")
    unsure = F.col("label").isNull() | (F.col("confidence") < least) | (F.col("label") == "uncategorized")
    return out.withColumn("needs_review", unsure)


def attribute_person(rows: DataFrame, names: DataFrame, name: Column) -> DataFrame:
    """Member names to people; an empty name is the owner; an unknown one is null and goes to review."""
    known = names.select(F.col("name").alias("__name"), "person")
    out = rows.withColumn("__name", name).join(known, "__name", "left")
    empty = F.coalesce(F.col("__name"), F.lit("")) == ""
    return out.withColumn("person", F.when(empty, "self").otherwise(F.col("person"))).withColumn("needs_review", ~empty & F.col("person").isNull()).drop("__name")


def rule_preview(rows: DataFrame, pattern: str, text: str, n: int = 20) -> DataFrame:
    """How often a pattern would match, by description."""
    return rows.filter(F.col(text).rlike(f"(?i)^(?:{pattern})")).groupBy(text).count().orderBy(F.desc("count"), text).limit(n)


def link_bills(payments: DataFrame, accounts: DataFrame, overrides: DataFrame, margin: int = 60) -> DataFrame:
    """Payments to utility accounts: override, else the one account whose pattern and dates fit; several or none are null.

    accounts: account, pattern, active_from, active_to (a configuration table, see ``config_table``). status: override, linked, several, none.
    """
    fits = F.expr("lower(p.text) rlike lower(a.pattern)") & (F.col("a.active_from").isNull() | (F.col("p.day") >= F.date_sub("a.active_from", margin))) & (F.col("a.active_to").isNull() | (F.col("p.day") <= F.date_add("a.active_to", margin)))
    hits = payments.alias("p").join(config_table(accounts).alias("a"), fits).groupBy("p.id").agg(F.min("a.account").alias("account"), F.countDistinct("a.account").alias("n"))
    by = payments.join(hits.withColumnRenamed("account", "__hit"), "id", "left").join(overrides.select("id", F.col("account").alias("__own")), "id", "left")
    own = F.col("__own").isNotNull()
    account = F.when(own, F.when(F.col("__own") != "none", F.col("__own"))).when(F.col("n") == 1, F.col("__hit"))
    status = F.when(own, "override").when(F.col("n") == 1, "linked").when(F.col("n") > 1, "several").otherwise("none")
    return by.select("id", account.alias("account"), status.alias("status"))
