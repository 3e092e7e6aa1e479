"""Card profiles put together from verified statements of documents, with hashes that don't depend on the order of anything.

A profile is accepted only as a whole: both fees, and exactly one base rule. Its text is canonical (sorted lists, sorted rules, every field named),
so equal contents have equal hashes whatever order documents, rows or lists came in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of documents that may be read; active ones come first (fixed values).
USABLE = ("active", "candidate", "stale")
#: Who said something, the strongest first (fixed values).
SOURCES = ("user", "seed", "kb", "ai")


def task_sources(documents: DataFrame, versions: DataFrame, types: Sequence[str]) -> DataFrame:
    """card, doc_id, kind, ref, text_hash of the documents a task reads, each with its latest good version.

    documents: card, doc_id, kind, status; versions: doc_id, version, ok, text_hash. Documents that aren't active are read only where the card has no
    active one of their kind with a good version. ``ref`` is D1, D2, ... by kind in the order of ``types``, then by doc_id.
    """
    order = F.array_position(F.array(*map(F.lit, types)), F.col("kind"))
    latest = versions.filter("ok").groupBy("doc_id").agg(F.max_by("text_hash", "version").alias("text_hash"))
    rows = documents.filter(F.col("status").isin(*USABLE) & F.col("kind").isin(*types)).join(latest, "doc_id")
    active = F.max(F.col("status") == "active").over(Window.partitionBy("card", "kind"))
    rows = rows.withColumn("healthy", active).filter("status = 'active' or not healthy")
    nth = F.row_number().over(Window.partitionBy("card").orderBy(order, "doc_id"))
    return rows.select("card", "doc_id", "kind", F.concat(F.lit("D"), nth).alias("ref"), "text_hash")


def input_keys(sources: DataFrame, task: str, version: int, model: str, most: int) -> DataFrame:
    """card, input_key: what a task's answer depends on. The same documents give the same key, in whatever order they are read."""
    number = F.substring("ref", 2, 9).cast("int")
    docs = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "kind", "text_hash"))), lambda d: F.concat_ws(":", d["n"], d["kind"], d["text_hash"]))
    text = F.concat_ws("|", F.lit(task), F.lit(str(version)), F.lit(model), F.lit(str(most)), F.col("docs"))
    return sources.groupBy("card").agg(F.array_join(docs, ",").alias("docs")).select("card", F.sha2(text, 256).alias("input_key"))


def rule_text(columns: dict[str, Column]) -> Column:
    """``name=value`` of every field in the order of names; a missing value is just the name, lists are sorted."""
    one = lambda n, c: F.concat(F.lit(n), F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")))
    return F.concat_ws(";", *[one(n, columns[n]) for n in sorted(columns)])


def sorted_list(c: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.col(c))), ",")


def compose(fees: DataFrame, rules: DataFrame, credits: DataFrame) -> DataFrame:
    """card, state, annual_fee, foreign_fee, rules, credits, content_hash, dropped of every card that has anything.

    fees: card, part (annual, foreign), value, verified; rules: card, is_base, rate, categories, merchants, channel, verified; credits: card, name, cents, period, verified.
    Items that aren't verified, and rules without a rate above 0, are dropped and counted. state is ok, or what is missing: annual fee, foreign fee, base rule (none, or several).
    Base rules stand first; equal items count once. content_hash is null unless the state is ok.
    """
    good = F.coalesce("verified", F.lit(False))
    value = lambda part: F.max(F.when(good & (F.col("part") == part), F.col("value")))
    fee = fees.groupBy("card").agg(value("annual").alias("annual_fee"), value("foreign").alias("foreign_fee"))
    text = rule_text({"rate": F.col("rate"), "categories": sorted_list("categories"), "merchants": sorted_list("merchants"), "channel": F.col("channel")})
    sound = good & F.coalesce(F.col("rate") > 0, F.lit(False))
    items = F.transform(F.array_sort(F.collect_set(F.when(sound, F.struct((~F.col("is_base")).alias("later"), text.alias("text"))))), lambda x: F.concat(F.when(x["later"], "rule:").otherwise("base:"), x["text"]))
    rule = rules.groupBy("card").agg(items.alias("rules"), F.count_if(~sound).alias("bad_rules"))
    credit = rule_text({"name": F.col("name"), "cents": F.col("cents"), "period": F.col("period")})
    paid = credits.groupBy("card").agg(F.array_sort(F.collect_set(F.when(good, credit))).alias("credits"), F.count_if(~good).alias("bad_credits"))
    none = F.array().cast("array<string>")
    rows = fee.join(rule, "card", "full").join(paid, "card", "full").withColumns({"rules": F.coalesce("rules", none), "credits": F.coalesce("credits", none)})
    bases = F.size(F.filter("rules", lambda x: x.startswith("base:")))
    state = F.when(F.col("annual_fee").isNull(), "annual fee").when(F.col("foreign_fee").isNull(), "foreign fee").when(bases != 1, "base rule").otherwise("ok")
    whole = F.concat_ws("\n", F.col("annual_fee").cast("string"), F.col("foreign_fee").cast("string"), F.array_join("rules", "\n"), F.array_join("credits", "\n"))
    dropped = F.coalesce("bad_rules", F.lit(0)) + F.coalesce("bad_credits", F.lit(0))
    return rows.select("card", state.alias("state"), "annual_fee", "foreign_fee", "rules", "credits", F.when(state == "ok", F.sha2(whole, 256)).alias("content_hash"), dropped.cast("long").alias("dropped"))


def requirements(rules: DataFrame, credits: DataFrame) -> DataFrame:
    """card, name: what cards ask for, once each: needs of rules, and enrollment in credits (card, name, enrollment)."""
    needs = rules.select("card", F.explode("needs").alias("name"))
    return needs.unionByName(credits.filter("enrollment").select("card", "name")).distinct()


def merged_by_source(*tables: DataFrame) -> DataFrame:
    """One row for each key: of several the one of the strongest source (user, seed, kb, ai), the latest of those. tables: key, source, changed, value."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    best = F.max_by(F.struct("source", "changed", "value"), F.struct(-rank, F.col("changed"), F.xxhash64("value")))
    return rows.filter(rank > 0).groupBy("key").agg(best.alias("b")).select("key", "b.source", "b.changed", "b.value")


def seed_changes(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """key, action (insert, update, delete) that bring ``stored`` up to ``seed``; what a user said is never touched, and equal hashes write nothing.

    stored: key, source, seed_hash; seed: key, value. A seed row that is no longer there is deleted.
    """
    new = seed.select("key", F.sha2(F.coalesce("value", F.lit("")), 256).alias("hash"))
    both = stored.join(new, "key", "full")
    action = F.when(F.col("source").isNull(), "insert").when(F.col("source") == "user", None).when(F.col("hash").isNull(), F.when(F.col("source") == "seed", "delete")).when(~F.col("seed_hash").eqNullSafe(F.col("hash")), "update")
    return both.select("key", action.alias("action")).filter("action is not null")
