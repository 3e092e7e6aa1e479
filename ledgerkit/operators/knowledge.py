"""Versioned documents: change detection, quote and number checks, page budgets, profile versions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.functions.text import document_text, numbers_in


def store_if_changed(fetched: DataFrame, latest: DataFrame, thin: int = 1500) -> DataFrame:
    """doc, state: thin (too short), unchanged (same text without regard to white space), stored."""
    digest = F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256)
    rows = fetched.withColumn("hash", digest).join(latest.select("doc", F.col("hash").alias("__old")), "doc", "left")
    state = F.when(F.length("text") < thin, "thin").when(F.col("hash") == F.col("__old"), "unchanged").otherwise("stored")
    return rows.select("doc", "hash", state.alias("state"))


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quote_id, doc, page, found: the page cited, else a neighbour, else any page of the document (then ``moved``).

    Quotes meet only the pages of their own document.
    """
    q = quotes.select("quote_id", "doc", F.col("page").alias("cited"), document_text(F.col("quote")).alias("quote"))
    p = pages.select("doc", "page", document_text(F.col("text")).alias("text"))
    hits = q.join(p, "doc").filter(F.col("text").contains(F.col("quote"))).groupBy("quote_id").agg(F.min_by("page", F.struct(F.abs(F.col("page") - F.col("cited")).alias("d"), "page")).alias("page"))
    out = q.join(hits, "quote_id", "left")
    state = F.when(F.col("page").isNull(), "missing").when(F.abs(F.col("page") - F.col("cited")) <= 1, "verified").otherwise("moved")
    return out.select("quote_id", "doc", "page", state.alias("state"))


def numbers_verified(value: Column, quote: Column) -> Column:
    """The number is among those of the quote (to 1e-6)."""
    return F.exists(numbers_in(quote), lambda x: F.abs(x - value) < 1e-6)


def document_status(outcome: Column, failures: Column) -> Column:
    return F.when(outcome.isin("ok", "not_modified"), "active").when(outcome == "other_host", "needs_domain").when(outcome == "robots", "blocked").when(outcome == "script_page", "needs_browser").when(failures >= 3, "broken").otherwise("active")


def page_scores(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """Occurrences of the words on each page."""
    text = F.lower("text")
    score = sum(((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words)
    return pages.withColumn("score", score)


def page_budget(scored: DataFrame, budget: int) -> DataFrame:
    """Whole pages within a document's budget: all if they fit, else the first page, then by score while they fit.

    A page that doesn't fit is passed over, not the end: so documents are walked, by sizes alone.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        if pdf["size"].sum() <= budget:
            return pdf[["doc", "page"]]
        left, keep = budget, []
        order = pdf.assign(first=pdf["page"] != pdf["page"].min()).sort_values(["first", "score", "page"], ascending=[True, False, True])
        for page, size in zip(order["page"], order["size"]):
            if size <= left:
                keep.append(page)
                left -= size
        return pdf[pdf["page"].isin(keep)][["doc", "page"]]

    sizes = scored.select("doc", "page", F.length("text").cast("long").alias("size"), "score")
    return sizes.groupBy("doc").applyInPandas(choose, "doc long, page int")


def propose(profiles: DataFrame, proposals: DataFrame) -> DataFrame:
    """card, version, state of a proposed profile: unchanged, rejected_before, pending (a first one is published).

    profiles: card, version, hash, status (active, superseded, rejected, pending).
    """
    active = profiles.filter("status = 'active'").select("card", F.col("hash").alias("__active"))
    rejected = profiles.filter("status = 'rejected'").select("card", "hash", F.lit(True).alias("__no")).distinct()
    top = profiles.groupBy("card").agg(F.max("version").alias("__top"))
    j = proposals.join(active, "card", "left").join(rejected, ["card", "hash"], "left").join(top, "card", "left")
    state = F.when(F.col("hash") == F.col("__active"), "unchanged").when(F.col("__no"), "rejected_before").when(F.col("__active").isNull(), "published").otherwise("pending")
    return j.select("card", "hash", (F.coalesce("__top", F.lit(0)) + 1).alias("version"), state.alias("state"))


def current_offers(snapshots: DataFrame, today: Column, stale: int = 21) -> DataFrame:
    """Offers of each card's latest snapshot that haven't expired (today still counts); old snapshots are marked."""
    last = snapshots.groupBy("card").agg(F.max("snapshot_day").alias("snapshot_day"))
    rows = snapshots.join(last, ["card", "snapshot_day"]).filter(F.col("expires").isNull() | (F.col("expires") >= today))
    return rows.withColumn("stale", F.datediff(today, F.col("snapshot_day")) > stale)


@F.pandas_udf(T.DoubleType())
def close_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity; for pairs that a cheaper test let through."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype=float)


_GRAM = 3


def _close_pairs(queries: DataFrame, aliases: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of query and alias that may reach the cutoff; none that does is missing.

    At a ratio of ``cutoff`` or more all but ``a + b - 2 M`` letters match in order, where ``2 M >= cutoff (a + b)``. A letter
    without a partner costs a name ``_GRAM`` of its runs of letters, one of the other name ``_GRAM - 1``; that is most where the other
    is as short as it may be. So of each name's runs, in one order, so many and one more hold a common one.
    """
    from collections import Counter

    shortest = cutoff / (2 - cutoff)
    if _GRAM * (1 - shortest) >= 1:  # a pair may have no run in common
        return queries.crossJoin(aliases)

    @F.pandas_udf("array<string>")
    def runs(names: pd.Series) -> pd.Series:
        out = []
        for name in names:
            seen: Counter = Counter()
            padded = "\x02" * (_GRAM - 1) + name + "\x03" * (_GRAM - 1)
            here = []
            for i in range(len(padded) - _GRAM + 1):
                g = padded[i : i + _GRAM]
                here.append(f"{g}{seen[g]}")
                seen[g] += 1
            out.append(here)
        return pd.Series(out)

    both = queries.select(F.col("query").alias("name")).unionByName(aliases.select(F.col("alias").alias("name")))
    each = both.distinct().withColumn("run", F.explode(runs("name")))
    often = each.groupBy("run").agg(F.count(F.lit(1)).alias("often"))
    keep = F.floor(_GRAM * (1 - shortest) * F.length("name") + 1e-6) + 1
    first = each.join(often, "run").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("often", "run"))).alias("runs"))
    first = first.select("name", F.explode(F.slice("runs", F.lit(1), keep.cast("int"))["run"]).alias("run"))
    q = queries.join(first.withColumnRenamed("name", "query"), "query")
    a = aliases.join(first.withColumnRenamed("name", "alias"), "alias")
    fits = 2 * F.least(F.length("query"), F.length("alias")) >= cutoff * (F.length("query") + F.length("alias")) - 1e-6
    return q.join(a, "run").filter(fits).select("query", "alias").distinct()


def _words_held(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of a query and an alias of three letters or more that stands in it as whole words."""
    words = F.split("query", " ")
    n = F.size(words)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    held = queries.select("query", F.explode(F.array_distinct(parts)).alias("alias"))
    return held.join(aliases.filter(F.length("alias") >= 3), "alias").select("query", "alias")


def suggestions(queries: DataFrame, aliases: DataFrame, cutoff: float = 0.88, n: int = 4) -> DataFrame:
    """At most ``n`` aliases of each query: close ones by ratio, then those that it holds as whole words, the longest first.

    Ties go to the alias first in order. The ratio of the latter is given too.
    """
    from pyspark.sql import Window

    q = queries.select(F.col("name").alias("query")).filter("query <> ''").distinct()
    a = aliases.select("alias").filter("alias <> ''").distinct()
    close = _close_pairs(q, a, cutoff).select("query", "alias", close_ratio("alias", "query").alias("ratio")).filter(F.col("ratio") >= cutoff).withColumn("__close", F.lit(True))
    held = _words_held(q, a).join(close.select("query", "alias"), ["query", "alias"], "left_anti").select("query", "alias", close_ratio("alias", "query").alias("ratio"), F.lit(False).alias("__close"))
    w = Window.partitionBy("query").orderBy(F.desc("__close"), F.when(F.col("__close"), -F.col("ratio")).otherwise(-F.length("alias")), "alias")
    return close.unionByName(held).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("__close")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's compatibility composition, which Spark doesn't have."""
    import unicodedata

    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
