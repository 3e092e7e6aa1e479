"""Folders of mixed documents: what each file is by its content, the parser of each kind, and what couldn't be read.

Files are read whole by Spark's own readers, so any file system that Spark knows will do; a file's content decides its kind, its name
only where the content can't. Parsers are functions from files (file, text) to a table with ``file`` and, where they judge, ``state``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.sources import exports, orders, statements

Parser = Callable[[DataFrame], DataFrame]
PARSERS: dict[str, Parser] = {}

# Fields of the JSON documents, and files that a run folder may hold without listing them.
_RECEIPT_FIELDS = ("warehouse", "items", "tender")
_MANIFEST_FIELDS = ("site", "run_date", "files")
MANIFEST = "site string, run_date string, files array<struct<file:string,kind:string,card_id:string,period_start:string,period_end:string,note:string>>"
EXTRAS = ("manifest.json", "run_report.json", "playbook_proposed.md", "guard.log")
_SESSION = r"^(?:session|trace)|\.(?:py|yml|yaml|log)$"


def parser(*kinds: str) -> Callable[[Parser], Parser]:
    """Register a parser for kinds of files."""

    def add(f: Parser) -> Parser:
        for kind in kinds:
            PARSERS[kind] = f
        return f

    return add


def kind_of(name: Column, text: Column) -> Column:
    """statement, invoice, export, charges, receipt or manifest; null for none of them."""
    first = F.element_at(F.split(F.regexp_replace(text, "^﻿", ""), r"\r\n|\n|\r", 2), 1)
    keys = F.coalesce(F.json_object_keys(F.when(F.ltrim(text).startswith("{"), text)), F.array().cast("array<string>"))
    has = lambda fields: F.forall(F.array(*map(F.lit, fields)), lambda k: F.array_contains(keys, k))
    printed = statements.text_kind(text)
    charges = text.rlike(r"\*{4}\d{4,5}\s+[-+]\$") & F.contains(text, F.lit("Order #"))
    kind = F.when(has(_RECEIPT_FIELDS), "receipt").when(has(_MANIFEST_FIELDS), "manifest").when(exports.layout(exports.fields(first)).isNotNull(), "export")
    return kind.when(printed == "invoice", "invoice").when(printed.isNotNull(), "statement").when(charges, "charges")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """file, name, kind, text of all files below ``path``; not those whose name begins with a dot or underscore, which Spark skips."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return files.select("file", "name", kind_of(F.col("name"), F.col("text")).alias("kind"), "text")


@parser("export")
def _exports(files: DataFrame) -> DataFrame:
    lines = files.select("file", F.regexp_replace("text", "^﻿", "").alias("text"))
    return exports.export_rows(exports.with_headers(lines.select("file", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("at", "value"))))


@parser("statement")
def _statements(files: DataFrame) -> DataFrame:
    return statements.card_statements(files)


@parser("invoice")
def _invoices(files: DataFrame) -> DataFrame:
    return orders.invoices(files)


@parser("charges")
def _charges(files: DataFrame) -> DataFrame:
    return orders.charge_lines(files)


@parser("receipt")
def _receipts(files: DataFrame) -> DataFrame:
    return orders.receipts(files)


@parser("manifest")
def _manifests(files: DataFrame) -> DataFrame:
    return files.select("file", F.from_json("text", MANIFEST).alias("m")).select("file", "m.*")


def parse(files: DataFrame) -> dict[str, DataFrame]:
    """The table of each registered kind, of files as ``discover`` gives them."""
    return {kind: f(files.filter(F.col("kind") == kind).select("file", "text")) for kind, f in PARSERS.items()}


def quarantine(files: DataFrame, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """file, kind, problem of files that no parser takes, or whose parser couldn't read them (of an export: how many of its lines)."""
    tables = parse(files) if tables is None else tables
    out = files.filter(F.col("kind").isNull()).select("file", "kind", F.lit("unknown kind").alias("problem"))
    for kind, table in tables.items():
        if "state" in table.columns and kind != "export":
            bad = table.filter(~F.col("state").isin("ok"))
            out = out.unionByName(bad.select("file", F.lit(kind).alias("kind"), F.col("state").alias("problem")))
    if "export" in tables:
        bad = tables["export"].filter("state = 'bad'").groupBy("file").agg(F.count("*").alias("n"))
        out = out.unionByName(bad.select("file", F.lit("export").alias("kind"), F.concat("n", F.lit(" bad lines")).alias("problem")))
    return out


def manifest_problems(manifests: DataFrame, listing: DataFrame, cards: DataFrame) -> DataFrame:
    """run, file, problem of run folders' manifests; a run without a problem but "unlisted" may be imported.

    manifests: run, site, run_date (as expected), text; listing: run, name of the files that are there; cards: card.
    problem: no manifest (null text or no JSON of its shape), other site, other date, listed twice, not found, unknown card, wrong period, unlisted.
    """
    read = manifests.select("run", F.col("site").alias("want_site"), F.col("run_date").alias("want_date"), F.from_json("text", MANIFEST).alias("m")).select("run", "want_site", "want_date", "m.*")
    whole = F.col("site").isNotNull() & F.col("run_date").isNotNull() & F.col("files").isNotNull()
    of_run = lambda when, problem: read.filter(when).select("run", F.lit(None).cast("string").alias("file"), F.lit(problem).alias("problem"))
    out = of_run(~whole, "no manifest").unionByName(of_run(whole & (F.col("site") != F.col("want_site")), "other site")).unionByName(of_run(whole & (F.col("run_date") != F.col("want_date")), "other date"))
    entries = read.filter(whole).select("run", F.explode("files").alias("e")).select("run", "e.*")
    each = lambda df, problem: df.select("run", "file", F.lit(problem).alias("problem"))
    out = out.unionByName(each(entries.groupBy("run", "file").agg(F.count("*").alias("n")).filter("n > 1"), "listed twice"))
    there = listing.select("run", F.col("name").alias("file")).distinct()
    out = out.unionByName(each(entries.select("run", "file").distinct().join(there, ["run", "file"], "left_anti"), "not found"))
    known = cards.select(F.col("card").alias("card_id")).distinct()
    out = out.unionByName(each(entries.filter("card_id is not null").join(known, "card_id", "left_anti").select("run", "file").distinct(), "unknown card"))
    out = out.unionByName(each(entries.filter("period_start > period_end").select("run", "file").distinct(), "wrong period"))
    # A transcript's screenshot travels with it; logs of the session needn't be listed.
    also = entries.filter(F.col("file").endswith(".json")).select("run", F.regexp_replace("file", r"\.json$", ".png").alias("file"))
    stray = there.filter(~F.col("file").isin(*EXTRAS) & ~F.col("file").rlike(_SESSION)).join(read.filter(whole).select("run"), "run", "left_semi")
    return out.unionByName(each(stray.join(entries.select("run", "file").unionByName(also).distinct(), ["run", "file"], "left_anti"), "unlisted"))
