"""Ledger views over the star-schema tables: money as integer cents, positive for money out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.operators import series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100).cast("long")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows: finished ones are purchases, open ones refunds, pending ones payments."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "purchase").when(F.col("o_orderstatus") == "O", "refund").otherwise("payment")
    sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("date").alias("day"), (sign * cents("o_totalprice")).cast("long").alias("cents"), kind.alias("type"), F.col("o_orderpriority").alias("grp"))


TXN_SQL = """txn AS (SELECT o_orderkey AS id, o_custkey AS account, CAST(o_orderdate AS DATE) AS day,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * round(o_totalprice * 100) AS BIGINT) AS cents,
  CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'refund' ELSE 'payment' END AS type,
  o_orderpriority AS grp FROM orders)"""


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the category of their part (type.brand)."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    cat = F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("."), F.lower(F.regexp_replace("p_brand", "#", "")))
    parts = p.select(F.col("p_partkey").alias("sku"), cat.alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
    lines = li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_linenumber").alias("line_no"), cents("l_extendedprice").alias("cents"), cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discount"))
    return lines.join(parts, "sku")


ITEM_SQL = """item AS (SELECT l_orderkey AS order_id, l_partkey AS sku, l_linenumber AS line_no,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS discount,
  lower(replace(p_type, ' ', '_')) || '.' || lower(replace(p_brand, '#', '')) AS category, p_name AS title, p_brand AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checking rows: purchases and errors go out, the rest come in."""
    e = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type").isin("purchase", "error"), 1).otherwise(-1)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), F.col("ts").cast("date").alias("day"), (sign * cents("value")).cast("long").alias("cents"), F.col("event_type").alias("bank_type"), "props")


BANK_SQL = """bank AS (SELECT event_id AS id, user_id AS account, CAST(ts AS DATE) AS day,
  CAST(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE -1 END * round(value * 100) AS BIGINT) AS cents,
  event_type AS bank_type, props FROM events)"""


SERIES_SQL = f"""{TXN_SQL}, span AS (SELECT account, date_trunc('month', min(day)) AS a, date_trunc('month', max(day)) AS b FROM txn GROUP BY account),
spine AS (SELECT account, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS first FROM span),
sums AS (SELECT account, CAST(date_trunc('month', day) AS DATE) AS first, sum(cents) AS cents FROM txn GROUP BY ALL),
ser AS (SELECT spine.account, spine.first, strftime(spine.first, '%Y-%m') AS month, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM spine LEFT JOIN sums USING (account, first))"""


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account's sums by month, without gaps."""
    return series.monthly(txn(spark, sf_dir))
