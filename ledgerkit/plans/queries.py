"""The registered ledger queries over the star-schema tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerkit.functions import money, text
from ledgerkit.operators import classify, ingest, knowledge, matching, reconcile, rewards, series, spending, split, statements, views
from ledgerkit.operators.classify import Rule
from ledgerkit.sources import exports
from ledgerkit.plans import documents, evaluations
from ledgerkit.plans.adapters import BANK_SQL, ITEM_SQL, SERIES_SQL, TXN_SQL, bank, cents, item, table, txn
from ledgerkit.plans.adapters import monthly_series as _series
from ledgerkit.plans.registration import registrar

QUERIES: dict = documents.QUERIES | evaluations.QUERIES
ORACLE: dict[str, str] = documents.ORACLE | evaluations.ORACLE


query = registrar(QUERIES, ORACLE)


def day(s: str):
    return F.lit(s).cast("date")


# Splits and spending

ALLOC_SQL = f"""{TXN_SQL}, {ITEM_SQL},
w AS (SELECT t.id, t.cents AS total, i.line_no, i.category, CAST(greatest(i.cents - i.discount, 0) AS HUGEINT) AS w
      FROM txn t JOIN item i ON i.order_id = t.id WHERE t.type IN ('purchase', 'refund')),
q AS (SELECT *, sum(w) OVER (PARTITION BY id) AS s, row_number() OVER (PARTITION BY id ORDER BY line_no, category, w) AS line FROM w),
r AS (SELECT *, CASE WHEN s > 0 THEN abs(total) * w // s ELSE 0 END AS q, CASE WHEN s > 0 THEN abs(total) * w % s ELSE 0 END AS rest FROM q),
k AS (SELECT *, abs(total) - sum(q) OVER (PARTITION BY id) AS short,
             row_number() OVER (PARTITION BY id ORDER BY rest DESC, line_no, category, w) AS nth FROM r),
piece AS (SELECT id, category, sign(total) * (q + CASE WHEN s > 0 THEN CASE WHEN nth <= short THEN 1 ELSE 0 END WHEN line = 1 THEN short ELSE 0 END) AS part FROM k),
alloc AS (SELECT id, category, CAST(sum(part) AS BIGINT) AS cents FROM piece GROUP BY id, category HAVING sum(part) <> 0)"""
LINES_SQL = f"""{ALLOC_SQL},
lines AS (SELECT t.id, t.account, t.day, strftime(t.day, '%Y-%m') AS month, t.grp,
                 coalesce(a.category, 'uncategorized') AS category, coalesce(a.cents, t.cents) AS cents
          FROM txn t LEFT JOIN alloc a USING (id) WHERE t.type IN ('purchase', 'refund', 'fee', 'interest'))"""


def _allocations(spark, d):
    spent = txn(spark, d).filter(F.col("type").isin("purchase", "refund"))
    return split.allocate(spent, item(spark, d))


def _lines(spark, d):
    return spending.spending_lines(txn(spark, d), _allocations(spark, d))


@query(f"WITH {ALLOC_SQL} SELECT * FROM alloc")
def allocations(spark, d):
    return _allocations(spark, d)


@query(f"WITH {ALLOC_SQL} SELECT id, category FROM alloc QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(cents) DESC, category) = 1")
def dominant_category(spark, d):
    return split.dominant_category(_allocations(spark, d))


@query(f"WITH {LINES_SQL} SELECT month, category, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS lines FROM lines GROUP BY ALL")
def spending_by_month_category(spark, d):
    return spending.by_month_category(_lines(spark, d))


@query(f"""WITH {LINES_SQL}
SELECT month, 'total' AS dimension, 'all' AS key, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY ALL
UNION ALL SELECT month, 'grp', coalesce(grp, 'unknown'), CAST(sum(cents) AS BIGINT) FROM lines GROUP BY ALL
UNION ALL SELECT month, 'parent', split_part(category, '.', 1), CAST(sum(cents) AS BIGINT) FROM lines GROUP BY ALL""")
def monthly_summary(spark, d):
    lines = _lines(spark, d).withColumn("parent", F.split_part("category", F.lit("."), F.lit(1)))
    return spending.summary_sets(lines, ["grp", "parent"])


@query(f"""WITH {BANK_SQL} SELECT strftime(day, '%Y-%m') AS month,
CASE WHEN bank_type = 'view' THEN 'not_counted' WHEN cents > 0 THEN 'out' ELSE 'in' END AS side, bank_type AS key,
CAST(sum(abs(cents)) AS BIGINT) AS cents, count(*) AS rows FROM bank GROUP BY ALL""")
def cash_flow(spark, d):
    return spending.cash_flow(bank(spark, d), ["view"])


@query(f"WITH {BANK_SQL} SELECT strftime(day, '%Y-%m') AS month, CAST(coalesce(sum(cents) FILTER (bank_type IN ('signup', 'click')), 0) AS BIGINT) AS cents FROM bank GROUP BY ALL")
def credits_by_month(spark, d):
    return spending.credits_total(bank(spark, d), ["signup", "click"])


@query(f"""WITH {TXN_SQL}, {BANK_SQL},
a AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS rows_a, sum(CASE WHEN grp = '1-URGENT' THEN 1 ELSE 0 END) AS matched_a FROM txn WHERE type = 'payment' GROUP BY ALL),
b AS (SELECT strftime(day, '%Y-%m') AS month, count(*) AS rows_b FROM bank GROUP BY ALL)
SELECT coalesce(a.month, b.month) AS month, coalesce(rows_a, 0) AS rows_a, CAST(coalesce(matched_a, 0) AS BIGINT) AS matched_a, coalesce(rows_b, 0) AS rows_b
FROM a FULL JOIN b ON a.month = b.month""")
def payment_coverage(spark, d):
    paid = txn(spark, d).filter("type = 'payment'").withColumn("matched", F.col("grp") == "1-URGENT")
    return spending.coverage(paid, bank(spark, d))


@query(f"WITH {ITEM_SQL} SELECT sku, min(title) AS title, min(category) AS category, CAST(sum(cents - discount) AS BIGINT) AS paid FROM item GROUP BY sku ORDER BY paid DESC, sku LIMIT 12")
def top_items(spark, d):
    return spending.top_items(item(spark, d))


@query(f"""WITH {TXN_SQL}, {ITEM_SQL} SELECT t.id, t.account, t.cents,
(SELECT string_agg(line_no || ':' || sku || ':' || i.cents, ',' ORDER BY line_no, sku, i.cents) FROM item i WHERE i.order_id = t.id) AS items FROM txn t""")
def orders_with_items(spark, d):
    rows = spending.nested_orders(txn(spark, d), item(spark, d))
    line = F.transform("items", lambda x: F.concat_ws(":", x["line_no"], x["sku"], x["cents"]))
    return rows.select("id", "account", "cents", F.array_join(line, ",").alias("items"))


@query(f"WITH {TXN_SQL} SELECT id, account, day, cents, type, grp FROM txn WHERE type IN ('purchase', 'refund') AND cents > 0 AND year(day) = 1997 ORDER BY day DESC, id DESC LIMIT 2000")
def transaction_search(spark, d):
    months = [f"1997-{m:02d}" for m in range(1, 13)]
    return spending.search(txn(spark, d), months=months, types=["purchase", "refund"], direction="out")


@query(f"WITH {ALLOC_SQL} SELECT id, account, cents FROM txn WHERE id IN (SELECT id FROM alloc WHERE category = 'economy' OR category LIKE 'economy.%')")
def transactions_in_category(spark, d):
    return spending.with_category(txn(spark, d), _allocations(spark, d), "economy").select("id", "account", "cents")


@query(f"WITH {ITEM_SQL} SELECT category, count(*) AS n FROM item WHERE split_part(category, '.', 1) = 'promo' OR starts_with(split_part(category, '.', 1), 'promo_') GROUP BY ALL")
def group_family(spark, d):
    rows = item(spark, d).withColumn("parent", F.split_part("category", F.lit("."), F.lit(1)))
    return rows.filter(spending.in_families(["promo"], "parent")).groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey AS key, lower(p_name) AS alias FROM part WHERE lower(p_name) LIKE '%ar%')
SELECT key, alias, starts_with(alias, 'ar') AS prefix FROM a ORDER BY prefix DESC, length(alias), alias, key LIMIT 8""")
def autocomplete(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("alias"))
    return spending.autocomplete(names, "ar")


def _category_sums(spark, d):
    return item(spark, d).groupBy(F.split_part("category", F.lit("."), F.lit(1)).alias("category")).agg(F.sum("cents").alias("cents"))


@query(f"WITH {ITEM_SQL}, s AS (SELECT split_part(category, '.', 1) AS category, sum(cents) AS cents FROM item GROUP BY ALL) SELECT category, CAST(cents AS BIGINT) AS cents, CAST(cents * 10000 // sum(cents) OVER () AS BIGINT) AS share FROM s WHERE cents > 0")
def category_shares(spark, d):
    return spending.shares(_category_sums(spark, d), "category")


@query(f"""WITH {ITEM_SQL}, s AS (SELECT category, sum(cents) AS cents FROM item GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY cents DESC, category) AS nth FROM s)
SELECT CASE WHEN nth <= 5 THEN category ELSE 'Other' END AS category, CAST(sum(cents) AS BIGINT) AS cents FROM n GROUP BY 1""")
def top_categories_and_other(spark, d):
    return spending.top_and_other(item(spark, d).groupBy("category").agg(F.sum("cents").alias("cents")), "category")


@query(f"WITH {TXN_SQL} SELECT CAST(month(day) AS INTEGER) AS month_no, " + ", ".join(f"CAST(sum(cents) FILTER (year(day) = {y}) AS BIGINT) AS y{y}" for y in (1996, 1997)) + " FROM txn GROUP BY ALL")
def year_month_pivot(spark, d):
    return spending.year_month_pivot(txn(spark, d), [1996, 1997])


# Ingestion

KEYS_SQL = """k AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_extendedprice, l_quantity)::INTEGER - 1 AS occurrence FROM lineitem)"""


@query(f"WITH {KEYS_SQL} SELECT l_orderkey, l_linenumber, occurrence, sha256(l_orderkey || '|' || l_linenumber || '|' || occurrence) AS dedupe_key FROM k")
def occurrence_keys(spark, d):
    rows = ingest.occurrence_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice", "l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", "occurrence", "dedupe_key")


@query(f"WITH {KEYS_SQL} SELECT l_orderkey, l_linenumber, occurrence FROM k WHERE l_orderkey % 2 = 1 OR occurrence > 0")
def insert_missing(spark, d):
    rows = ingest.occurrence_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_extendedprice", "l_quantity"])
    stored = rows.filter("l_orderkey % 2 = 0 and occurrence = 0")
    return ingest.insert_missing(rows, stored).select("l_orderkey", "l_linenumber", "occurrence")


@query("SELECT DISTINCT sha256(html) AS sha256 FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 5 = 0)")
def new_files(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("content"))
    seen = pages.filter("page_id % 5 = 0").select(F.sha2("content", 256).alias("sha256"))
    return ingest.new_files(pages, seen).select("sha256")


@query(f"WITH {BANK_SQL} SELECT account, bank_type, cents FROM bank QUALIFY row_number() OVER (PARTITION BY account, bank_type ORDER BY day DESC, id DESC) = 1")
def last_write_wins(spark, d):
    return ingest.last_write_wins(bank(spark, d), ["account", "bank_type"], ["day", "id"], "cents").select("account", "bank_type", "cents")


@query(f"WITH {TXN_SQL} SELECT account, DATE '1995-01-01' AS start, min(day) AS first_day, CAST(min(day) - DATE '1995-01-01' AS INTEGER) AS gap FROM txn GROUP BY account HAVING gap > 10")
def coverage_gaps(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), day("1995-01-01").alias("start"))
    return ingest.coverage_gaps(txn(spark, d), asked)


@query(f"""WITH {TXN_SQL} SELECT id, concat_ws(',', CASE WHEN type = 'payment' THEN 'known_type' END, CASE WHEN abs(cents) > 10000000 THEN 'small' END,
CASE WHEN day < DATE '1996-01-01' THEN 'recent' END) AS problems FROM txn""")
def acceptance_gates(spark, d):
    checks = {"known_type": F.col("type") != "payment", "small": F.abs("cents") <= 10_000_000, "recent": F.col("day") >= day("1996-01-01")}
    return ingest.gate(txn(spark, d), checks).select("id", F.array_join("problems", ",").alias("problems"))


# Classification

RULES = (Rule(1, "small", "small_goods"), Rule(2, "(large|jumbo)", "large_goods", priority=50), Rule(3, "med", "medium_goods"), Rule(4, "small plated", "plated", user=True), Rule(5, "copper$", "copper", anchored=False, priority=200))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^small plated', 'i') THEN 4 WHEN regexp_matches(p_type, '^(large|jumbo)', 'i') THEN 2
WHEN regexp_matches(p_type, '^small', 'i') THEN 1 WHEN regexp_matches(p_type, '^med', 'i') THEN 3 WHEN regexp_matches(p_type, 'copper$', 'i') THEN 5 END AS rule FROM part""")
def merchant_rules(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.first_match(RULES, F.col("p_type"))["rule"].alias("rule"))


CARD_TEXTS = ["corner store", "Late fee", "delivery fee", "interest charge", "Payment reversal", "returned payment fee", "thank you", "points", "cash back", "statement credit", "refund of a bag", "credit balance refund"]
CARD_TYPES = ["", "Fee", " reversal ", "adjustment", "payment", "Return", None]


@query(f"""WITH {BANK_SQL}, r AS (SELECT id, CASE WHEN id % 37 = 0 THEN 0 ELSE cents END AS cents, upper({CARD_TEXTS}[1 + id % 12]) AS d,
lower(trim(coalesce({str(CARD_TYPES).replace("None", "NULL")}[1 + id % 7], ''))) AS it FROM bank)
SELECT id, CASE WHEN cents > 0 THEN CASE
 WHEN it = 'reversal' OR (d IN ('PAYMENT REVERSAL', 'CREDIT BALANCE REFUND', 'RETURNED PAYMENT FEE') AND d NOT IN ('LATE FEE', 'RETURNED PAYMENT FEE')) THEN 'payment'
 WHEN d = 'INTEREST CHARGE' THEN 'interest'
 WHEN it = 'fee' OR d IN ('LATE FEE', 'RETURNED PAYMENT FEE') THEN 'fee'
 WHEN it = 'adjustment' THEN 'adjustment' ELSE 'purchase' END
ELSE CASE WHEN it = 'payment' OR d IN ('PAYMENT REVERSAL', 'RETURNED PAYMENT FEE', 'THANK YOU') THEN 'payment'
 WHEN it = 'return' THEN 'refund' WHEN d IN ('POINTS', 'CASH BACK') THEN 'reward' WHEN it = 'adjustment' THEN 'adjustment' ELSE 'credit' END END AS type,
(cents <= 0 AND NOT (it IN ('payment', 'return', 'adjustment') OR d IN ('PAYMENT REVERSAL', 'RETURNED PAYMENT FEE', 'THANK YOU', 'POINTS', 'CASH BACK', 'STATEMENT CREDIT', 'CREDIT BALANCE REFUND'))) AS needs_review FROM r""")
def card_row_types(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("id") % n + 1).cast("int"))
    rows = bank(spark, d).withColumn("cents", F.when(F.col("id") % 37 == 0, 0).otherwise(F.col("cents")))
    kind = classify.card_row_type(pick(CARD_TEXTS, 12), pick(CARD_TYPES, 7), F.col("cents"))
    return rows.select("id", kind.alias("c")).select("id", "c.type", "c.needs_review")


@query(f"""WITH {TXN_SQL}, o AS (SELECT event_id AS id, event_id % 700 AS key, event_type AS value FROM events),
l AS (SELECT key, value FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY id DESC) = 1)
SELECT txn.id, coalesce(l.value, type) AS type, l.value IS NOT NULL AS overridden FROM txn LEFT JOIN l ON txn.id = l.key""")
def overrides(spark, d):
    e = table(spark, d, "events")
    writes = e.select(F.col("event_id").alias("id"), F.pmod("event_id", F.lit(700)).alias("target_key"), F.lit("type").alias("field"), F.col("event_type").alias("value"), F.col("event_id").alias("created_at"))
    return classify.with_overrides(txn(spark, d), writes, "id", "type", "type").select("id", "type", "overridden")


@query("""WITH seen AS (SELECT p_name AS name, p_brand AS grp, p_type AS category FROM part WHERE p_partkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1),
stored AS (SELECT p_name AS name, 'old' AS grp, min(p_type) AS category FROM part WHERE p_partkey % 3 < 2 GROUP BY p_name)
SELECT coalesce(seen.name, stored.name) AS name, coalesce(seen.grp, stored.grp) AS grp, coalesce(seen.category, stored.category) AS category FROM stored FULL JOIN seen ON seen.name = stored.name""")
def merchant_dimension(spark, d):
    p = table(spark, d, "part")
    seen = p.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("grp"), F.col("p_type").alias("category"))
    stored = p.filter("p_partkey % 3 < 2").groupBy(F.col("p_name").alias("name")).agg(F.lit("old").alias("grp"), F.min("p_type").alias("category"))
    return classify.merchant_dimension(stored, seen)


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def memo_misses(spark, d):
    memo = table(spark, d, "labels").withColumn("version", F.col("quality").cast("string"))
    return classify.memo_misses(table(spark, d, "documents"), memo, "doc_id", "1")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE l.toxic WHEN 1 THEN 'uncategorized' ELSE 'fine' END END AS label,
l.doc_id IS NULL OR l.quality = 0 OR l.toxic = 1 AS needs_review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def apply_labels(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "uncategorized").otherwise("fine").alias("label"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"))
    return classify.apply_labels(table(spark, d, "documents"), labels, "doc_id").select("doc_id", "label", "needs_review")


@query("""SELECT c_custkey, CASE WHEN n_name IS NULL OR n_name = '' THEN 'self' ELSE r_name END AS person, coalesce(n_name, '') <> '' AND r_name IS NULL AS needs_review
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3""")
def person_attribution(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region").filter("r_regionkey < 3")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("person"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return classify.attribute_person(c, names, F.col("n_name")).select("c_custkey", "person", "needs_review")


@query("SELECT p_type, count(*) AS count FROM part WHERE regexp_matches(p_type, '^s', 'i') GROUP BY ALL ORDER BY count DESC, p_type LIMIT 20")
def rule_preview(spark, d):
    return classify.rule_preview(table(spark, d, "part"), "s", "p_type")


# Matching


def _both(spark, d):
    b = bank(spark, d).withColumn("cents", F.floor(F.abs("cents") / 100).cast("long"))
    return b.filter("bank_type = 'purchase'").select("id", "account", "day", "cents"), b.filter("bank_type = 'signup'").select("id", "account", "day", "cents")


PAIRS_SQL = f"""{BANK_SQL}, b AS (SELECT id, account, day, abs(cents) // 100 AS cents, bank_type FROM bank),
pairs AS (SELECT l.id AS l_id, r.id AS r_id, l.day AS l_day, r.day AS r_day, CAST(l.day - r.day AS INTEGER) AS days FROM b l JOIN b r ON l.cents = r.cents
          WHERE l.bank_type = 'purchase' AND r.bank_type = 'signup' AND l.day - r.day BETWEEN -2 AND 6)"""


@query(f"WITH {PAIRS_SQL} SELECT l_id, r_id, days FROM pairs")
def match_candidates(spark, d):
    return matching.candidates(*_both(spark, d), ["cents"], -2, 6).select("l_id", "r_id", "days")


@query(f"""WITH {PAIRS_SQL} SELECT l_id, r_id, days FROM pairs
QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY abs(days), r_id) = 1 AND row_number() OVER (PARTITION BY r_id ORDER BY abs(days), l_id) = 1""")
def mutual_nearest(spark, d):
    return matching.nearest_both(*_both(spark, d), ["cents"], -2, 6).select("l_id", "r_id", "days")


@query(f"WITH {PAIRS_SQL}, n AS (SELECT * FROM pairs QUALIFY dense_rank() OVER (PARTITION BY l_id ORDER BY abs(days)) = 1) SELECT l_id, r_id, count(*) OVER (PARTITION BY l_id) AS ties FROM n")
def nearest_with_ties(spark, d):
    return matching.nearest_ties(*_both(spark, d), ["cents"], -2, 6).select("l_id", "r_id", "ties")


@query()
def greedy_matching(spark, d):
    return matching.greedy_by_day(*_both(spark, d), ["cents"], -2, 6)


@query(f"WITH {PAIRS_SQL} SELECT id, day FROM b WHERE bank_type = 'purchase' AND DATE '2024-02-10' - day > 14 AND id NOT IN (SELECT l_id FROM pairs)")
def unmatched_after_grace(spark, d):
    left, right = _both(spark, d)
    return matching.unmatched_after(left, matching.with_candidates(left, right, ["cents"], -2, 6), day("2024-02-10"), 14).select("id", "day")


@query(f"""WITH {BANK_SQL}, b AS (SELECT id, account, day, abs(cents) // 100 AS cents, bank_type FROM bank), p AS (SELECT * FROM b WHERE bank_type = 'signup'),
two AS (SELECT x.account, x.id AS id_a, y.id AS id_b, x.day AS day_a, y.day AS day_b, x.cents + y.cents AS cents FROM p x JOIN p y ON x.account = y.account AND x.id < y.id AND abs(x.day - y.day) <= 8)
SELECT t.id, id_a, id_b, t.cents FROM b t JOIN two USING (account, cents) WHERE t.bank_type = 'purchase' AND t.day - day_a BETWEEN -2 AND 6 AND t.day - day_b BETWEEN -2 AND 6""")
def sums_of_two(spark, d):
    return matching.sums_of_two(*_both(spark, d), ["account"], -2, 6)


@query()
def transfers(spark, d):
    left, right = _both(spark, d)
    issuer = lambda df: df.withColumn("issuer", F.pmod("account", F.lit(8)).cast("string")).drop("account")
    return matching.transfers(issuer(left), issuer(right).withColumn("cents", -F.col("cents")))


@query("""WITH x AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
t AS (SELECT DISTINCT p_type AS target, unnest(string_split(lower(p_type), ' ')) AS w FROM part), c AS (SELECT id, target, count(*) AS common FROM x JOIN t USING (w) GROUP BY ALL)
SELECT id, target, common FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY common DESC, target DESC) = 1""")
def keyword_assignment(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words"))
    targets = p.select(F.col("p_type").alias("target"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("words")).distinct()
    return matching.keyword_assignment(rows, targets)


@query("""WITH o AS (SELECT p_partkey::VARCHAR AS key, p_size AS s FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.s = n.s THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.key = n.key""")
def keyed_diff(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").alias("s"))
    return matching.keyed_diff(p.filter("id % 4 <> 0"), p.filter("id % 3 <> 0").withColumn("s", F.when(F.expr("id % 5 = 0"), F.col("s") + 1).otherwise(F.col("s"))), "key", ["s"])


# Reconciliation

COMPONENTS = """CAST(coalesce(sum(cents) FILTER (type = 'purchase'), 0) AS BIGINT) AS purchases, CAST(-coalesce(sum(cents) FILTER (type = 'payment'), 0) AS BIGINT) AS payments,
CAST(-coalesce(sum(cents) FILTER (type IN ('refund', 'credit')), 0) AS BIGINT) AS credits, CAST(0 AS BIGINT) AS fees, CAST(0 AS BIGINT) AS interest"""


@query(f"WITH {TXN_SQL} SELECT account, {COMPONENTS} FROM txn GROUP BY account")
def ledger_components(spark, d):
    return reconcile.ledger_components(txn(spark, d), ["account"])


@query(f"""WITH {TXN_SQL}, c AS (SELECT account, {COMPONENTS} FROM txn WHERE day > DATE '1996-01-01' AND day <= DATE '1997-12-31' GROUP BY account),
s AS (SELECT c_custkey AS account, CAST(round(c_acctbal * 100) AS BIGINT) AS bal FROM customer),
l AS (SELECT account, component, stated FROM (SELECT account, bal AS purchases, CAST(0 AS BIGINT) AS payments, bal AS credits, CAST(0 AS BIGINT) AS fees, CAST(0 AS BIGINT) AS interest FROM s) UNPIVOT (stated FOR component IN (purchases, payments, credits, fees, interest))),
f AS (FROM c UNPIVOT (found FOR component IN (purchases, payments, credits, fees, interest)))
SELECT l.account, DATE '1997-12-31' AS period_end, l.component, stated, coalesce(found, 0) AS found, stated - coalesce(found, 0) AS delta FROM l LEFT JOIN f ON l.account = f.account AND l.component = f.component""")
def card_ledger(spark, d):
    bal, none = cents("c_acctbal"), F.lit(0).cast("long")
    stated = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), day("1996-01-01").alias("period_start"), day("1997-12-31").alias("period_end"), bal.alias("purchases"), none.alias("payments"), bal.alias("credits"), none.alias("fees"), none.alias("interest"))
    return reconcile.card_ledger(stated, txn(spark, d))


@query(f"""WITH {BANK_SQL}, span AS (SELECT account, min(day) AS a, max(day) AS b FROM bank GROUP BY account),
s AS (SELECT DISTINCT account, DATE '2024-01-05' AS p, DATE '2024-01-25' AS e FROM bank),
t AS (SELECT s.account, p, e, coalesce(sum(-cents) FILTER (cents < 0), 0) AS i, coalesce(sum(cents) FILTER (cents > 0), 0) AS o FROM s LEFT JOIN bank ON bank.account = s.account AND day BETWEEN p AND e GROUP BY ALL)
SELECT t.account, p AS period_start, e AS period_end, CASE WHEN NOT (a <= p AND b >= e) THEN 'incomplete' WHEN i = 5000 AND o = 0 THEN 'match' ELSE 'mismatch' END AS state,
CAST(5000 - i AS BIGINT) AS deposits_delta, CAST(-o AS BIGINT) AS withdrawals_delta FROM t JOIN span ON t.account = span.account""")
def bank_ledger(spark, d):
    rows = bank(spark, d)
    stated = rows.select("account").distinct().select("account", day("2024-01-05").alias("period_start"), day("2024-01-25").alias("period_end"), F.lit(5000).cast("long").alias("deposits"), F.lit(0).cast("long").alias("withdrawals"))
    return reconcile.bank_ledger(stated, rows)


@query()
def balance_walk(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("account").orderBy("day", "id")
    rows = bank(spark, d).withColumn("balance", -F.sum("cents").over(w) + F.when(F.expr("id % 97 = 0"), 1).otherwise(0))
    return reconcile.balance_walk(rows.select("account", "id", "day", "cents", "balance"))


@query(f"WITH {PAIRS_SQL} SELECT r_id, count(*) AS n FROM pairs GROUP BY r_id HAVING n > 1")
def links_used_twice(spark, d):
    return reconcile.used_twice(matching.candidates(*_both(spark, d), ["cents"], -2, 6), "r_id")


@query("""WITH s AS (SELECT CASE WHEN l_linenumber < 4 THEN 'a' ELSE 'b' END AS kind, l_orderkey AS ref, l_linenumber AS n, CASE min(l_linestatus) WHEN 'F' THEN 'open' ELSE 'ignored' END AS status FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY ALL),
c AS (SELECT DISTINCT CASE WHEN l_linenumber < 4 THEN 'a' ELSE 'b' END AS kind, l_orderkey AS ref, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 < 2)
SELECT coalesce(s.kind, c.kind) || coalesce(s.n, c.n) AS kind, coalesce(s.ref, c.ref) AS ref, CASE WHEN s.status IS NULL OR (s.status = 'open' AND c.ref IS NOT NULL) THEN 'new' ELSE 'old' END AS details,
CASE WHEN s.status IS NULL THEN 'open' WHEN s.status = 'open' AND c.ref IS NULL THEN 'resolved' ELSE s.status END AS status FROM s FULL JOIN c ON s.kind = c.kind AND s.ref = c.ref AND s.n = c.n""")
def review_lifecycle(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.concat(F.when(F.col("l_linenumber") < 4, "a").otherwise("b"), F.col("l_linenumber").cast("string"))
    stored = li.filter("l_orderkey % 3 > 0").groupBy(kind.alias("kind"), F.col("l_orderkey").alias("ref")).agg(F.when(F.min("l_linestatus") == "F", "open").otherwise("ignored").alias("status")).withColumn("details", F.lit("old"))
    current = li.filter("l_orderkey % 3 < 2").select(kind.alias("kind"), F.col("l_orderkey").alias("ref"), F.lit("new").alias("details")).distinct()
    return reconcile.merge_reviews(stored, current)


@query(f"WITH {TXN_SQL} SELECT account, id, day FROM txn QUALIFY row_number() OVER (PARTITION BY account ORDER BY day DESC, id DESC) = 1")
def latest_per_account(spark, d):
    return reconcile.latest(txn(spark, d), ["account"], ["day", "id"]).select("account", "id", "day")


# Rewards

RULE_ROWS = "('blue', 1, NULL, NULL, NULL, 100, 100, NULL, 'x'), ('blue', 2, 'promo_brushed_steel', NULL, NULL, 500, 100, 5000000, 'q'), ('green', 3, NULL, 'economy_anodized_steel', NULL, 200, 200, NULL, 'y'), ('green', 4, 'economy_anodized_steel', NULL, NULL, 300, 50, 2000000, 'z'), ('red', 5, NULL, NULL, 'Brand#13', 600, 0, NULL, 'b')"
RULE_SCHEMA = "card string, rule int, category string, excluded string, brand string, rate int, after int, room long, cap string, valid_from date, valid_to date"
BEST_SQL = f"""{ITEM_SQL}, buys AS (SELECT row_number() OVER (ORDER BY order_id, line_no, sku, cents, discount) AS n, order_id AS id, sum(cents) OVER (PARTITION BY order_id) AS total, category, brand FROM item),
p AS (SELECT id, max(total) AS cents, min(category) AS category, min(brand) AS brand FROM buys GROUP BY id),
rules(card, rule, category, excluded, brand, rate, after, room, cap) AS (VALUES {RULE_ROWS}),
met AS (SELECT p.id, p.cents, r.card, r.rule, r.cap, least(p.cents, coalesce(r.room, p.cents)) * r.rate + (p.cents - least(p.cents, coalesce(r.room, p.cents))) * r.after AS value
        FROM p JOIN rules r ON (r.category IS NULL OR r.category = p.category OR r.category = split_part(p.category, '.', 1)) AND coalesce(r.excluded <> split_part(p.category, '.', 1), true) AND (r.brand IS NULL OR r.brand = p.brand)),
best AS (SELECT id, card, rule, CAST(value AS BIGINT) AS value FROM met QUALIFY row_number() OVER (PARTITION BY id, card ORDER BY value DESC, rule) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, card) AS rank FROM best)"""


def _rules(spark):
    rows = [(c, n, cat, ex, b, rate, after, room, cap, None, None) for c, n, cat, ex, b, rate, after, room, cap in eval(f"[{RULE_ROWS}]", {"NULL": None})]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _purchases(spark, d):
    return item(spark, d).groupBy(F.col("order_id").alias("id")).agg(F.sum("cents").alias("cents"), F.min("category").alias("category"), F.min("brand").alias("brand")).withColumn("day", day("2026-01-01"))


@query(f"WITH {BEST_SQL} SELECT id, card, rule, value, CAST(rank AS INTEGER) AS rank FROM rk")
def ranked_cards(spark, d):
    return rewards.ranked(rewards.best_rules(_purchases(spark, d), _rules(spark)))


@query(f"""WITH {BEST_SQL}, t AS (SELECT id, card AS better, value FROM rk WHERE rank = 1)
SELECT t.id, 'blue' AS used, better, t.value - coalesce(b.value, 0) AS missed FROM t LEFT JOIN best b ON b.id = t.id AND b.card = 'blue' WHERE t.value - coalesce(b.value, 0) > 0""")
def missed_rewards(spark, d):
    p = _purchases(spark, d)
    return rewards.missed(p.withColumn("used", F.lit("blue")), rewards.best_rules(p, _rules(spark)))


@query(f"WITH {BEST_SQL}, h AS (SELECT DISTINCT card, cap, id, cents FROM met) SELECT card, cap, CAST(sum(cents) AS BIGINT) AS spent FROM h GROUP BY ALL")
def cap_use(spark, d):
    return rewards.cap_use(_purchases(spark, d), _rules(spark))


@query(f"WITH {BEST_SQL} SELECT id, CAST(max(value) FILTER (rank = 1) * 1000 // max(value) FILTER (rank = 2) AS BIGINT) AS permille FROM rk WHERE rank <= 2 GROUP BY id HAVING max(value) FILTER (rank = 2) > 0")
def break_even(spark, d):
    return rewards.break_even(rewards.best_rules(_purchases(spark, d), _rules(spark)), F.col("cents"))


@query(f"""WITH {TXN_SQL}, s AS (SELECT account AS statement, sum(cents) // 100 AS stated FROM txn WHERE cents > 0 GROUP BY account), p AS (SELECT account AS statement, sum(cents // 100) AS predicted FROM txn WHERE cents > 0 AND id % 7 > 0 GROUP BY account)
SELECT statement, CAST(stated - coalesce(predicted, 0) AS BIGINT) AS delta, abs(stated - coalesce(predicted, 0)) >= 200 AND abs(stated - coalesce(predicted, 0)) * 10 > abs(stated) AS flagged FROM s LEFT JOIN p USING (statement)""")
def rewards_check(spark, d):
    t = txn(spark, d).filter("cents > 0")
    stated = t.groupBy(F.col("account").alias("statement")).agg(F.expr("sum(cents) div 100").alias("stated"))
    predicted = t.filter("id % 7 > 0").groupBy(F.col("account").alias("statement")).agg(F.sum(F.expr("cents div 100")).alias("predicted"))
    return rewards.rewards_check(stated, predicted).select("statement", "delta", "flagged")


# Series

@query(f"WITH {SERIES_SQL} SELECT account, month, cents FROM ser")
def monthly_series(spark, d):
    return _series(spark, d).select("account", "month", "cents")


@query(f"""WITH {TXN_SQL}, p AS (SELECT *, CASE WHEN cents < 0 THEN 1 ELSE 3 END AS c FROM txn), u AS (SELECT *, unnest(range(c)) AS i FROM p)
SELECT account, id, strftime(CAST(date_trunc('month', day) AS DATE) + to_months(CAST(CASE WHEN id % 2 = 0 THEN i ELSE i - c + 1 END AS INTEGER)), '%Y-%m') AS month,
CAST(sign(cents) * (abs(cents) // c + CASE WHEN i < abs(cents) % c THEN 1 ELSE 0 END) AS BIGINT) AS cents FROM u""")
def payment_placement(spark, d):
    return series.place(txn(spark, d).withColumn("covers", F.lit(3)).withColumn("ahead", F.expr("id % 2 = 0")))


@query(f"""WITH {TXN_SQL}, p AS (SELECT account, day, day - lag(day) OVER (PARTITION BY account ORDER BY day, id) AS gap, row_number() OVER (PARTITION BY account ORDER BY day DESC, id DESC) AS n FROM txn WHERE cents > 0),
g AS (SELECT account, max(day) AS last_day, median(gap) FILTER (n <= 5) AS m FROM p WHERE n <= 6 GROUP BY account)
SELECT account, last_day, CAST(coalesce(round_even(m, 0), 30) AS INTEGER) AS gap, last_day + CAST(coalesce(round_even(m, 0), 30) AS INTEGER) AS next_day FROM g""")
def cadence(spark, d):
    return series.cadence(txn(spark, d))


@query(f"""WITH {TXN_SQL}, b AS (SELECT id, cents, CASE WHEN count(*) OVER w >= 2 THEN median(cents) OVER w END AS m FROM txn WHERE cents > 0 WINDOW w AS (PARTITION BY account ORDER BY day, id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT id, CAST(round_even(m, 0) AS BIGINT) AS typical, coalesce(cents * 10 >= CAST(round_even(m, 0) AS BIGINT) * 13, false) AS unusual FROM b""")
def unusual_payments(spark, d):
    return series.baseline(txn(spark, d).filter("cents > 0")).select("id", "typical", "unusual")


@query(f"WITH {SERIES_SQL} SELECT account, month, cents, lag(cents, 12) OVER w AS before, cents - lag(cents, 12) OVER w AS change FROM ser WINDOW w AS (PARTITION BY account ORDER BY first)")
def year_over_year(spark, d):
    return series.year_over_year(_series(spark, d))


DOUBLE_SQL = f"{BANK_SQL}, b AS (SELECT id, account, day, abs(cents) // 100 AS cents FROM bank)"


@query(f"WITH {DOUBLE_SQL} SELECT a.account, a.id AS id_a, b.id AS id_b, a.cents, CAST(b.day - a.day AS INTEGER) AS apart FROM b a JOIN b ON a.account = b.account AND a.cents = b.cents AND (a.day < b.day OR (a.day = b.day AND a.id < b.id)) AND b.day - a.day <= 7")
def double_payments(spark, d):
    return series.double_payments(bank(spark, d).withColumn("cents", F.floor(F.abs("cents") / 100).cast("long")))


FLAT_SQL = SERIES_SQL.replace("sum(cents) AS cents FROM txn", "5000 * count(*) AS cents FROM txn")


@query(f"""WITH {FLAT_SQL}, c AS (SELECT *, CASE WHEN cents = lag(cents) OVER w THEN 0 ELSE 1 END AS ch FROM ser WINDOW w AS (PARTITION BY account ORDER BY first)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY account ORDER BY first) AS isl FROM c),
r AS (SELECT account, isl, min(month) AS from_month, max(month) AS to_month, count(*) AS months, min(cents) AS cents FROM i GROUP BY ALL)
SELECT account, from_month, to_month, months, cents FROM r QUALIFY row_number() OVER (PARTITION BY account ORDER BY to_month DESC) = 1 AND months >= 2 AND cents > 0""")
def budget_plans(spark, d):
    flat = series.monthly(txn(spark, d).withColumn("cents", F.lit(5000).cast("long")))
    return series.budget_plans(flat, 2)


@query(f"WITH {SERIES_SQL} SELECT account, month, cents, CAST(CASE WHEN count(*) OVER w = 12 THEN sum(cents) OVER w END AS BIGINT) AS sum FROM ser WINDOW w AS (PARTITION BY account ORDER BY first ROWS 11 PRECEDING)")
def trailing_sums(spark, d):
    return series.trailing_sum(_series(spark, d))


@query(f"""WITH {SERIES_SQL}, l AS (SELECT *, 12 - row_number() OVER (PARTITION BY account ORDER BY first DESC) AS i FROM ser QUALIFY i >= 0),
f AS (SELECT account, sum(cents) AS total FROM l GROUP BY account HAVING count(*) = 12),
s AS (SELECT a.account, a.month, a.i, sum(b.cents) AS cents FROM l a JOIN l b ON a.account = b.account AND (b.i - a.i + 12) % 12 < 5 GROUP BY ALL)
SELECT s.account, month AS start_month, CAST(cents AS BIGINT) AS cents, CAST(total AS BIGINT) AS total FROM s JOIN f USING (account) QUALIFY row_number() OVER (PARTITION BY s.account ORDER BY cents DESC, i) = 1""")
def seasons(spark, d):
    return series.season(_series(spark, d))


@query(f"""WITH {BANK_SQL}, s AS (SELECT account % 40 AS service, account, min(day) AS a, max(day) AS b FROM bank GROUP BY account)
SELECT x.service, x.account AS old_account, y.account AS new_account FROM s x JOIN s y ON x.service = y.service AND x.account <> y.account AND abs(y.a - x.b) <= 45 AND x.a < y.a""")
def provider_switches(spark, d):
    return series.provider_switches(bank(spark, d).withColumn("service", F.expr("account % 40")))


@query()
def drift_fix(spark, d):
    return series.fix_drift(txn(spark, d).withColumn("first", F.trunc("day", "MM")).select("account", "id", "first", "day", "cents"))


@query()
def flat_steps(spark, d):
    return series.flat_steps(txn(spark, d).select("account", "id", "day", "cents"), tolerance=5_000_000)


# Knowledge


@query("""WITH t AS (SELECT doc_id, text FROM documents) SELECT doc_id AS doc, CASE WHEN length(coalesce(text, '')) < 1500 THEN 'thin' WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'stored' END AS state FROM t""")
def store_if_changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256)
    return knowledge.store_if_changed(docs, docs.filter("doc % 2 = 0").select("doc", digest.alias("hash"))).select("doc", "state")


@query()
def verify_quotes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    quotes = docs.select(F.col("doc").alias("quote_id"), "doc", F.pmod("doc", F.lit(4)).cast("int").alias("page"), F.upper(F.substring("text", 30, 60)).alias("quote"))
    return knowledge.verify_quotes(quotes, docs)


@query()
def page_budget(spark, d):
    pages = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(97)).alias("doc"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return knowledge.page_budget(knowledge.page_scores(pages, ["the", "und"]), 20_000)


@query()
def name_suggestions(spark, d):
    p = table(spark, d, "part").select(text.normalize_alias(F.col("p_name")).alias("alias")).distinct()
    asked = p.select(F.concat("alias", F.lit("s")).alias("name"))
    return knowledge.suggestions(asked, p)


# Scalar functions


@query(r"""SELECT page_id, coalesce('https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)
|| CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END) AS url FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref)=')) AS q FROM pages)""")
def normalized_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalize_url(F.col("url")).alias("url"))


@query(f"""WITH {TXN_SQL} SELECT id, cents FROM txn""")
def parsed_cents(spark, d):
    t = txn(spark, d)
    whole, rest = F.floor(F.abs("cents") / 100), F.lpad((F.abs("cents") % 100).cast("string"), 2, "0")
    shown = F.concat(F.when(F.col("cents") < 0, "(").otherwise(""), F.lit("$ "), F.format_number(whole, 0), F.lit("."), rest, F.when(F.col("cents") < 0, ")").otherwise(""))
    return t.select("id", money.to_cents(shown).alias("cents"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]{4,}'))) AS n FROM documents")
def keyword_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.size(text.keywords(F.col("text"), ["ZZZZ"])).cast("long").alias("n"))


# More of the surface


@query(f"""WITH {LINES_SQL}, m AS (SELECT strftime(unnest(generate_series(CAST(date_trunc('month', min(day)) AS TIMESTAMP), CAST(date_trunc('month', max(day)) AS TIMESTAMP), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM lines)
SELECT m.month, CAST(coalesce(sum(cents), 0) AS BIGINT) AS total, CAST(coalesce(sum(cents) FILTER (grp IN ('1-URGENT', '5-LOW')), 0) AS BIGINT) AS in_groups, CAST(coalesce(sum(cents) FILTER (starts_with(grp, '4')), 0) AS BIGINT) AS with_prefix
FROM m LEFT JOIN lines ON m.month = lines.month GROUP BY m.month""")
def conditional_trend(spark, d):
    return spending.conditional_trend(_lines(spark, d), ["1-URGENT", "5-LOW"], "4")


MATCHED_SQL = f"""{TXN_SQL}, {ITEM_SQL}, ord AS (SELECT order_id, CAST(sum(cents) AS BIGINT) AS subtotal, CAST(sum(cents) // 11 AS BIGINT) AS tax FROM item GROUP BY order_id),
f AS (SELECT order_id, arg_max(cents, (line_no, sku, cents)) AS line FROM item GROUP BY order_id),
m AS (SELECT t.id, t.id AS order_id, CASE WHEN t.id % 5 = 0 THEN 'user' END AS source, CASE WHEN t.type <> 'refund' THEN t.cents
  WHEN t.id % 3 = 0 THEN -f.line WHEN t.id % 3 = 1 THEN -(f.line + (2 * ord.tax * f.line + ord.subtotal) // (2 * ord.subtotal)) ELSE t.cents END AS cents
  FROM txn t JOIN f ON f.order_id = t.id JOIN ord ON ord.order_id = t.id WHERE t.type <> 'payment'),
hit AS (SELECT m.id, arg_min(i.category, (i.line_no, i.category)) AS category, any_value(m.cents) AS cents FROM m JOIN item i USING (order_id) JOIN ord USING (order_id)
  WHERE m.source IS NULL AND m.cents < 0 AND -m.cents IN (i.cents, i.cents + (2 * tax * i.cents + subtotal) // (2 * subtotal)) GROUP BY m.id)"""


@query(f"WITH {MATCHED_SQL} SELECT * FROM hit")
def refund_to_one_item(spark, d):
    t, items, orders = _matched(spark, d)
    return split.refund_item(t.filter("cents < 0 and category_source is null").select("id", "order_id", "cents"), items, orders)


@query(f"""WITH {MATCHED_SQL}, w AS (SELECT m.id, m.cents AS total, i.line_no, i.category, CAST(greatest(i.cents - i.discount, 0) AS HUGEINT) AS w FROM m JOIN item i USING (order_id) WHERE source IS NULL AND m.id NOT IN (SELECT id FROM hit)),
q AS (SELECT *, sum(w) OVER (PARTITION BY id) AS s FROM w), r AS (SELECT *, abs(total) * w // s AS q, abs(total) * w % s AS rest FROM q),
k AS (SELECT *, abs(total) - sum(q) OVER (PARTITION BY id) AS short, row_number() OVER (PARTITION BY id ORDER BY rest DESC, line_no, category, w) AS nth FROM r)
SELECT id, category, CAST(sum(sign(total) * (q + CASE WHEN nth <= short THEN 1 ELSE 0 END)) AS BIGINT) AS cents FROM k GROUP BY id, category HAVING sum(q + CASE WHEN nth <= short THEN 1 ELSE 0 END) <> 0
UNION ALL SELECT * FROM hit""")
def matched_allocations(spark, d):
    return split.allocate_matched(*_matched(spark, d))


def _matched(spark, d):
    """Transactions matched to orders, some refunds being one line's price with or without its tax; items; orders."""
    items = item(spark, d)
    orders = items.groupBy("order_id").agg(F.sum("cents").alias("subtotal"), F.max_by("cents", F.struct("line_no", "sku", "cents")).alias("line")).withColumn("tax", F.expr("subtotal div 11"))
    t = txn(spark, d).filter("type <> 'payment'").join(orders.withColumnRenamed("order_id", "id"), "id")
    cents_ = F.expr("CASE WHEN type <> 'refund' THEN cents WHEN id % 3 = 0 THEN -line WHEN id % 3 = 1 THEN -(line + (2 * tax * line + subtotal) div (2 * subtotal)) ELSE cents END")
    return t.select("id", F.col("id").alias("order_id"), cents_.alias("cents"), F.when(F.expr("id % 5 = 0"), "user").alias("category_source")), items, orders.select("order_id", "subtotal", "tax")


@query(f"""WITH {TXN_SQL}, p AS (SELECT id, account, day, grp FROM txn), a(account, pattern, f, t) AS (VALUES (1, 'urgent', DATE '1996-01-01', NULL), (2, 'low|high', NULL, DATE '1998-01-01'), (3, 'high', NULL, NULL)),
h AS (SELECT p.id, min(a.account) AS account, count(DISTINCT a.account) AS n FROM p JOIN a ON regexp_matches(lower(grp), pattern) AND (f IS NULL OR day >= f - 60) AND (t IS NULL OR day <= t + 60) GROUP BY p.id)
SELECT p.id, CASE WHEN p.id % 50 = 1 THEN CASE WHEN p.id % 100 = 1 THEN '9' END WHEN n = 1 THEN CAST(h.account AS VARCHAR) END AS account,
CASE WHEN p.id % 50 = 1 THEN 'override' WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'several' ELSE 'none' END AS status FROM p LEFT JOIN h ON p.id = h.id""")
def utility_links(spark, d):
    payments = txn(spark, d).select("id", "day", F.col("grp").alias("text"))
    accounts = spark.sql("SELECT * FROM VALUES ('1', 'urgent', DATE '1996-01-01', CAST(NULL AS DATE)), ('2', 'low|high', NULL, DATE '1998-01-01'), ('3', 'high', NULL, NULL) AS a(account, pattern, active_from, active_to)")
    own = payments.filter("id % 50 = 1").select("id", F.when(F.expr("id % 100 = 1"), "9").otherwise("none").alias("account"))
    return classify.link_bills(payments, accounts, own)


@query("""WITH s AS (SELECT o_custkey AS card, CAST(o_orderdate AS DATE) AS snapshot_day, o_orderkey AS offer, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) AS expires FROM orders),
l AS (SELECT card, max(snapshot_day) AS snapshot_day FROM s GROUP BY card)
SELECT card, offer, expires, DATE '2001-08-15' - snapshot_day > 21 AS stale FROM s JOIN l USING (card, snapshot_day) WHERE expires >= DATE '2001-08-15'""")
def current_offers(spark, d):
    o = table(spark, d, "orders")
    made = F.col("o_orderdate").cast("date")
    s = o.select(F.col("o_custkey").alias("card"), made.alias("snapshot_day"), F.col("o_orderkey").alias("offer"), F.date_add(made, (F.col("o_orderkey") % 900).cast("int")).alias("expires"))
    return knowledge.current_offers(s, day("2001-08-15")).select("card", "offer", "expires", "stale")


@query("""SELECT s_suppkey AS card, CASE WHEN s_suppkey % 5 = 0 THEN 'published' WHEN s_suppkey % 3 = 0 THEN 'unchanged' WHEN s_suppkey % 3 = 1 THEN 'rejected_before' ELSE 'pending' END AS state,
CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 1 END WHEN s_suppkey % 3 = 1 THEN 2 ELSE 2 END AS version FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 3 = 1)""")
def profile_versions(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("card")).filter("not (card % 5 = 0 and card % 3 = 1)")
    active = s.filter("card % 5 <> 0").select("card", F.lit(1).alias("version"), F.when(F.expr("card % 3 = 0"), "new").otherwise("old").alias("hash"), F.lit("active").alias("status"))
    rejected = s.filter("card % 3 = 1").select("card", F.lit(1).alias("version"), F.lit("new").alias("hash"), F.lit("rejected").alias("status"))
    return knowledge.propose(active.unionByName(rejected), s.select("card", F.lit("new").alias("hash"))).select("card", "state", "version")


@query(f"""WITH {BANK_SQL} SELECT strftime(day, '%Y-%m-%d') AS day, bank_type AS event_type, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents FROM bank GROUP BY ALL""")
def windowed_flow(spark, d):
    """The streaming aggregation, on a bounded table: the same plan as on a stream."""
    from ledgerkit.streaming.ingest import windowed_flow as flow

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", cents("value").alias("raw"))
    rows = e.withColumn("cents", F.when(F.col("event_type").isin("purchase", "error"), F.col("raw")).otherwise(-F.col("raw")))
    return flow(rows).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "rows", "cents")


@query("SELECT p_partkey, CAST(CASE WHEN p_size < 20 THEN 0 WHEN p_partkey % 2 = 0 THEN 500 ELSE least(p_size * 1000 // 10000, 4) END AS BIGINT) AS value FROM part")
def offer_values(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.expr("p_partkey % 2 = 0"), "cash").otherwise("percent")
    amount = F.when(kind == "cash", 500).otherwise(1000)
    value = rewards.offer_value(kind, amount, F.lit(4), F.lit(20), F.col("p_size").cast("long"))
    return p.select("p_partkey", value.cast("long").alias("value"))


# Sources


@query(f"""WITH {TXN_SQL} SELECT ['a', 'b', 'c'][1 + id % 3] AS layout, id + 2 AS line, CASE WHEN id % 3 = 1 AND id % 4 = 0 THEN 'pending' ELSE 'posted' END AS state,
day AS post_date, cents, CASE WHEN cents > 0 THEN 'purchase' ELSE 'credit' END AS type FROM txn""")
def export_rows(spark, d):
    """Orders printed as the lines of three exports, and read back; amounts of the second have unquoted commas."""
    t = txn(spark, d)
    date, plain = F.date_format("day", "MM/dd/yyyy"), (F.col("cents").cast("decimal(24,2)") / 100).cast("decimal(24,2)")
    shown = F.concat(F.when(F.col("cents") < 0, "-$ ").otherwise("$ "), F.format_number(F.abs(plain), 2))
    a = F.concat_ws(",", date, date, F.lit('"STORE, ""ONE"""'), F.lit(""), F.lit("Sale"), (-plain).cast("string"), F.lit(""))
    b = F.concat_ws(",", F.when(F.expr("id % 4 = 0"), "Pending").otherwise("Cleared"), date, F.lit("STORE"), F.when(F.col("cents") > 0, shown).otherwise(""), F.when(F.col("cents") > 0, "").otherwise(shown), F.lit("A B"))
    c = F.concat_ws(",", date, F.lit("A  STORE"), plain.cast("string"))
    layouts = {"a": exports.LAYOUT_A, "b": exports.LAYOUT_B, "c": exports.LAYOUT_C}
    kind = F.element_at(F.array(*map(F.lit, layouts)), (F.col("id") % 3 + 1).cast("int"))
    heads = spark.createDataFrame([(k, 0, ",".join(v)) for k, v in layouts.items()], "file string, at int, value string")
    lines = t.select(kind.alias("file"), (F.col("id") + 1).cast("int").alias("at"), F.when(kind == "a", a).when(kind == "b", b).otherwise(c).alias("value"))
    rows = exports.export_rows(exports.with_headers(heads.unionByName(lines)))
    return rows.select("layout", F.col("line").cast("long").alias("line"), "state", "post_date", "cents", "type")


# Listings

FLOWS = ["card_payment", "fee", "refund", "p2p", "check", "atm", "income", "investment"]


@query(f"""WITH {BANK_SQL}, f AS (SELECT id, cents, {FLOWS}[1 + id % 8] AS flow FROM bank)
SELECT id, CASE WHEN flow IN ('card_payment', 'investment') THEN 'transfer' WHEN flow IN ('fee', 'refund') THEN flow WHEN flow IN ('p2p', 'check', 'atm') THEN CASE WHEN cents > 0 THEN 'purchase' ELSE 'deposit' END ELSE 'deposit' END AS type,
CASE WHEN flow IN ('fee', 'refund') THEN NULL WHEN flow IN ('check', 'atm') AND cents <= 0 THEN 'other_in' ELSE flow END AS flow_kind FROM f""")
def flow_classes(spark, d):
    flow = F.element_at(F.array(*map(F.lit, FLOWS)), (F.col("id") % 8 + 1).cast("int"))
    return bank(spark, d).select("id", views.flow_class(flow, F.col("cents")).alias("c")).select("id", "c.type", "c.flow_kind")


@query(f"""WITH {BANK_SQL} SELECT id, CASE WHEN id % 5 > 0 THEN bank_type IN ('purchase', 'view') ELSE cents > 0 END AS hit FROM bank""")
def flow_or_type(spark, d):
    rows = bank(spark, d).select("id", F.when(F.expr("id % 5 > 0"), F.col("bank_type")).alias("flow_kind"), F.when(F.col("cents") > 0, "view").otherwise("none").alias("type"))
    return rows.select("id", views.flow_or_type(["purchase", "view"]).alias("hit"))


@query(f"""WITH {LINES_SQL}, s AS (SELECT split_part(category, '.', 1) AS category, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY cents DESC, category) AS INTEGER) AS rank, category, cents FROM s WHERE cents > 0 AND category <> 'uncategorized'""")
def category_rank(spark, d):
    return views.category_rank(_lines(spark, d))


@query(f"WITH {LINES_SQL} SELECT month, grp, CAST(sum(cents) AS BIGINT) AS cents FROM lines GROUP BY GROUPING SETS ((month, grp), (month), (grp), ())")
def column_totals(spark, d):
    return views.column_totals(_lines(spark, d), "grp").select("month", "grp", "cents")


@query(f"""WITH {BANK_SQL}, r AS (SELECT CAST(id AS VARCHAR) AS ref_id, CASE WHEN id % 3 = 0 THEN 'open' ELSE 'closed' END AS status, CASE WHEN id % 2 = 0 THEN 'transactions' ELSE 'orders' END AS ref_table FROM bank)
SELECT id, cents FROM bank WHERE CAST(id AS VARCHAR) IN (SELECT ref_id FROM r WHERE status = 'open' AND ref_table = 'transactions')""")
def in_open_review(spark, d):
    rows = bank(spark, d)
    return views.in_open_review(rows, _reviews(rows)).select("id", "cents")


@query(f"WITH {BANK_SQL} SELECT bank_type AS kind, count(*) AS open FROM bank WHERE id % 3 = 0 GROUP BY ALL")
def reviews_by_kind(spark, d):
    return views.reviews_by_kind(_reviews(bank(spark, d)))


def _reviews(rows):
    return rows.select(F.col("id").cast("string").alias("ref_id"), F.col("bank_type").alias("kind"), F.when(F.expr("id % 3 = 0"), "open").otherwise("closed").alias("status"), F.when(F.expr("id % 2 = 0"), "transactions").otherwise("orders").alias("ref_table"))


@query(f"""WITH {TXN_SQL}, p AS (SELECT account, count(*) AS payments, max(day) AS last_day, arg_max(cents, (day, id)) AS last_cents FROM txn WHERE cents > 0 GROUP BY account)
SELECT c_custkey AS account, coalesce(payments, 0) AS payments, last_day, last_cents, CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS open_items FROM customer LEFT JOIN p ON account = c_custkey""")
def account_status(spark, d):
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("account"))
    reviews = accounts.filter("account % 4 = 0").select(F.explode(F.array(F.lit(1), F.lit(2))), F.col("account").alias("ref_id"), F.lit("utility_missing").alias("kind"), F.lit("open").alias("status"), F.lit("utility_accounts").alias("ref_table"))
    return views.account_status(accounts, txn(spark, d).filter("cents > 0"), reviews).select("account", "payments", "last_day", "last_cents", "open_items")


@query(f"""WITH {TXN_SQL}, f AS (SELECT account, min(day) AS first FROM txn WHERE cents > 0 GROUP BY account)
SELECT account, first - DATE '1994-01-01' >= 45 OR (account % 2 = 0 AND first - DATE '1993-06-01' BETWEEN 0 AND 60) AS first_is_new FROM f""")
def first_payments(spark, d):
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.when(F.expr("c_custkey % 2 = 0"), day("1993-06-01")).alias("active_from"))
    return views.first_is_new(txn(spark, d).withColumn("history_start", day("1994-01-01")), accounts)


@query(f"""WITH {TXN_SQL}, b AS (SELECT account, list_sort(list(cents)) AS c FROM txn GROUP BY account) SELECT account, c[1 + len(c) // 2] AS typical FROM b""")
def typical_cents(spark, d):
    return txn(spark, d).groupBy("account").agg(F.collect_list("cents").alias("c")).select("account", views.upper_median(F.col("c")).alias("typical"))


@query()
def statement_links(spark, d):
    """Orders as statement lines, a day or more late, linked to the orders as exported rows."""
    t = txn(spark, d).filter("id % 7 > 0")
    text_ = F.concat(F.lit("STORE NO "), F.col("grp"))
    rows = t.select("id", F.col("account").alias("card"), "day", "cents", text_.alias("text"))
    lines = t.select("id", F.col("account").alias("card"), F.last_day("day").alias("period_end"), F.col("id").alias("line_no"), F.date_add("day", (F.col("id") % 5).cast("int")).alias("day"), "cents", text_.alias("text"))
    return statements.link_lines(lines, rows)
