"""WARC: resolution of not-modified revisit records.

A revisit record says that a server answered 304. It is resolved by an as-of join: of the full responses
for the same canonical URL, the latest that is strictly earlier. The entity tags (compared weakly), or else
the last-modified dates, must agree; then the revisit's permitted headers replace the response's.

Scale: the as-of join is a forward fill, done in time buckets so that a URL with a third of all records
is spread over as many groups as its time has buckets. A second fill over one row per URL and bucket
carries the latest response across buckets. The number of buckets follows the number of records.

Defined results: a null or empty URL is no URL and resolves nothing (``no_original``); a null time comes
before all others and precedes nothing; of responses of one time the largest record_id counts; repeated
rows are answered each; extra columns are ignored; an empty table gives an empty result. States:
``resolved``, ``no_original``, ``no_validator`` (neither validator can be compared), ``modified`` (they differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 answer may update (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Records that a time bucket holds on average.
BUCKET_ROWS = 50_000
#: Query parameters that don't name a resource.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid)="


def canonical_url(url: str | Column = "url") -> Column:
    """Host in lower case without ``www.``; path without a trailing slash; sorted query without tracking; no scheme, no fragment."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(original: Column, revisit: Column) -> Column:
    """The original's headers with the revisit's permitted ones in their place."""
    update = F.map_filter(F.coalesce(revisit, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(original, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)


def resolve_revisits(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``records``: record_id, kind ('response' or 'revisit'), url, ts (number or time), etag, last_modified, digest, headers (map).

    One row per revisit: record_id, canonical_url, state, refers_to, digest, headers.
    """
    when = F.col("ts").cast("double")
    rows = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url().alias("canonical_url"), when.alias("ts"), (F.col("kind") == "response").alias("full"), F.struct("etag", "last_modified", "digest", "headers").alias("own"))
    n, low, high = rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first()
    buckets = max(1, -(-n // bucket_rows))
    width = max((high - low) / buckets, 1e-9) if n and low is not None else 1.0
    rows = rows.withColumn("bucket", F.coalesce(F.floor((F.col("ts") - F.lit(low or 0.0)) / width), F.lit(-1)).cast("long"))
    response = F.when(F.col("full") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "own"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy(F.col("ts").asc_nulls_first(), "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(response, ignorenulls=True).over(inside)).filter(~F.col("full"))
    # One row per URL and bucket: the latest response of the buckets before it.
    latest = rows.groupBy("canonical_url", "bucket").agg(F.max_by(response, F.when(response.isNotNull(), F.struct("ts", "record_id"))).alias("latest"))
    earlier = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("canonical_url", "bucket", F.last("latest", ignorenulls=True).over(earlier).alias("far"))
    found = near.join(carried, ["canonical_url", "bucket"]).withColumn("o", F.when((F.col("canonical_url") != "") & F.col("ts").isNotNull(), F.coalesce("near", "far")))
    tags = F.col("own.etag").isNotNull() & F.col("o.own.etag").isNotNull()
    dates = F.col("own.last_modified").isNotNull() & F.col("o.own.last_modified").isNotNull()
    same = F.when(tags, _weak(F.col("own.etag")) == _weak(F.col("o.own.etag"))).when(dates, F.col("own.last_modified") == F.col("o.own.last_modified"))
    state = F.when(F.col("o").isNull(), "no_original").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("modified")
    ok = F.col("state") == "resolved"
    return found.withColumn("state", state).select(
        "record_id", "canonical_url", "state", F.when(ok, F.col("o.record_id")).alias("refers_to"), F.when(ok, F.col("o.own.digest")).alias("digest"), F.when(ok, merged_headers(F.col("o.own.headers"), F.col("own.headers"))).alias("headers")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records made of pages: each page is a response at time page_id and is revisited 40 later.

    By page_id the revisit carries the page's own tag (as a weak one, for every third), a date alone, a
    foreign tag or no validator; so a revisit of a URL that changed meanwhile doesn't resolve.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    date = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(7)).cast("string"))
    full = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("ts"), tag.alias("etag"), date.alias("last_modified"), F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    m = F.pmod(F.col("page_id"), F.lit(12))
    given = F.when(m == 0, None).when(m == 1, None).when(m == 2, F.lit('"other"')).when(m % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") + 40).alias("ts"), given.alias("etag"), F.when(m == 0, date).alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=90"), F.lit("date"), F.concat(F.lit("t"), (F.col("page_id") + 40).cast("string"))).alias("headers"))
    return full.unionByName(again)


def revisit_report(pages: DataFrame) -> DataFrame:
    """The query's digest: headers as sorted text."""
    out = resolve_revisits(records_of_pages(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "canonical_url", "state", "refers_to", "digest", text.alias("headers"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS rest FROM pages),
c AS (
  SELECT page_id, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || (page_id % 7) AS day, sha1(html) AS digest,
         regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '')
         || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS u
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1, 's'), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|fbclid|gclid)='))) AS q FROM p)),
v AS (
  SELECT page_id, u, page_id + 40 AS ts,
         CASE WHEN page_id % 12 IN (0, 1) THEN NULL WHEN page_id % 12 = 2 THEN '"other"'
              WHEN page_id % 12 % 3 = 0 THEN 'W/' || tag ELSE tag END AS etag,
         CASE WHEN page_id % 12 = 0 THEN day END AS day FROM c),
j AS (
  SELECT v.*, o.page_id AS o_id, o.tag AS o_tag, o.day AS o_day, o.digest AS o_digest,
         row_number() OVER (PARTITION BY v.page_id ORDER BY o.page_id DESC NULLS LAST) AS nth
  FROM v LEFT JOIN c o ON v.u = o.u AND v.u <> '' AND o.page_id < v.ts),
s AS (
  SELECT *, CASE WHEN o_id IS NULL THEN 'no_original'
                 WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = o_tag THEN 'resolved' ELSE 'modified' END
                 WHEN day IS NOT NULL THEN CASE WHEN day = o_day THEN 'resolved' ELSE 'modified' END
                 ELSE 'no_validator' END AS state FROM j WHERE nth = 1)
SELECT page_id * 2 + 1 AS record_id, u AS canonical_url, state,
       CASE WHEN state = 'resolved' THEN o_id * 2 END AS refers_to,
       CASE WHEN state = 'resolved' THEN o_digest END AS digest,
       CASE WHEN state = 'resolved' THEN 'cache-control=max-age=90;content-type=text/html;date=t' || ts || ';etag=' || o_tag END AS headers
FROM s
"""
