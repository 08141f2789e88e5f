"""Not-modified revisits resolved to the full responses that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col

#: Headers of a 304 that don't replace those stored: they describe its own connection and (empty) body.
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type")

COLUMNS = ("record_id", "url", "ts", "warc_type", "headers", "payload")


def canonical_url(url: Column) -> Column:
    """A URL without what doesn't tell captures apart.

    Lower-case scheme and host; no user, fragment, default port or "www."; no tracking parameters
    (utm_*, ref, gclid, fbclid, sid), the others sorted; no trailing slash.  http and https are one.
    What has no "://" is only trimmed.
    """
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|gclid|fbclid|sid)(=|$)")))
    whole = F.concat(F.regexp_replace(scheme, "^https$", "http"), F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(url.contains("://") & (host != ""), whole).otherwise(url)


def _header(headers: Column, name: str) -> Column:
    """The value of a header whose name is lower case, or null."""
    return F.element_at(headers, name)


def _lowered(headers: Column) -> Column:
    """Headers by lower-case name; of names that are equal then, the last value in the order of the map."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value"))))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """(record_id, canonical, ts, outcome, response_id, headers, payload) of every revisit record.

    records has record_id, url, ts, warc_type ("response" or "revisit"), headers (a map) and
    payload.  A revisit is held against the latest full response of its canonical URL that is
    earlier (of equal ts: the greatest record_id).  Its validators are checked: the payload
    digest and the ETag (without "W/") where both sides have one, else Last-Modified where both have it.
    outcome is "resolved" (all that could be compared were equal, one at least), "mismatch",
    "unvalidated" (nothing to compare) or "no_response".  A resolved revisit has the response's
    payload and its headers, replaced by the revisit's, other than those which a 304 may not
    change (NOT_MERGED); headers are lines "name: value" by name.  Others have none of these,
    but response_id where a response was found.

    The as-of join is one window over URL and time with no payloads in it, so a URL that is
    captured a million times is sorted on disk and never held; payloads are shuffled once
    more, by record_id, for resolved revisits alone.

    record_id keeps its type, and is compared in its order.  A null or empty URL, a null ts or null
    record_id never matches, and such records take no part in the window; null headers are no headers; names of
    headers are compared in lower case; responses with equal ids and repeated rows count
    once (that of the least payload); repeated revisits give repeated rows; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows = records.select(*(col(c) for c in COLUMNS)).withColumn("ts", F.col("ts").cast("bigint"))
    light = rows.select("record_id", canonical_url(F.col("url").cast("string")).alias("canonical"), "ts", (F.col("warc_type") == "response").alias("full"), _lowered(F.col("headers")).alias("h")).where("full IS NOT NULL")
    known = F.col("full") & F.col("ts").isNotNull() & F.col("record_id").isNotNull() & (F.col("canonical") != "")
    # Equal times must not count as earlier, so the frame is by value, up to one before.
    place = Window.partitionBy("canonical").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    response = F.max(F.when(known, F.struct("ts", "record_id", F.col("h").getItem("etag").alias("etag"), F.col("h").getItem("last-modified").alias("modified"), F.col("h").getItem("warc-payload-digest").alias("digest"), F.array_sort(F.map_entries("h")).alias("h")))).over(place)
    # What can't match would all be in one window; it goes round it.
    able = F.coalesce(F.col("canonical") != "", F.lit(False)) & F.col("ts").isNotNull()
    placed = light.where(able).withColumn("r", response).where("NOT full")
    seen = placed.unionByName(light.where(~able & ~F.col("full")).withColumn("r", F.lit(None).cast(placed.schema["r"].dataType)))
    strong = lambda e: F.regexp_replace(e, r"^[Ww]/", "")
    digest = _header(F.col("h"), "warc-payload-digest") == F.col("r.digest")
    etag = strong(_header(F.col("h"), "etag")) == strong(F.col("r.etag"))
    modified = _header(F.col("h"), "last-modified") == F.col("r.modified")
    strict = F.array_compact(F.array(digest, etag))
    outcome = (
        F.when(F.col("r").isNull(), "no_response")
        .when(F.size(strict) > 0, F.when(F.forall(strict, lambda x: x), "resolved").otherwise("mismatch"))
        .when(modified.isNotNull(), F.when(modified, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    seen = seen.select("record_id", "canonical", "ts", outcome.alias("outcome"), F.col("r.record_id").alias("response_id"), "h", F.col("r.h").alias("stored"))
    mine = F.filter(F.map_entries("h"), lambda e: ~e["key"].isin(*NOT_MERGED))
    names = F.transform(mine, lambda e: e["key"])
    merged = F.array_sort(F.concat(F.filter("stored", lambda e: ~F.array_contains(names, e["key"])), mine))
    lines = F.array_join(F.transform(merged, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    seen = seen.select("record_id", "canonical", "ts", "outcome", "response_id", F.when(F.col("outcome") == "resolved", lines).alias("headers"))
    payloads = rows.where("warc_type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("response_id")).agg(F.min(F.col("payload").cast("string")).alias("payload"))
    done = seen.where("outcome = 'resolved'").join(payloads, "response_id", "left").select(*seen.columns, "payload")
    return done.unionByName(seen.where("outcome <> 'resolved'").withColumn("payload", F.lit(None).cast("string")))


def page_records(pages: DataFrame) -> DataFrame:
    """Records as a recrawl of pages would write them: each page is a response and, mostly later, a revisit.

    A page's number is its time.  The revisit comes 100,000 ticks later, but for each 11th page before
    the response.  Four of five responses have an ETag, the others Last-Modified alone; every 7th revisit's ETag has changed;
    every 13th revisit has no validator.
    """
    n = F.col("page_id")
    etag, date = F.concat(F.lit('"'), F.md5("html"), F.lit('"')), F.concat(F.lit("day "), n.cast("string"))
    has = n % 5 != 0
    response = F.map_filter(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Last-Modified"), date, F.lit("ETag"), F.when(has, etag), F.lit("Cache-Control"), F.lit("max-age=60")), lambda k, v: v.isNotNull())
    revisit = F.map_filter(F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (n % 100).cast("string")), F.lit("Date"), F.concat(F.lit("day "), (n + 100000).cast("string")), F.lit("ETag"), F.when((n % 13 != 0) & has, F.when(n % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag))), F.lit("Last-Modified"), F.when(n % 13 != 0, date)), lambda k, v: v.isNotNull())
    first = pages.select((n * 2).alias("record_id"), "url", n.alias("ts"), F.lit("response").alias("warc_type"), response.alias("headers"), F.col("html").alias("payload"))
    again = pages.select((n * 2 + 1).alias("record_id"), "url", F.when(n % 11 == 0, -1 - n).otherwise(n + 100000).alias("ts"), F.lit("revisit").alias("warc_type"), revisit.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return first.unionByName(again)


_CANONICAL = r"""CASE WHEN contains(trim(url), '://') AND host <> '' THEN
    regexp_replace(scheme, '^https$', 'http') || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE trim(url) END"""

SQL = rf"""
WITH c0 AS (SELECT *, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme,
  regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':(80|443)?$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid|sid)(=|$)'))) AS kept FROM pages),
c AS (SELECT page_id AS n, html, {_CANONICAL} AS canonical, '"' || md5(html) || '"' AS etag FROM c0),
full_ AS (SELECT 2 * n AS record_id, canonical, n AS ts, CASE WHEN n % 5 <> 0 THEN etag END AS etag, 'day ' || n AS modified, html, strlen(html) AS size FROM c),
seen AS (SELECT 2 * n + 1 AS record_id, canonical, CASE WHEN n % 11 = 0 THEN -1 - n ELSE n + 100000 END AS ts, n,
  CASE WHEN n % 13 <> 0 AND n % 5 <> 0 THEN CASE WHEN n % 7 = 0 THEN '"changed"' ELSE etag END END AS etag, CASE WHEN n % 13 <> 0 THEN 'day ' || n END AS modified FROM c),
m AS (SELECT s.*, f.record_id AS response_id, f.etag AS had, f.modified AS had_modified, f.html,
  row_number() OVER (PARTITION BY s.record_id ORDER BY f.ts DESC, f.record_id DESC) AS k
  FROM seen s LEFT JOIN full_ f ON s.canonical = f.canonical AND f.ts < s.ts),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND had IS NOT NULL THEN CASE WHEN etag = had THEN 'resolved' ELSE 'mismatch' END
  WHEN modified IS NOT NULL AND had_modified IS NOT NULL THEN CASE WHEN modified = had_modified THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome FROM m WHERE k = 1)
SELECT record_id, canonical, ts, outcome, response_id,
  CASE WHEN outcome = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=' || (n % 100), 'content-length: ' || strlen(html), 'content-type: text/html', 'date: day ' || (n + 100000),
    'etag: ' || coalesce('W/' || etag, had), 'last-modified: ' || coalesce(modified, had_modified)) END AS headers,
  CASE WHEN outcome = 'resolved' THEN html END AS payload FROM o"""
