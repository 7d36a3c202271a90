"""Operator 5: resolving not-modified revisits of a web archive.

A revisit stands for "nothing changed since the last capture".  It is joined as of its
time to the latest strictly earlier full response of the same canonical URL: responses and
revisits are put in one order per URL, and the last response so far is carried forward,
which needs one shuffle of narrow rows and no range join.  Payloads join at the end, by
record_id.

The validators decide: if the revisit has an ETag it must equal the response's (weak
comparison), else its Last-Modified, else its payload digest.  Headers of the response
then stay, except that those a not-modified answer may renew (RENEWED) take its values.

Outcomes: resolved; mismatch (a validator differs, or the response lacks it); unchecked
(the revisit has no validator at all); missing (no earlier response, or no URL or time).
Only resolved rows have response_id, status, headers and payload.

Defined cases: a null URL or time matches nothing.  Responses at one time tie by the
greater record_id; a response at the time of the revisit is not earlier.  Repeated revisit
rows are each resolved; of response rows with one record_id the least payload counts.
Null header maps count as empty; header names are compared in lower case.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, m and default ports; path without index page and last slash; sorted query without tracking."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www[0-9]*|m)[.]", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/index[.]html?$", "/"), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_join(F.sort_array(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _lower_keys(headers: Column) -> Column:
    """The headers as a sorted array of (name, value); of names equal in lower case the last value counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: F.size(entries) - F.array_position(F.reverse(F.transform(entries, lambda o: o["name"])), e["name"]) == i)
    return F.coalesce(last, F.expr("cast(array() as array<struct<name:string,value:string>>)"))


def _header(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["value"]


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit of records (record_id, url, ts, kind, status, headers, digest, payload).

    kind is 'response' or 'revisit'; headers a map.  The result has record_id, url_key, ts,
    outcome, response_id, status, headers (lines in the order of names) and payload.
    """
    narrow = records.where("kind in ('response', 'revisit')").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").alias("full"), "status", _lower_keys(F.col("headers")).alias("headers"), "digest"
    )
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    base = F.when(F.col("full"), F.struct("record_id", "status", "headers", "digest"))
    # at one time revisits come first, so that a response counts as earlier only if it is
    order = Window.partitionBy("url_key").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.where(usable).withColumn("base", F.last(base, ignorenulls=True).over(order)).where(~F.col("full"))
    lost = narrow.where(~usable & ~F.col("full"))
    revisits = placed.unionByName(lost, allowMissingColumns=True)

    own, old = F.col("headers"), F.col("base.headers")
    tag, since = _header(own, "etag"), _header(own, "last-modified")
    same = (
        F.when(tag.isNotNull(), _strong(tag).eqNullSafe(_strong(_header(old, "etag"))))
        .when(since.isNotNull(), since.eqNullSafe(_header(old, "last-modified")))
        .when(F.col("digest").isNotNull(), F.col("digest").eqNullSafe(F.col("base.digest")))
    )
    outcome = F.when(F.col("base").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    renewed = F.filter(own, lambda e: e["name"].isin(*RENEWED))
    names = F.transform(renewed, lambda e: e["name"])
    merged = F.sort_array(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["name"])), renewed))
    lines = F.array_join(F.transform(merged, lambda e: F.concat(e["name"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    done = revisits.withColumn("outcome", outcome)
    hit = F.col("outcome") == "resolved"
    done = done.select(
        "record_id", "url_key", "ts", "outcome", F.when(hit, F.col("base.record_id")).alias("response_id"), F.when(hit, F.col("base.status")).alias("status"), F.when(hit, lines).alias("headers")
    )
    bodies = records.where("kind = 'response'").groupBy(F.col("record_id").alias("body_id")).agg(F.min("payload").alias("payload"))
    return done.join(bodies, F.col("response_id") == F.col("body_id"), "left").drop("body_id")


def capture_records(pages: DataFrame) -> DataFrame:
    """An archive made of the pages: a full response for each, and a revisit that its MD5 decides about.

    The first hex digit of the page's MD5 gives the hours between the two (0 for none, so
    that no response is earlier), the second whether the server renewed its ETag meanwhile
    (0 to 2), sent only a Last-Modified (3 to 5), or no validator but a digest (6, 7).
    """
    digest = F.md5("html")
    first, second = (F.conv(F.substring("digest", k, 1), 16, 10).cast("int") for k in (1, 2))
    made = F.expr("timestamp_seconds(1704067200 + page_id * 60)")
    base = pages.select("page_id", "url", "html", digest.alias("digest"), made.alias("made"))
    stamp = F.date_format("made", "yyyy-MM-dd HH:mm:ss")
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("made").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), "digest", F.lit('"')), F.lit("Last-Modified"), stamp, F.lit("Server"), F.lit("a")).alias("headers"),
        F.col("digest").alias("digest"), F.col("html").alias("payload"),
    )
    tag = F.when(second <= 2, F.concat(F.lit('"new-'), "digest", F.lit('"'))).when(second >= 8, F.concat(F.lit('W/"'), "digest", F.lit('"')))
    sent = F.create_map(F.lit("Date"), stamp, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Server"), F.lit("b"), F.lit("ETag"), tag, F.lit("Last-Modified"), F.when((second >= 3) & (second <= 5), stamp))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("made") + F.make_dt_interval(F.lit(0), first)).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.map_filter(sent, lambda k, v: v.isNotNull()).alias("headers"), F.when((second == 6) | (second == 7), F.col("digest")).alias("digest"), F.lit(None).cast("string").alias("payload"),
    )
    return base.select("url", F.inline(F.array(response, revisit)))


def op5_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_revisits(capture_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP5_SQL = rf"""
WITH bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b, md5(html) AS digest,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS made,
         ('0x' || substr(md5(html), 1, 1))::INTEGER AS x, ('0x' || substr(md5(html), 2, 1))::INTEGER AS y FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www[0-9]*|m)[.]', '') AS host,
         regexp_replace(regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/index[.]html?$', '/'), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '{_TRACKING}'))), '&') AS query
  FROM bare),
keyed AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, strftime(made, '%Y-%m-%d %H:%M:%S') AS stamp FROM parts),
revisits AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, made + to_hours(x) AS ts, stamp, y,
         CASE WHEN y <= 2 THEN '"new-' || digest || '"' WHEN y >= 8 THEN 'W/"' || digest || '"' END AS tag,
         CASE WHEN y BETWEEN 3 AND 5 THEN stamp END AS since, CASE WHEN y IN (6, 7) THEN digest END AS digest FROM keyed),
responses AS (
  SELECT page_id * 2 AS response_id, url_key, made AS ts, stamp, digest, html,
         lead(made) OVER (PARTITION BY url_key ORDER BY made, page_id) AS until FROM keyed),
joined AS (
  SELECT r.record_id, r.url_key, r.ts, r.stamp AS new_stamp, r.tag, r.since, p.response_id, p.stamp, p.html, p.digest AS old_digest,
         CASE WHEN p.response_id IS NULL THEN 'missing'
              WHEN r.tag IS NOT NULL THEN CASE WHEN regexp_replace(r.tag, '^W/', '') = '"' || p.digest || '"' THEN 'resolved' ELSE 'mismatch' END
              WHEN r.since IS NOT NULL THEN CASE WHEN r.since = p.stamp THEN 'resolved' ELSE 'mismatch' END
              WHEN r.digest IS NOT NULL THEN CASE WHEN r.digest = p.digest THEN 'resolved' ELSE 'mismatch' END
              ELSE 'unchecked' END AS outcome
  FROM revisits r LEFT JOIN responses p ON r.url_key = p.url_key AND p.ts < r.ts AND (p.until IS NULL OR p.until >= r.ts))
SELECT record_id, url_key, ts, outcome, CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, CASE WHEN outcome = 'resolved' THEN 200 END AS status,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || new_stamp || chr(10)
            || 'etag: ' || coalesce(tag, '"' || old_digest || '"') || chr(10) || 'last-modified: ' || coalesce(since, stamp) || chr(10) || 'server: a' END AS headers,
       CASE WHEN outcome = 'resolved' THEN html END AS payload
FROM joined
"""
