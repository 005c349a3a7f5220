"""WARC revisits: resolve "not modified" records to the latest earlier full response.

``resolve`` takes capture records (record_id, url, fetched, kind ``response`` or
``revisit``, headers) and returns one row per revisit.

1. URLs are canonicalised (``canonical_url``).
2. As-of join: for every (url, time) the last response strictly before that
   time.  Responses are first reduced to one per (url, time), the largest record_id.  Times are
   cut into ``buckets`` ranges of about equal size; the last response of each
   (url, bucket) is carried forward over that small table and a window orders only
   the times inside one bucket, so a hot URL is spread over the buckets.
3. Validators (RFC 9111, 4.3.4): a strong entity tag must equal a strong one, a weak one is
   compared without its mark; without a tag the Last-Modified values must be
   equal; without either the response must lack both.
4. Headers: the response's, updated with the revisit's, except for those that
   describe the body or the connection.  Names are lower-cased; of a repeated name the
   last value counts.

``outcome`` is ``resolved``, ``mismatch`` (validators differ: resolved_id names the
response that was checked, headers are null) or ``no_response``.

Defined results: a null url or time never matches (``no_response``); null
headers are empty; null header values are left out; records of any other kind
are ignored; every revisit row gives one row, whatever rows share its record_id, url or
time.  Responses need no record_id and may share one: headers are those of the response
that was found (of responses with one url and time the largest record_id, nulls first, then
the larger validators).  An empty table gives an empty result.  Payloads are not read: ``resolved_id`` names the record that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import written

# Response headers that a "not modified" answer must not change.
KEPT_FROM_RESPONSE = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
URL = r"^(?i)[a-z][a-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: without scheme, user, ``www.``, default port, fragment, tracking parameters and a
    final slash; host in lower case, parameters sorted.  A string that is no URL stays as it is."""
    url = F.trim(url)
    host = F.lower(F.regexp_extract(url, URL, 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    return F.when(url.rlike(URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(url)


def header_entries(headers: Column) -> Column:
    """array<struct<key, value>>: lower-case names, the last value of each, sorted."""
    a = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
                    lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    a = F.filter(a, lambda e: e["value"].isNotNull())
    last = F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a) + 1), lambda o: o["key"] == e["key"]))
    return F.array_sort(last)


def _value(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(1))["value"]


def last_before(events: DataFrame, buckets: int) -> DataFrame:
    """url, fetched, found: for every (url, fetched) the last response (struct ``r``) strictly before it."""
    times = events.groupBy("url", "fetched").agg(F.max("r").alias("r"))  # null where only revisits stand
    edges = times.agg(F.percentile_approx("fetched", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<bigint>"),
                             lambda e: e <= F.col("fetched")))
    times = written(times.withColumn("bucket", bucket))
    ends = times.groupBy("url", "bucket").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("fetched"))).alias("end"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("url", "bucket", F.last("end", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("url", "bucket").orderBy("fetched").rowsBetween(Window.unboundedPreceding, -1)
    own = times.withColumn("own", F.last("r", ignorenulls=True).over(inside))
    return own.join(ends, ["url", "bucket"]).select("url", "fetched", F.coalesce("own", "carried").alias("found"))


def resolve(records: DataFrame, buckets: int = 64) -> DataFrame:
    """record_id, url (canonical), outcome, matched_by, resolved_id, headers (name: value lines) per revisit."""
    rows = written(records.where("kind in ('response', 'revisit')").select(
        F.monotonically_increasing_id().alias("row"), "record_id", canonical_url(F.col("url")).alias("url"),
        F.col("fetched").cast("long").alias("fetched"), "kind", header_entries(F.col("headers")).alias("entries")))
    checked = rows.select("row", "record_id", "url", "fetched", "kind", _value(F.col("entries"), "etag").alias("etag"),
                          _value(F.col("entries"), "last-modified").alias("modified"))
    response = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "modified", "row"))
    events = checked.where("url is not null and fetched is not null").select("url", "fetched", response.alias("r"))
    found = last_before(events, buckets)
    r = checked.where("kind = 'revisit'").drop("kind").join(found, ["url", "fetched"], "left")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    etag, old = F.col("etag"), F.col("found.etag")
    tag_ok = F.when(etag.startswith("W/"), weak(etag) == weak(old)).otherwise((etag == old) & ~old.startswith("W/"))
    by = (F.when(etag.isNotNull(), F.when(F.coalesce(tag_ok, F.lit(False)), F.lit("etag")))
          .when(F.col("modified").isNotNull(), F.when(F.coalesce(F.col("modified") == F.col("found.modified"), F.lit(False)), F.lit("last-modified")))
          .when(old.isNull() & F.col("found.modified").isNull(), F.lit("none")))
    r = r.withColumn("matched_by", F.when(F.col("found").isNotNull(), by))
    r = r.withColumn("outcome", F.when(F.col("found").isNull(), "no_response").when(F.col("matched_by").isNull(), "mismatch").otherwise("resolved"))
    resolved = F.col("outcome") == "resolved"
    r = written(r.select("row", "record_id", "url", "outcome", "matched_by", F.col("found.record_id").alias("resolved_id"),
                         F.when(resolved, F.col("found.row")).alias("of")))
    # headers travel only for resolved revisits; rows are found again by their number, which is theirs alone
    sent = rows.where("kind = 'revisit'").select("row", F.col("entries").alias("sent"))
    stored = rows.where("kind = 'response'").select(F.col("row").alias("of"), F.col("entries").alias("stored"))
    out = r.where(resolved).join(sent, "row").join(stored, "of")
    new = F.filter("sent", lambda e: ~e["key"].isin(*KEPT_FROM_RESPONSE))
    kept = F.filter("stored", lambda e: ~F.exists(new, lambda o: o["key"] == e["key"]))
    merged = F.transform(F.array_sort(F.concat(kept, new)), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    cols = ["record_id", "url", "outcome", "matched_by", "resolved_id"]
    return out.select(*cols, F.array_join(merged, "\n").alias("headers")).union(
        r.where(~resolved).select(*cols, F.lit(None).cast("string")))


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: each page is a full response, some are fetched again.

    Fetches come from a spread of times; repeated fetches change the URL's spelling, weaken or
    change the entity tag, or come before any response.
    """
    p = F.col("page_id")
    t = F.lit(1_600_000_000).cast("long") + p * 7919 % 1_000_003
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    modified = (t - 86_400 - p % 1000).cast("string")
    spelled = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://(www[.])?", "HTTP://WWW."), "#.*$", ""), F.lit("#again"))
    full = F.create_map(*map(F.lit, ("Content-Type", "text/html")), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                        F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Date"), t.cast("string"),
                        F.lit("Cache-Control"), F.concat(F.lit("max-age="), (p % 3 * 60).cast("string")))

    def again(n: int, every: int, delay: int, etag: Column) -> Column:
        when = t + delay
        sent = F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), F.when(p % 4 != 0, modified), F.lit("Date"), when.cast("string"),
                            F.lit("Cache-Control"), F.lit("no-cache"), F.lit("Content-Length"), F.lit("0"), F.lit("X-Cache"), F.lit("HIT"))
        return F.when(p % every == 0, F.struct((p * 8 + n).alias("record_id"), spelled.alias("url"), when.alias("fetched"),
                                               F.lit("revisit").alias("kind"), sent.alias("headers")))

    first = F.struct((p * 8).alias("record_id"), F.col("url"), t.alias("fetched"), F.lit("response").alias("kind"), full.alias("headers"))
    log = pages.select(F.explode(F.array(
        first, again(1, 2, 3600, tag), again(2, 5, 7200, F.concat(F.lit("W/"), tag)),
        again(3, 7, 9000, F.concat(F.lit('"x'), F.substring(tag, 3, 100))), again(4, 11, -50, tag),
        again(5, 3, 10_800, F.lit(None).cast("string")))).alias("r"))
    return log.where("r is not null").select("r.*")


ORACLE = r"""
WITH log AS (
  SELECT page_id AS p, url, 1600000000 + page_id * 7919 % 1000003 AS t, '"' || md5(coalesce(html, '')) || '"' AS tag,
         octet_length(encode(coalesce(html, ''))) AS size,
         regexp_replace(regexp_replace(url, '^https?://(www[.])?', 'HTTP://WWW.'), '#.*$', '') || '#again' AS spelled
  FROM pages),
rec AS (
  SELECT p * 8 AS record_id, url, t AS fetched, 'response' AS kind, tag AS etag, CAST(t - 86400 - p % 1000 AS VARCHAR) AS modified, p, size FROM log
  UNION ALL SELECT p * 8 + 1, spelled, t + 3600, 'revisit', tag, CASE WHEN p % 4 <> 0 THEN CAST(t - 86400 - p % 1000 AS VARCHAR) END, p, size FROM log WHERE p % 2 = 0
  UNION ALL SELECT p * 8 + 2, spelled, t + 7200, 'revisit', 'W/' || tag, CASE WHEN p % 4 <> 0 THEN CAST(t - 86400 - p % 1000 AS VARCHAR) END, p, size FROM log WHERE p % 5 = 0
  UNION ALL SELECT p * 8 + 3, spelled, t + 9000, 'revisit', '"x' || substr(tag, 3), CASE WHEN p % 4 <> 0 THEN CAST(t - 86400 - p % 1000 AS VARCHAR) END, p, size FROM log WHERE p % 7 = 0
  UNION ALL SELECT p * 8 + 4, spelled, t - 50, 'revisit', tag, CASE WHEN p % 4 <> 0 THEN CAST(t - 86400 - p % 1000 AS VARCHAR) END, p, size FROM log WHERE p % 11 = 0
  UNION ALL SELECT p * 8 + 5, spelled, t + 10800, 'revisit', NULL, CASE WHEN p % 4 <> 0 THEN CAST(t - 86400 - p % 1000 AS VARCHAR) END, p, size FROM log WHERE p % 3 = 0),
parts AS (
  SELECT *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['host', 'path', 'query']) AS u FROM rec),
canon AS (
  SELECT record_id, fetched, kind, etag, modified, p, size,
         regexp_replace(regexp_replace(regexp_replace(lower(u.host), '^[^@]*@', ''), ':(80|443)?$', ''), '^www\.', '')
         || regexp_replace(u.path, '/+$', '')
         || CASE WHEN len(list_filter(string_split(u.query, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) > 0
                 THEN '?' || array_to_string(list_sort(list_filter(string_split(u.query, '&'),
                      lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))), '&') ELSE '' END AS url
  FROM parts),
resp AS (
  SELECT url, fetched, max(record_id) AS resolved_id, arg_max(etag, record_id) AS old_etag, arg_max(modified, record_id) AS old_modified,
         arg_max(p, record_id) AS old_p, arg_max(size, record_id) AS old_size
  FROM canon WHERE kind = 'response' GROUP BY url, fetched),
found AS (
  SELECT v.*, r.resolved_id, r.old_etag, r.old_modified, r.old_p, r.old_size, r.fetched AS old_time
  FROM (SELECT * FROM canon WHERE kind = 'revisit') v ASOF LEFT JOIN resp r ON v.url = r.url AND v.fetched > r.fetched),
judged AS (
  SELECT *, CASE WHEN resolved_id IS NULL THEN NULL
    WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = old_etag THEN 'etag' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = old_modified THEN 'last-modified' END END AS matched_by
  FROM found)
SELECT record_id, url,
  CASE WHEN resolved_id IS NULL THEN 'no_response' WHEN matched_by IS NULL THEN 'mismatch' ELSE 'resolved' END AS outcome,
  matched_by, resolved_id,
  CASE WHEN matched_by IS NOT NULL THEN
    'cache-control: no-cache' || chr(10) || 'content-length: ' || old_size || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || fetched || chr(10) || 'etag: ' || coalesce(etag, old_etag) || chr(10)
    || 'last-modified: ' || coalesce(modified, old_modified) || chr(10) || 'x-cache: HIT' END AS headers
FROM judged
"""
