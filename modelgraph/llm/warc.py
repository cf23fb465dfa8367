"""Operator 1: not-modified revisits of a web archive resolved to the responses they stand for.

A revisit record (a 304 answer) is joined as of its time to the latest earlier full response of
the same canonical URL. If its validators agree with that response's, the response's body and
headers are taken over, and the headers that a 304 may update replace the stored ones.

The as-of join works on keys alone. Time is cut into slices; the last full response of each URL
and slice is a plain aggregate, what is carried into a slice is a window over slices (bounded by
their number), and only inside a slice are records sorted. So a URL that holds a third of all
records is spread over as many tasks as there are slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from modelgraph.llm.common import checkpointed, table

#: Query parameters that only track the visitor.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"
#: Headers a not-modified answer may update; the others describe the stored body.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Lower-case host without user, default port or leading www; scheme, fragment, tracking
    parameters and a slash at the end dropped; the other parameters in order of their text."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]?[.]", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(u, "^[^?]*[?](.*)$", 1), "&")
    params = F.array_sort(F.filter(params, lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    query = F.array_join(params, "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, slices: int = 256) -> DataFrame:
    """records(record_id, url, ts, status int, headers map<string, string> with lower-case
    names, ...) -> one row per revisit (status 304): record_id, url_key, ts, original_id,
    original_ts, outcome, headers.

    outcome is 'resolved', 'no original' (no earlier full response of the URL) or 'mismatch'.
    Entity tags decide if both have one (weak comparison), else Last-Modified if both have it,
    else there is nothing to check and it is a mismatch; merged headers are null unless
    resolved. Earlier means a smaller (ts, record_id); of responses with equal ones the greater
    etag counts. Records of null url, ts or record_id resolve nothing and, as revisits, have 'no
    original'; a null status is neither; null headers are empty; repeated revisits give repeated
    rows. Bodies and other columns are not read: join them by original_id."""
    h = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    value = lambda name: F.try_element_at(F.filter(h, lambda e: e.key == name), F.lit(1)).value
    r = records.where("status in (200, 304)").select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", F.col("status").cast("int").alias("status"),
        weak(value("etag")).alias("etag"), value("last-modified").alias("modified"), h.alias("h"),
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    r = checkpointed(r.withColumn("t", F.when(F.col("url_key").isNotNull() & F.col("record_id").isNotNull(), micros)))

    # Slices of about equal numbers of records: at most so many bounds come to the driver.
    bounds = r.where("t is not null").approxQuantile("t", [i / slices for i in range(1, slices)], 0.25 / slices)
    cut = F.array(*(F.lit(int(b)) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<long>")
    keyed = r.where("t is not null").withColumn("slice", F.size(F.filter(cut, lambda b: b <= F.col("t"))))

    # Structs compare by ts, then record_id, then the rest.
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "etag", "modified", "h"))
    ends = checkpointed(keyed.groupBy("url_key", "slice").agg(F.max(full).alias("last")))
    before = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = checkpointed(ends.withColumn("carried", F.max("last").over(before)).where("carried is not null").select("url_key", "slice", "carried"))
    inside = Window.partitionBy("url_key", "slice").orderBy("ts", "record_id", F.desc("status")).rowsBetween(Window.unboundedPreceding, -1)
    met = keyed.withColumn("seen", F.max(full).over(inside)).where("status = 304")
    met = met.join(carried, ["url_key", "slice"], "left").withColumn("seen", F.coalesce("seen", "carried")).drop("carried", "slice")
    met = met.unionByName(r.where("t is null and status = 304"), allowMissingColumns=True)

    agrees = (
        F.when(F.col("etag").isNotNull() & F.col("seen.etag").isNotNull(), F.col("etag") == F.col("seen.etag"))
        .when(F.col("modified").isNotNull() & F.col("seen.modified").isNotNull(), F.col("modified") == F.col("seen.modified"))
        .otherwise(False)
    )
    outcome = F.when(F.col("seen").isNull(), "no original").when(agrees, "resolved").otherwise("mismatch")
    new = F.filter("h", lambda e: e.key.isin(*PERMITTED))
    kept = F.filter("seen.h", lambda e: ~F.exists(new, lambda x: x.key == e.key))
    merged = F.map_from_entries(F.array_sort(F.concat(kept, new)))
    return met.withColumn("outcome", outcome).select(
        "record_id", "url_key", "ts", F.col("seen.record_id").alias("original_id"), F.col("seen.ts").alias("original_ts"), "outcome",
        F.when(F.col("outcome") == "resolved", merged).alias("headers"),
    )


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl's records from pages(page_id, url, html): a full response of each page and later
    answers to conditional requests under other spellings of its URL. A few are full again (the
    page has changed), carry another validator, only a date or none, or come before any
    response."""
    page, k = F.col("page_id"), F.col("k")
    digest = F.md5(F.coalesce("html", F.lit("")))
    first = pages.select("page_id", "url", digest.alias("digest"))
    r = first.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).where("k < 3 or page_id % 11 = 0")
    status = F.when((k == 0) | ((k == 1) & (page % 5 == 0)), 200).otherwise(304)
    version = F.when((page % 5 == 0) & (k > 0) & (k < 3), 1).otherwise(0)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit("-"), version.cast("string"), F.lit('"'))
    etag = F.when((k == 2) & (page % 7 == 0), F.lit('"other"')).when((k == 2) & (page % 7 < 3), F.lit(None)).when(k == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when((k == 2) & (page % 7 == 2), F.lit(None)).otherwise(F.concat(F.lit("day "), (page % 1000 + version).cast("string")))
    seconds = F.lit(1704067200) + page * 60 + F.when(k == 3, -86400 * 900).otherwise(k * 86400)
    url = F.when(k == 1, F.regexp_replace("url", "^https?://", "HTTPS://www.")).when(k == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#seen"))).otherwise(F.col("url"))
    heads = {"etag": etag, "last-modified": modified, "date": F.concat(F.lit("t"), seconds.cast("string")), "content-digest": F.when(status == 200, F.concat("digest", F.lit("-"), version.cast("string"))), "content-length": F.when(status == 304, F.lit("0")), "expires": F.when(k > 0, F.lit("later"))}
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in heads.items()))
    headers = F.map_from_entries(F.filter(pairs, lambda e: e.value.isNotNull()))
    return r.select((page * 4 + k).alias("record_id"), url.alias("url"), F.timestamp_seconds(seconds).alias("ts"), status.alias("status"), headers.alias("headers"))


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(crawl(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)))
    return found.select(
        "record_id", "url_key", F.unix_seconds("ts").alias("ts"), "original_id", F.unix_seconds("original_ts").alias("original_ts"), "outcome", F.array_join(lines, "|").alias("headers")
    )


OP1_SQL = r"""
WITH visits AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, unnest([0, 1, 2, 3]) AS k FROM pages),
v AS (SELECT *, CASE WHEN k = 0 OR (k = 1 AND page_id % 5 = 0) THEN 200 ELSE 304 END AS status,
    CASE WHEN page_id % 5 = 0 AND k > 0 AND k < 3 THEN '1' ELSE '0' END AS version,
    1704067200 + page_id * 60 + CASE WHEN k = 3 THEN -86400 * 900 ELSE k * 86400 END AS ts
  FROM visits WHERE k < 3 OR page_id % 11 = 0),
r AS (SELECT page_id * 4 + k AS record_id, status, ts,
    CASE WHEN k = 1 THEN regexp_replace(url, '^https?://', 'HTTPS://www.') WHEN k = 2 THEN regexp_replace(url, '#.*$', '') || '#seen' ELSE url END AS url,
    CASE WHEN k = 2 AND page_id % 7 = 0 THEN '"other"' WHEN k = 2 AND page_id % 7 < 3 THEN NULL WHEN k = 1 THEN 'W/' ELSE '' END
      || CASE WHEN k = 2 AND page_id % 7 = 0 THEN '' ELSE '"' || substr(digest, 1, 12) || '-' || version || '"' END AS etag,
    CASE WHEN k = 2 AND page_id % 7 = 2 THEN NULL ELSE 'day ' || (page_id % 1000 + version::BIGINT) END AS modified,
    CASE WHEN status = 200 THEN digest || '-' || version END AS payload, k
  FROM v),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS x FROM r),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(x, '^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)'))) AS params FROM u),
keyed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www[0-9]?[.]', '')
    || regexp_replace(regexp_extract(x, '^[^/?]*([^?]*)', 1), '/+$', '')
    || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END AS url_key,
    regexp_replace(etag, '^W/', '') AS tag, ts * 100000000 + record_id AS place FROM c),
met AS (SELECT a.*, f.record_id AS original_id, f.ts AS original_ts, f.tag AS ftag, f.etag AS fetag, f.modified AS fmodified, f.payload AS fpayload, f.k AS fk
  FROM (SELECT * FROM keyed WHERE status = 304) a ASOF LEFT JOIN (SELECT * FROM keyed WHERE status = 200) f ON a.url_key = f.url_key AND a.place > f.place),
done AS (SELECT *, CASE WHEN original_id IS NULL THEN 'no original' WHEN tag IS NOT NULL AND ftag IS NOT NULL THEN CASE WHEN tag = ftag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL AND fmodified IS NOT NULL THEN CASE WHEN modified = fmodified THEN 'resolved' ELSE 'mismatch' END ELSE 'mismatch' END AS outcome FROM met)
SELECT record_id, url_key, ts, original_id, original_ts, outcome,
  CASE WHEN outcome = 'resolved' THEN array_to_string(list_sort(list_filter([
    'content-digest: ' || fpayload, 'date: t' || ts, 'etag: ' || coalesce(etag, fetag), 'expires: later', 'last-modified: ' || coalesce(modified, fmodified)], lambda z: z IS NOT NULL)), '|') END AS headers
FROM done
"""
