"""Web archive records: resolving not-modified revisits.

A revisit record that a server answered with 304 holds headers only. It is resolved by an as-of join on the canonical
URL to the latest full response that is strictly earlier; its validators are checked against that response's (ETag by
weak comparison, else Last-Modified), and the headers a 304 may update are merged over the stored ones.

Records are dealt by ranges of (URL, time), so that one URL with a third of all rows fills many ranges, whatever its
times. The last response of each (URL, range) is a grouped maximum, which a window over ranges carries forward, and inside
a range another window looks back: no task holds more of a URL than a range. Header lines without a name are left out. Null URLs are canonical nulls and resolve to nothing; null times are neither matched nor resolved. Of responses
at one time the largest record_id counts. Repeated revisits each keep a row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatium.llm.common import cut

#: Fields that describe the stored body or the connection: a 304 does not change them.
FIXED = ("content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization")
URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"


def canonical(url: Column) -> Column:
    """Scheme-less key: lower-case host without www., port unless a default one, path without a trailing slash, sorted query without utm_ keys."""
    part = [F.regexp_extract(url, URL, i) for i in range(6)]
    port = F.when((part[3] == "") | (part[3] == "80") | (part[3] == "443"), "").otherwise(F.concat(F.lit(":"), part[3]))
    query = F.array_join(F.array_sort(F.filter(F.split(part[5], "&"), lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    key = F.concat(F.regexp_replace(F.lower(part[2]), "^www\\.", ""), port, F.regexp_replace(part[4], "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull(), None).when(part[1] == "", url).otherwise(key)


def headers(block: Column) -> Column:
    """map<string,string> of a block of header lines: names in lower case, the last of repeated names counts."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    parts = F.transform(lines, lambda x, i: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), i.alias("i"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    sorted_ = F.array_sort(parts)  # the last of a name stands before the next name
    named = F.zip_with(sorted_, F.slice(sorted_, 2, F.greatest(F.size(sorted_), F.lit(1))), lambda e, after: F.struct(e["k"].alias("k"), e["v"].alias("v"), (after["k"].isNull() | (after["k"] != e["k"])).alias("last")))
    return F.map_from_entries(F.transform(F.filter(named, lambda e: e["last"] & (e["k"] != "")), lambda e: F.struct(e["k"], e["v"])))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, canonical, ts, original_id, status, headers) for each revisit of ``records``.

    records: record_id long, url string, ts timestamp, type ('response' or 'revisit'; others are left out), block
    string of header lines. status: resolved, unvalidated (no common validator), mismatch, or no-original; headers are
    merged where resolved or unvalidated, else the revisit's own.
    """
    base = records.filter(F.col("type").isin("response", "revisit")).select("record_id", canonical(F.col("url")).alias("canonical"), "ts", "type", "block")
    seen = F.when(F.col("type") == "response", F.struct(F.col("record_id").alias("id"), F.col("block").alias("block")))
    ranged = base.filter("ts is not null and canonical is not null").repartitionByRange("canonical", "ts", "type", "record_id")
    timed = cut(ranged.withColumn("slice", F.spark_partition_id())).withColumn("full", seen)
    ends = timed.filter("full is not null").groupBy("canonical", "slice").agg(F.max_by("full", F.struct("ts", "record_id")).alias("end"))
    # every slice that has a revisit needs what earlier slices carry into it
    asked = timed.filter("type = 'revisit'").select("canonical", "slice").distinct()
    over = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.join(ends, ["canonical", "slice"], "full").withColumn("carry", F.last("end", ignorenulls=True).over(over)).select("canonical", "slice", "carry")
    # at one time a revisit comes first, so it sees strictly earlier responses only
    inside = Window.partitionBy("canonical", "slice").orderBy("ts", (F.col("type") == "response"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).filter("type = 'revisit'")
    found = near.join(carried, ["canonical", "slice"]).select("record_id", "canonical", "ts", "block", F.coalesce("near", "carry").alias("original"))
    rest = base.filter("type = 'revisit' and (ts is null or canonical is null)").select("record_id", "canonical", "ts", "block", F.lit(None).cast(found.schema["original"].dataType).alias("original"))
    rows = found.unionByName(rest).withColumns({"own": headers(F.col("block")), "stored": headers(F.col("original.block"))})
    tag, old_tag, date, old_date = F.col("own")["etag"], F.col("stored")["etag"], F.col("own")["last-modified"], F.col("stored")["last-modified"]
    status = (
        F.when(F.col("original").isNull(), "no-original")
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(_weak(tag) == _weak(old_tag), "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    newer = F.map_filter("own", lambda k, _: ~k.isin(*FIXED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(newer, k)), newer)
    rows = rows.withColumn("status", status)
    return rows.select("record_id", "canonical", "ts", F.col("original.id").alias("original_id"), "status", F.when(F.col("status").isin("resolved", "unvalidated"), merged).otherwise(F.col("own")).alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Every page as a full response, and a 304 revisit of it, as archive records.

    Most revisits are later and bear the response's validators; one in seven has an ETag of another version, and one in
    eleven comes before the response.
    """
    n = F.col("page_id")
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    said = F.when(n % 7 == 3, F.reverse(tag)).otherwise(tag)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    hour = n * 3600
    full = F.concat_ws("\r\n", line("Content-Type", F.lit("text/html")), line("Content-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")), line("ETag", F.concat(F.lit('"'), tag, F.lit('"'))), line("Last-Modified", (hour % 86400).cast("string")), line("Cache-Control", F.lit("max-age=60")))
    again = F.concat_ws(
        "\r\n", line("Content-Length", F.lit("0")), line("Cache-Control", F.concat(F.lit("max-age="), (n % 600).cast("string"))), F.when(n % 3 > 0, line("ETag", F.concat(F.lit('W/"'), said, F.lit('"')))), F.when(n % 5 > 0, line("Last-Modified", (hour % 86400).cast("string")))
    )
    at = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    later = F.when(n % 11 == 5, hour - 1).otherwise(hour + 1 + (n % 97) * 7200)
    return pages.select((n * 2).alias("record_id"), "url", at(hour).alias("ts"), F.lit("response").alias("type"), full.alias("block")).unionByName(
        pages.select((n * 2 + 1).alias("record_id"), "url", at(later).alias("ts"), F.lit("revisit").alias("type"), again.alias("block"))
    )


ORACLE = r"""
WITH u AS (
  SELECT page_id, html, url, regexp_extract(url, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'o', 'p', 'q']) AS x FROM pages
), c AS (
  SELECT page_id, '"' || substr(md5(html), 1, 16) || '"' AS tag, strlen(html) AS n, (page_id * 3600) % 86400 AS lm,
    regexp_replace(lower(x.h), '^www\.', '') || CASE WHEN x.o IN ('', '80', '443') THEN '' ELSE ':' || x.o END || regexp_replace(x.p, '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(x.q, '&'), lambda y: y <> '' AND NOT starts_with(y, 'utm_'))), '&'), ''), '') AS canonical
  FROM u
), f AS (SELECT *, page_id * 3600 AS t FROM c),
r AS (SELECT * REPLACE (CASE WHEN page_id % 7 = 3 THEN '"' || reverse(replace(tag, '"', '')) || '"' ELSE tag END AS tag), page_id * 3600 + CASE WHEN page_id % 11 = 5 THEN -1 ELSE 1 + (page_id % 97) * 7200 END AS t FROM c),
j AS (SELECT r.page_id, r.canonical, r.t, r.tag, r.lm, f.page_id AS o, f.tag AS otag, f.lm AS olm, f.n AS n FROM r ASOF LEFT JOIN f ON r.canonical = f.canonical AND r.t > f.t),
s AS (SELECT *, CASE WHEN o IS NULL THEN 'no-original' WHEN page_id % 3 > 0 THEN CASE WHEN tag = otag THEN 'resolved' ELSE 'mismatch' END
  WHEN page_id % 5 > 0 THEN CASE WHEN lm = olm THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS status FROM j)
SELECT page_id * 2 + 1 AS record_id, canonical, 1700000000 + t AS seconds, o * 2 AS original_id, status,
  CASE WHEN status IN ('resolved', 'unvalidated') THEN CAST(n AS VARCHAR) ELSE '0' END AS content_length,
  'max-age=' || page_id % 600 AS cache_control,
  CASE WHEN page_id % 3 > 0 THEN 'W/' || tag WHEN status IN ('resolved', 'unvalidated') THEN otag END AS etag
FROM s
"""
