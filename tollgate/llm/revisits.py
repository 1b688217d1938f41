"""Resolution of not-modified revisits in web archives, in DataFrame expressions only.

A revisit record says that a page had not changed; its body is that of the latest full response of the same canonical url that
is strictly earlier. Records are sorted by range over (url, time), so a url that holds a third of all records is split over many
tasks. Inside a range the base is a running last value; a url that crosses ranges takes it from the ranges before, by a table of
at most two rows for each range.

The base counts only if the validators agree: entity tags by weak comparison if both have one, else the modification dates.
Status is `resolved`, `mismatch`, `unverified` (no validator in common) or `missing` (no earlier full response). A resolved
record has the base's headers, updated by the permitted ones of the revisit.

Null urls are canonically empty and never match. Null times are earlier than nothing and later than nothing. Null headers are
none; header names are compared in lower case, the last of repeated ones wins. Among responses of one time the one with the
largest record_id counts. Repeated records each keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import parts, pinned

# Headers that a not-modified answer may update, and query parameters that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"


def canonical(url: Column) -> Column:
    """Host in lower case without `www.` and port 80 or 443, path without closing slash, sorted parameters that do not track."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"#[\s\S]*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"^[^?]*\?([\s\S]*)$", 1), "&"),
                                  lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(""))


def entries(headers: Column) -> Column:
    """(key, value) pairs with lower-case keys, the last of each key."""
    low = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
                      lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.filter(low, lambda e, i: e["value"].isNotNull() & ~F.exists(
        F.slice(low, i + 2, F.greatest(F.size(low), F.lit(1))), lambda later: later["key"] == e["key"]))


def header(pairs: Column, name: str) -> Column:
    return F.element_at(F.map_from_entries(pairs), name)


def merged(base: Column, update: Column) -> Column:
    allowed = F.filter(update, lambda e: e["key"].isin(*PERMITTED))
    kept = F.filter(base, lambda e: ~F.exists(allowed, lambda u: u["key"] == e["key"]))
    return F.array_sort(F.concat(kept, allowed))


def latest_full(records: DataFrame) -> DataFrame:
    """`records(record_id, key, ts, full, pairs)` with `base`, the latest strictly earlier full record of the key, or null."""
    order = ["ts", "full", "record_id"]  # at one time revisits stand before responses
    ranged = pinned(records.repartitionByRange(parts(records), "key", *order).withColumn("range", F.spark_partition_id()))
    value = F.when(F.col("full") & F.col("ts").isNotNull(), F.struct("ts", "record_id", "pairs"))
    inside = ranged.withColumn("near", F.last(value, ignorenulls=True).over(Window.partitionBy("range", "key").orderBy(*order)))
    ends = ranged.groupBy("key", "range").agg(F.max_by(value, F.when(value.isNotNull(), F.struct("ts", "record_id"))).alias("end"))
    crossing = ends.groupBy("key").count().where("count > 1").drop("count")  # at most one for each border of two ranges
    carried = (ends.join(F.broadcast(crossing), "key", "left_semi")
               .withColumn("far", F.last("end", ignorenulls=True).over(
                   Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
               .where("far is not null").select("key", "range", "far"))
    return (inside.join(F.broadcast(carried), ["key", "range"], "left")
            .withColumn("base", F.when(F.col("ts").isNotNull() & (F.col("key") != ""), F.coalesce("near", "far")))
            .drop("near", "far", "range"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of `records(record_id, kind, url, ts, status, headers)`: base_id, status and merged headers.

    A full response is a record of kind `response` with status 200; a revisit has kind `revisit` and status 304.
    """
    rows = (records.where("kind = 'response' and status = 200 or kind = 'revisit' and status = 304")
            .select("record_id", canonical(F.col("url")).alias("key"), "ts", (F.col("kind") == "response").alias("full"),
                    entries(F.col("headers")).alias("pairs")))
    found = latest_full(rows).where("not full")
    tag, base_tag = (F.regexp_replace(header(F.col(x), "etag"), "^W/", "") for x in ("pairs", "base.pairs"))
    date, base_date = (header(F.col(x), "last-modified") for x in ("pairs", "base.pairs"))
    agree = F.when(tag.isNotNull() & base_tag.isNotNull(), tag == base_tag).otherwise(date == base_date)
    result = (F.when(F.col("base").isNull(), "missing").when(agree.isNull(), "unverified")
              .when(agree, "resolved").otherwise("mismatch"))
    return (found.withColumn("result", result)
            .select("record_id", F.col("key").alias("canonical_url"), F.col("base.record_id").alias("base_id"),
                    F.col("result").alias("status"),
                    F.when(F.col("result") == "resolved", F.map_from_entries(merged(F.col("base.pairs"), F.col("pairs")))).alias("headers")))


def captures(pages: DataFrame) -> DataFrame:
    """Two archive records of every page: its response, and a later revisit of a variant of its url.

    One revisit in four has another entity tag, one in seven none but the date of the response, one in eleven no validator.
    """
    page, pick = F.col("page_id").cast("long"), F.crc32(F.col("page_id").cast("string"))
    at = page * 10
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit(""))), 1, 16), F.lit('"'))

    def mapped(**named: Column) -> Column:
        return F.create_map(*[x for k, v in named.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])

    response = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", at.alias("ts"), F.lit(200).alias("status"),
        mapped(Content_Type=F.lit("text/html"), Content_Length=F.octet_length(F.coalesce(F.col("html"), F.lit(""))), ETag=tag,
               Last_Modified=at, Date=at).alias("headers"))
    own = F.when(pick % 4 == 0, F.lit('"changed"')).when(pick % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    silent = pick % 11 == 0
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.col("url"), F.when(F.col("url").contains("#"), "x").otherwise("#again")).alias("url"),
        (at + pick % 5000 + 1).alias("ts"), F.lit(304).alias("status"),
        mapped(ETag=F.when(~silent & (pick % 7 != 0), own), Last_Modified=F.when(~silent, at), Date=at + pick % 5000 + 1,
               Cache_Control=F.lit("max-age=60"), Content_Length=F.lit(0)).alias("headers"))
    return response.unionByName(revisit)
