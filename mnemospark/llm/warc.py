"""WARC: resolution of not-modified revisits by an as-of join.

A server that answers 304 leaves a ``revisit`` record without a body. It
stands for the latest earlier full response of the same canonical URL, if the
validators agree: equal entity tags (weak comparison) where both records have
one, else a Last-Modified that is not later than that of the revisit, else the
response stays unproven and the revisit is left unresolved. A resolved record
carries the response's headers, updated by those that a 304 may change
(RFC 9110 15.4.5: ``UPDATABLE``).

The as-of join is skew-proof: slim records are sorted by (URL, time) over
ranges, so the captures of one URL may span many ranges; each range is filled
by a window over (range, URL), and the last full response before a range is
carried over from one row for each range.

Record columns: record_id, url, ts, kind ('response' or 'revisit'), headers
(map, lower-case names), and any others. Defined cases: a null URL or time is
never resolved; a revisit and a response of one time: the response with the
smaller record_id counts as earlier; no earlier response gives status
'no_response', disagreement 'validator_mismatch'; repeated rows are resolved
each; bodies are not touched; a date that is none of the three HTTP forms nor
``yyyy-MM-dd HH:mm:ss`` counts as absent; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.scratch import materialize

#: Header names that a 304 response may update.
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
#: Query parameters that do not select content.
TRACKING = ("utm_[^=]*", "ref", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host in lower case without ``www.`` and default port, no
    fragment, query sorted and without tracking parameters, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(" + "|".join(TRACKING) + ")(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def http_time(header: Column, seen: Column) -> Column:
    """The time of an HTTP date: IMF-fixdate, RFC 850 or asctime form (RFC 9110 5.6.7).

    A two-digit year is the latest one that is at most 50 years after ``seen``.
    """
    h = F.btrim(header)
    clock = "([0-9]{2}:[0-9]{2}:[0-9]{2})"
    imf = F.regexp_replace(h, f"^[A-Za-z]+, ([0-9]{{2}}) ([A-Za-z]{{3}}) ([0-9]{{4}}) {clock} GMT$", "$3-$2-$1 $4")
    asc = F.regexp_replace(imf, f"^[A-Za-z]{{3}} ([A-Za-z]{{3}}) +([0-9]{{1,2}}) {clock} ([0-9]{{4}})$", "$4-$1-$2 $3")
    old = f"^[A-Za-z]+, ([0-9]{{2}})-([A-Za-z]{{3}})-([0-9]{{2}}) {clock} GMT$"
    latest = F.year(seen) + 50
    year = latest - F.pmod(latest - F.regexp_extract(h, old, 3).try_cast("int"), F.lit(100))
    short = F.concat(year.cast("string"), F.regexp_replace(h, old, "-$2-$1 $4"))
    named = F.try_to_timestamp(F.concat(F.when(h.rlike(old), short).otherwise(asc), F.lit(" +00:00")), F.lit("yyyy-MMM-d HH:mm:ss XXX"))
    return F.coalesce(named, F.try_to_timestamp(F.concat(h, F.lit(" +00:00")), F.lit("yyyy-MM-dd HH:mm:ss XXX")))


def _plain(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each revisit: record_id, canonical_url, response_id, status, headers (merged)."""
    spark = records.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "headers")
    sorted_ = slim.repartitionByRange(ranges, "canonical_url", "ts", "record_id").sortWithinPartitions("canonical_url", "ts", "record_id").withColumn("part", F.spark_partition_id())
    sorted_ = materialize(sorted_, "captures")
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    full = F.when((F.col("kind") == "response") & usable, F.struct("ts", "record_id", "headers"))
    # of each range: the last URL and its last full response there
    brief = F.when((F.col("kind") == "response") & usable, F.struct("ts", "record_id"))
    ends = sorted_.groupBy("part").agg(F.min("canonical_url").alias("first_url"), F.max("canonical_url").alias("last_url"))
    tails = sorted_.join(ends.select("part", "last_url"), "part").where(F.col("canonical_url") == F.col("last_url")).groupBy("part", "last_url").agg(F.max(brief).alias("tail"))
    # ranges ascend by URL: what reaches a range is the latest tail before it of its first URL
    ranges_ = ends.select("part", "first_url").join(tails, "part", "left").withColumn("tail_of", F.when(F.col("tail").isNotNull(), F.struct("last_url", "tail")))
    reach = F.last("tail_of", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ranges_.select("part", "first_url", reach.alias("reach")).where(F.col("reach.last_url") == F.col("first_url")).select("part", F.col("first_url").alias("canonical_url"), F.col("reach.tail.record_id").alias("carry_id"), F.col("reach.tail.ts").alias("carry_ts"))
    carried = carried.join(sorted_.where("kind = 'response'").select(F.col("canonical_url"), F.col("record_id").alias("carry_id"), F.col("ts").alias("carry_ts"), F.col("headers").alias("carry_headers")), ["canonical_url", "carry_id", "carry_ts"]).dropDuplicates(["part"])
    carried = carried.select("part", "canonical_url", F.struct(F.col("carry_ts").alias("ts"), F.col("carry_id").alias("record_id"), F.col("carry_headers").alias("headers")).alias("carry"))
    inside = Window.partitionBy("part", "canonical_url").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = sorted_.withColumn("near", F.last(full, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    filled = filled.join(carried, ["part", "canonical_url"], "left").withColumn("found", F.when(usable, F.coalesce("near", "carry")))
    ours, theirs = F.col("headers"), F.col("found.headers")
    tag, old_tag = F.get(F.array(ours["etag"]), F.lit(0)), theirs["etag"]
    by_time = http_time(theirs["last-modified"], F.col("found.ts")) <= http_time(ours["last-modified"], F.col("ts"))
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), _plain(tag) == _plain(old_tag)).otherwise(F.coalesce(by_time, F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    permitted = F.map_filter(F.coalesce(ours, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*UPDATABLE) & v.isNotNull())
    kept = F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    done = filled.withColumn("status", status)
    return done.select("record_id", "canonical_url", F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("response_id"), "status", F.when(F.col("status") == "resolved", F.map_concat(kept, permitted)).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str) -> DataFrame:
    """The resolved revisits with the body of the response each stands for."""
    bodies = records.select(F.col("record_id").alias("response_id"), F.col(body).alias("body"))
    return resolved.where("status = 'resolved'").join(bodies, "response_id")


def page_records(pages: DataFrame) -> DataFrame:
    """The crawl that a table of pages (page_id, url, html) stands for: each page
    was fetched in full at its turn, and the URL asked for again, with the
    validators of this body, half a turn after the next page of its host path.

    Response: record_id = 2 * page_id. Revisit: record_id = 2 * page_id + 1; the
    server's entity tag is that of the body, or - where the page's MD5 starts
    with 0 or 1 - of a body that has changed since. Where it starts with 2, the
    revisit comes before the page, so it has no response unless another page
    with this URL gave one. Where it starts with 3 to 6 the server sends no tag
    but a Last-Modified: the page's time in one of the three HTTP forms (3, 4,
    5), or a day before it (6).
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    lead = F.substring(digest, 1, 1)
    turn = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    base = pages.select("page_id", "url", digest.alias("d"), lead.alias("lead"), turn.alias("t"))
    quoted = F.concat(F.lit('"'), F.col("d"), F.lit('"'))
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("t").alias("ts"), F.lit("response").alias("kind"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), quoted, F.lit("last-modified"), _imf(F.col("t")), F.lit("date"), _imf(F.col("t"))).alias("headers"),
    )
    again = F.when(F.col("lead") == "2", F.col("t") - F.expr("INTERVAL 30 SECONDS")).otherwise(F.col("t") + F.expr("INTERVAL 90 SECONDS"))
    tag = F.when(F.col("lead").isin("0", "1"), F.lit('"changed"')).when(~F.col("lead").between("3", "6"), F.concat(F.lit("W/"), quoted))
    asctime = F.concat(F.date_format("t", "EEE MMM "), F.lpad(F.dayofmonth("t").cast("string"), 2, " "), F.date_format("t", " HH:mm:ss yyyy"))
    since = F.when(F.col("lead") == "3", _imf(F.col("t"))).when(F.col("lead") == "4", F.date_format("t", "EEEE, dd-MMM-yy HH:mm:ss 'GMT'")).when(F.col("lead") == "5", asctime).when(F.col("lead") == "6", _imf(F.col("t") - F.expr("INTERVAL 1 DAY")))
    given = F.create_map(F.lit("etag"), tag, F.lit("date"), _imf(again), F.lit("server"), F.lit("edge"), F.lit("last-modified"), since)
    revisit = base.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit("revisit").alias("kind"), F.map_filter(given, lambda k, v: v.isNotNull()).alias("headers"))
    return response.unionByName(revisit)


def _imf(t: Column) -> Column:
    return F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
