"""WARC: resolution of not-modified revisits.

An as-of join: each revisit record takes the latest earlier full response of the same canonical URL, if the
validators allow it, and the headers that a not-modified response may update are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Header names that a 304 response may update (lower case).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't name a resource.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "sessionid")

HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Host and path that name the resource: without scheme, ``www.``, ``m.``, default port, fragment and
    tracking parameters; host in lower case, the other parameters sorted, an empty path as ``/``.  Null stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(rest, r"\?.*$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*TRACKING)))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, null if absent."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(1))["value"]


def _validator(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, of which the permitted ones in the update are replaced; sorted by lower-case name, then value."""
    allowed = F.filter(F.coalesce(update, F.array().cast(HEADERS)), lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(allowed, lambda h: F.lower(h["name"]))
    kept = F.filter(F.coalesce(stored, F.array().cast(HEADERS)), lambda h: ~F.array_contains(names, F.lower(h["name"])))
    return F.array_sort(F.transform(F.concat(kept, allowed), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))))


def _latest_earlier(records: DataFrame, scratch: Scratch) -> DataFrame:
    """``url_key, us, response``: for each URL and time with records, the latest full response of an earlier time.

    Times are dealt out by ranges of (URL, time), so that a busy URL is spread over as many tasks as it needs;
    within a range a window looks back, and what ranges hand on is the last response of each URL that lies in
    several of them, at most two rows a range.
    """
    times = records.groupBy("url_key", "us").agg(F.max("full").alias("full"))
    times = scratch.write(times.repartitionByRange("url_key", "us").withColumn("part", F.spark_partition_id()), "times")
    spread = times.groupBy("url_key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("url_key")
    lasts = times.join(spread, "url_key").groupBy("url_key", "part").agg(F.max(F.when(F.col("full").isNotNull(), F.struct("us", "full"))).alias("last"))
    by_url = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("url_key", "part", F.last("last.full", ignorenulls=True).over(by_url).alias("carried"))
    earlier = Window.partitionBy("part", "url_key").orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    found = times.withColumn("own", F.last("full", ignorenulls=True).over(earlier)).join(carried, ["url_key", "part"], "left")
    return found.select("url_key", "us", F.coalesce("own", "carried").alias("response")).where("response is not null")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``record_id, url_key, outcome, refers_to, headers`` for each revisit of ``records``.

    Records have ``record_id, url, warc_date (timestamp), warc_type ('response' or 'revisit'), status, headers``
    (an array of name and value).  Full responses are those of status 200.  The latest full response of the
    same canonical URL with an earlier date (ties: the largest record id) is what a revisit refers to, if its
    entity tag (weak comparison) equals the revisit's or, where either has none, its Last-Modified does.  Outcomes:
    ``resolved``; ``unverified`` (no validator on both sides: resolved nonetheless); ``mismatch`` and ``missing``
    (no earlier response), both without a response: ``refers_to`` is null and the headers are the revisit's own.
    Revisits without URL or date are ``missing``; responses without are no one's; repeated rows each get theirs.
    """
    scratch = Scratch(records.sparkSession, "warc")
    us = F.unix_micros(F.col("warc_date"))
    rows = records.select(F.col("record_id"), canonical_url(F.col("url")).alias("url_key"), us.alias("us"), F.col("warc_type").alias("kind"), "status", F.col("headers").cast(HEADERS).alias("headers"))
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("record_id", "headers"))
    rows = scratch.write(rows.withColumn("full", full).where((F.col("kind") == "revisit") | F.col("full").isNotNull()), "records")
    known = F.col("url_key").isNotNull() & F.col("us").isNotNull()
    answers = scratch.write(_latest_earlier(rows.where(known), scratch), "answers")
    scratch.keep(rows, answers)
    asked = rows.where("kind = 'revisit'").select("record_id", "url_key", "us", "headers")
    dated = asked.where(known).join(answers, ["url_key", "us"], "left")
    found = dated.unionByName(asked.where(~known), allowMissingColumns=True)  # rows without a key would all meet in one task of the join
    tags = [_validator(header(h, "etag")) for h in (F.col("headers"), F.col("response.headers"))]
    dates = [header(h, "last-modified") for h in (F.col("headers"), F.col("response.headers"))]
    both = lambda pair: pair[0].isNotNull() & pair[1].isNotNull()
    same = F.when(both(tags), tags[0] == tags[1]).when(both(dates), dates[0] == dates[1])
    outcome = F.when(F.col("response").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    judged = found.withColumn("outcome", outcome)
    ok = F.col("outcome").isin("resolved", "unverified")
    return judged.select("record_id", "url_key", "outcome", F.when(ok, F.col("response.record_id")).alias("refers_to"), merged_headers(F.when(ok, F.col("response.headers")), F.when(ok, F.col("headers"))).alias("merged"), "headers").select("record_id", "url_key", "outcome", "refers_to", F.when(F.col("refers_to").isNotNull(), F.col("merged")).otherwise(F.col("headers")).alias("headers"))
