"""Resolving not-modified revisits of a web archive.

A revisit record (status 304) has headers but no body.  It stands for the latest
earlier full response of the same canonical URL, if a validator that both carry
(ETag, else Last-Modified) agrees; the headers of that response are then updated by
those of the revisit, but for the ones that a 304 may not change.

The as-of join is two-level: the last full response of each URL and stretch of
time is taken first, so a URL with very many captures is spread over its stretches
and only one row for each stretch is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm.store import unused

#: Seconds of a stretch.
STRETCH = 86_400
# Headers that a not-modified answer doesn't update.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that only track.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical_url(url: Column | str) -> Column:
    """Scheme, ``www.``/``m.``, default port, fragment, tracking parameters, index page and last slash removed; host in lower case. Null stays null."""
    u = F.regexp_replace(F.trim(url), r"^(?i:https?)://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    rest = F.regexp_extract(u, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, rf"([?&]){TRACKING}=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"([?&])&+", "$1"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/(index\.html?)?$", ""))


def _header(name: str) -> Column:
    return F.element_at("headers", name)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (record_id, url, ts seconds, status, headers map) with refers_to, outcome and merged_headers.

    outcome: ``full`` for other than 304 (refers_to is the record itself), ``resolved``,
    ``no_earlier`` if there is no full response before it, ``mismatch`` if no validator
    agrees.  Only status 200 counts as a full response.  Of captures in one second the
    full ones come first, then the lesser record_id.  Null urls and times never
    resolve; null headers count as none; header names are compared in lower case, and of
    two that then agree the later counts.  Own columns named canonical_url, refers_to,
    outcome or merged_headers are replaced, others kept.
    """
    none = F.create_map().cast("map<string,string>")
    given = F.transform(F.map_entries(F.coalesce("headers", none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(given, lambda e: e["key"])
    lower = F.map_from_entries(F.filter(given, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))
    own = [f"`{c}`" for c in records.columns if c not in ("refers_to", "outcome", "merged_headers", "canonical_url")]
    url, stretch, tie, last_, carried_, near, source_ = unused(records, "url_key", "stretch", "tie", "last_full", "carried", "near", "source")
    rows = records.select(*own).withColumn("headers", lower).withColumn(url, canonical_url("url")).withColumn(stretch, F.floor(F.col("ts") / STRETCH))
    rows = rows.withColumn(tie, F.xxhash64(F.array_sort(F.map_entries("headers"))))
    full = (F.col("status") == 200) & F.col(url).isNotNull() & F.col("ts").isNotNull()
    state = F.struct("ts", F.col("record_id").alias("id"), "headers")
    key = [url, stretch]
    last = rows.where(full).groupBy(*key).agg(F.max_by(state, F.struct("ts", "record_id", tie)).alias(last_))
    # records without a url never resolve: they stay out of the windows, so that they don't meet in one task
    alone, rows = rows.where(F.col(url).isNull()), rows.where(F.col(url).isNotNull())
    stretches = rows.select(*key).distinct().join(last, key, "left")
    before = Window.partitionBy(url).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*key, F.last(last_, ignorenulls=True).over(before).alias(carried_))
    order = Window.partitionBy(*key).orderBy("ts", F.when(full, 0).otherwise(1), "record_id", tie).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn(near, F.last(F.when(full, state), ignorenulls=True).over(order)).join(carried, key, "left")
    seen = seen.withColumn(source_, F.when(F.col("ts").isNotNull(), F.coalesce(near, carried_))).drop(near, carried_)
    seen = seen.unionByName(alone.withColumn(source_, F.lit(None).cast(seen.schema[source_].dataType)))
    told = lambda name: _header(name).isNotNull() & F.element_at(F.col(source_)["headers"], name).isNotNull()
    same = lambda name: F.regexp_replace(_header(name), r"^W/", "") == F.regexp_replace(F.element_at(F.col(source_)["headers"], name), r"^W/", "")
    agrees = F.when(told("etag"), same("etag")).when(told("last-modified"), same("last-modified")).otherwise(F.lit(False))
    outcome = F.when(~F.col("status").eqNullSafe(304), "full").when(F.col(source_).isNull(), "no_earlier").when(agrees, "resolved").otherwise("mismatch")
    seen = seen.withColumn("outcome", outcome)
    allowed = F.map_filter("headers", lambda k, _: ~k.isin(*KEPT_HEADERS))
    stored = F.map_filter(F.col(source_)["headers"], lambda k, _: ~F.map_contains_key(allowed, k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(stored, allowed)).when(F.col("outcome") == "full", F.col("headers"))
    refers = F.when(F.col("outcome") == "full", F.col("record_id")).when(F.col("outcome") == "resolved", F.col(source_)["id"])
    return seen.withColumn("refers_to", refers).withColumn("merged_headers", merged).select(*own, F.col(url).alias("canonical_url"), "refers_to", "outcome", "merged_headers")


def capture_log(pages: DataFrame) -> DataFrame:
    """Captures of ``pages`` over time, by rule: every page once in full, all again later as revisits.

    The revisit of every fifth page carries another ETag; that of every third is made
    under another form of the URL.  Revisits of every seventh page come before it.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    p = F.col("page_id")
    full = pages.select(
        (p * 2).alias("record_id"), "url", (p * 60).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Date"), (p * 60).cast("string"), F.lit("Server"), F.lit("a")).alias("headers"),
    )
    later = F.when(p % 7 == 0, p * 60 - 30).otherwise(p * 60 + 86_400 * (1 + p % 3))
    again = pages.select(
        (p * 2 + 1).alias("record_id"), F.when(p % 3 == 0, F.concat(F.regexp_replace("url", r"#.*$", ""), F.lit("#again"))).otherwise(F.col("url")).alias("url"), later.alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.when(p % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("Date"), later.cast("string"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    return full.unionByName(again)


def resolved_pages(pages: DataFrame) -> DataFrame:
    """Every capture of the log with its outcome and, where there is one, the body it stands for."""
    found = resolve(capture_log(pages))
    bodies = pages.select((F.col("page_id") * 2).alias("refers_to"), F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("body_md5"))
    out = found.join(bodies, "refers_to", "left")
    header = lambda n: F.element_at("merged_headers", n)
    return out.select(F.expr("record_id div 2").alias("page_id"), "record_id", "status", "canonical_url", "refers_to", "outcome", "body_md5", header("date").alias("date"), header("content-length").alias("content_length"), header("etag").alias("etag"), F.size(F.coalesce("merged_headers", F.create_map().cast("map<string,string>"))).alias("n_headers"))
