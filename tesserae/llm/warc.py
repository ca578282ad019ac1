"""Not-modified revisits of WARC records, resolved to the full response that they stand for.

A server-not-modified revisit has no body. It is joined, as of its date, to the latest earlier full response of the
same canonical URL; the validators of both are compared, and the revisit's headers that a 304 may change replace those
of the response. Only DataFrame functions are used.

The as-of join never brings all records of a hot URL together: the time line of a URL of more than ``HOT_ROWS`` records
is cut at quantiles of its own dates. Inside a slice a window looks back; across slices the last response of each slice
is carried forward, and of those there are at most ``SLICES`` for a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint

#: Records of a URL that are one slice, at most, and slices of a URL that has more.
HOT_ROWS, SLICES = 16384, 1024

# Fields of a 304 that describe a message or a body that the stored response alone has (RFC 9110, 9111).
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
# The record types and the profile that this operator reads (WARC 1.1).
RESPONSE, REVISIT = "response", "revisit"
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"


def canonical_url(url: Column) -> Column:
    """The URL in one spelling: scheme and host in lower case, no user info, default port, fragment or empty query.

    The path has no dot segments and starts with ``/``; percent codes are in upper case. A host in brackets (IPv6) is
    kept with them. What has no scheme and ``//`` is only cut at its fragment; null stays null.
    """
    url = F.trim(url)
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?", n)
    scheme, host, port, path, query = F.lower(part(1)), F.lower(part(2)), part(3), part(4), part(5)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    dotted = path.rlike(r"/\.\.?(/|$)")
    path = F.when(path == "", "/").when(dotted, _without_dots(path)).otherwise(path)
    built = F.concat(
        scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        _upper_codes(path), F.when(query == "?", "").otherwise(_upper_codes(query)),
    )
    return F.when(scheme == "", F.regexp_replace(url, "#.*$", "")).otherwise(built)


def _without_dots(path: Column) -> Column:
    """``.`` leaves out itself, ``..`` also the segment before it; a path that ends in either ends in ``/``."""
    step = lambda done, s: (
        F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    )
    segments = F.split(F.concat(F.regexp_replace(path, "^/", ""), F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")), "/", -1)
    return F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/"))


def _upper_codes(text: Column) -> Column:
    pieces = F.split(text, "%", -1)
    code = lambda s: F.when(s.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(s, 1, 2)), s.substr(F.lit(3), F.length(s)))).otherwise(s)
    coded = F.array_join(F.transform(pieces, lambda s, i: F.when(i == 0, s).otherwise(code(s))), "%")
    return F.when(F.contains(text, F.lit("%")), coded).otherwise(text)


def headers(block: Column) -> Column:
    """An HTTP header block to a map of lower-case names; repeated fields are joined by comma in their order."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))
    names = F.array_distinct(F.transform(lines, name))
    values = F.transform(
        names, lambda n: F.array_join(F.transform(F.filter(lines, lambda x: name(x) == n), value), ", ")
    )
    return F.map_from_arrays(names, values)


def merged(stored: Column, fresh: Column) -> Column:
    """The stored response's headers with those of the 304 that it may change."""
    new = F.map_filter(fresh, lambda k, _: ~k.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k)), new)


def resolve_revisits(records: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """One row for each not-modified revisit in ``records``, resolved or not.

    ``records``: record_id STRING, warc_type, profile, target_uri, warc_date TIMESTAMP, http_status INT,
    http_headers STRING, payload_digest STRING, payload_length BIGINT; other columns are ignored. A full response has
    type response and status 200. Returns record_id, url, warc_date, outcome, match_id, match_date, payload_digest,
    payload_length and merged_headers (MAP).

    outcome is ``resolved``; ``no_earlier`` where no full response is strictly earlier; ``mismatch`` where a validator
    that both sides have differs (ETag by weak comparison, and only where one side lacks it Last-Modified); or
    ``unvalidated`` where they share no validator. The last three leave the payload and headers null. Of responses of
    one URL and date the largest record_id counts. Records without a URL or date resolve to ``no_earlier``; repeated
    revisits give repeated rows. An empty table gives an empty result.
    """
    rows = records.select(
        "record_id", "warc_type", "profile", canonical_url(F.col("target_uri")).alias("url"), "warc_date",
        F.unix_micros("warc_date").alias("at"), "http_status", "http_headers", "payload_digest", "payload_length",
    )
    cuts = _cuts(rows.where(F.col("url").isNotNull() & F.col("at").isNotNull()), hot_rows, slices)
    before_at = F.filter("cuts", lambda cut: cut < F.col("at"))
    rows = rows.join(cuts, "url", "left").withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(before_at))).drop("cuts")
    full = (F.col("warc_type") == RESPONSE) & (F.col("http_status") == 200)
    found = F.struct("record_id", "warc_date", "http_headers", "payload_digest", "payload_length")
    moments = (
        rows.where(F.col("url").isNotNull() & F.col("at").isNotNull())
        .groupBy("url", "slice", "at")
        .agg(F.max(F.when(full, found)).alias("found"))
    )
    ends = moments.where("found is not null").groupBy("url", "slice").agg(F.max_by("found", "at").alias("end"))
    here = Window.partitionBy("url", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = moments.withColumn("inside", F.last("found", ignorenulls=True).over(here))
    every = moments.select("url", "slice").distinct().join(ends, ["url", "slice"], "left")
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("url", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    as_of = inside.join(carried, ["url", "slice"]).select("url", "at", F.coalesce("inside", "carried").alias("match"))
    revisits = rows.where((F.col("warc_type") == REVISIT) & F.col("profile").eqNullSafe(F.lit(NOT_MODIFIED)))
    joined = revisits.join(as_of, ["url", "at"], "left")
    joined = joined.withColumn("old", headers(F.col("match.http_headers"))).withColumn("new", headers(F.coalesce("http_headers", F.lit(""))))
    tag = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    date = lambda m: F.col(m)["last-modified"]
    same = F.coalesce(tag("old") == tag("new"), date("old") == date("new"))
    outcome = (
        F.when(F.col("match").isNull(), "no_earlier").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    )
    good = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "record_id", "url", "warc_date", "outcome", F.col("match.record_id").alias("match_id"), F.col("match.warc_date").alias("match_date"),
        F.when(good, F.col("match.payload_digest")).alias("payload_digest"),
        F.when(good, F.col("match.payload_length")).alias("payload_length"),
        F.when(good, merged(F.col("old"), F.col("new"))).alias("merged_headers"),
    )


def _cuts(timed: DataFrame, hot_rows: int, slices: int) -> DataFrame:
    """``(url, cuts)``: quantiles of the dates of each URL of more than ``hot_rows`` records; settled, as they are approximate."""
    hot = timed.groupBy("url").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("url")
    shares = [k / slices for k in range(1, slices)] or [1.0]
    return checkpoint(timed.join(hot, "url").groupBy("url").agg(F.array_distinct(F.percentile_approx("at", shares)).alias("cuts")))


def captures(pages: DataFrame) -> DataFrame:
    """Every page as two WARC records: a full response, and a later not-modified revisit of its URL.

    ``pages`` has no capture times or headers, so these follow from page_id and the page's own digest: page p is
    answered at minute p from the start of 2024 and revisited 90 minutes and p mod 7 days later. A revisit repeats the
    page's ETag, except that one in five has a changed one and one in seven sends only a date. A page without an id gives
    two records without id and date.
    """
    url, digest = F.col("url"), F.md5(F.coalesce("html", F.lit("")))
    p = F.col("page_id")
    start = F.timestamp_seconds(F.lit(1704067200) + p * 60)
    day = F.date_format(start, "yyyy-MM-dd")
    response = pages.select(
        F.concat(F.lit("r"), p).alias("record_id"), F.lit(RESPONSE).alias("warc_type"), F.lit(None).cast("string").alias("profile"),
        url.alias("target_uri"), start.alias("warc_date"), F.lit(200).alias("http_status"),
        F.concat(F.lit("ETag: "), digest, F.lit("\r\nLast-Modified: "), day, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                 F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\nCache-Control: max-age=60\r\n")).alias("http_headers"),
        digest.alias("payload_digest"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("payload_length"),
    )
    later = F.timestamp_seconds(F.lit(1704067200) + p * 60 + 5400 + (p % 7) * 86400)
    sent = (
        F.when(p % 5 == 0, F.lit("ETag: changed\r\n"))
        .when(p % 7 == 0, F.concat(F.lit("Last-Modified: "), day, F.lit("\r\n")))
        .otherwise(F.concat(F.lit("ETag: W/"), digest, F.lit("\r\n")))
    )
    revisit = pages.select(
        F.concat(F.lit("v"), p).alias("record_id"), F.lit(REVISIT).alias("warc_type"), F.lit(NOT_MODIFIED).alias("profile"),
        url.alias("target_uri"), later.alias("warc_date"), F.lit(304).alias("http_status"),
        F.concat(sent, F.lit("Content-Length: 0\r\nCache-Control: max-age=120\r\n")).alias("http_headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(0).cast("long").alias("payload_length"),
    )
    return response.unionByName(revisit)
