"""Resolution of not-modified revisits in web archive records.

A revisit (a 304 answer) has no body.  It stands for the latest earlier full response of the same
canonical URL, if the validators it carries (ETag, compared weakly; Last-Modified) are those of that
response.  It then gets that response's status and body, and its
headers: the stored ones, replaced by those of the revisit except the ones that
describe the stored body or one connection.

The as-of join works on slim rows without bodies.  They are dealt out by ranges of (URL, time, row), so
a URL that holds a third of all rows is spread over many tasks.  Each task finds the last
full response within its range; the last one of the earlier ranges of a URL is carried over through
a table of one row for each URL and range.  Bodies are then joined by row hash, once.

Defined results: equal times: a revisit does not see a response of its own second, and of several
responses the one with the larger row hash is the latest; a null url matches nothing; a null time
counts as before all others; a null array of headers is empty, and a header without a name is left out; equal rows are each
resolved; empty tables give no rows; extra columns are kept, and give way to result columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import add, any_names, row_hash, saved, unused

HEADERS = "array<struct<name:string,value:string>>"
#: fixed values of the HTTP caching rules: fields of a 304 that don't replace stored ones
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
               "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
               "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(?:utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid|sid)(?:=|$)"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www`` and default port, path without end slash, sorted query without
    tracking fields; no scheme and no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^(?:[^@]*@)?(?:www[0-9]*\.)?([^:]*?)(?::(?:80|443))?$", "$1")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    fields = F.array_sort(F.filter(fields, lambda f: (f != "") & ~F.lower(f).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), 0)["value"]


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, updated by those of a 304 that may replace them."""
    none = F.array().cast(HEADERS)
    named = lambda a: F.filter(F.coalesce(a, none), lambda h: h["name"].isNotNull())
    new = F.filter(named(fresh), lambda h: ~F.lower(h["name"]).isin(*KEPT_FIELDS))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(named(stored), lambda h: ~F.array_contains(names, F.lower(h["name"]))), new)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


@any_names
def resolve(records: DataFrame, url: str = "url", time: str = "ts", status: str = "status", headers: str = "headers",
            body: str = "body", key: str = "record_id", partitions: int | None = None) -> DataFrame:
    """The revisits (status 304) of ``records``, with ``status``, ``headers`` and ``body`` of the merged answer,
    ``refers_to`` (``key`` of the response) and ``outcome``: resolved, no_earlier or mismatch.

    Full responses are those of status 200.  An unresolved revisit keeps its own status, headers and null body.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x, y, xs, xb, xh = unused(records, "x", "y", "xstatus", "xbody", "xheaders")
    marked = records.withColumns(dict(zip((x, y), row_hash(records)))).where(F.col(status).isin(200, 304))
    others = [c for c in records.columns if c != body]
    full = F.col(status) == 200
    validators = F.struct(_strong(header(F.col(headers), "etag")).alias("etag"), header(F.col(headers), "last-modified").alias("modified"))
    slim = marked.select(
        F.coalesce(canonical(F.col(url)), F.concat(F.lit("?"), F.hex(x), F.hex(y))).alias("page"),
        F.col(time).alias("at"), full.alias("full"), F.col(x).alias("x"), F.col(y).alias("y"), validators.alias("validators"),
        F.when(~full, F.struct(*others)).alias("own"))
    slim = slim.repartitionByRange(n, "page", "at", "full", "x", "y")
    slim = saved(slim.withColumn("range", F.spark_partition_id()))
    order = [F.col(c) for c in ("at", "full", "x", "y")]  # a revisit comes before the responses of its time
    seen = F.when(F.col("full"), F.struct("at", "x", "y", "validators"))
    last = slim.where("full").groupBy("page", "range").agg(F.max(F.struct("at", "x", "y", "validators")).alias("last"))
    ranges = slim.groupBy("page", "range").agg(F.count(F.lit(1)).alias("n")).join(last, ["page", "range"], "left")
    before = Window.partitionBy("page").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.withColumn("carried", F.last("last", ignorenulls=True).over(before)) \
        .where("carried is not null").select("page", "range", "carried")
    within = Window.partitionBy("page", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    asof = slim.withColumn("local", F.last(seen, ignorenulls=True).over(within)).where(~F.col("full")) \
        .join(carried, ["page", "range"], "left") \
        .select("own", "x", "y", F.col("validators").alias("mine"), F.coalesce("local", "carried").alias("old"))
    mine, old = F.col("mine"), F.col("old")
    same = (mine["etag"].isNull() | mine["etag"].eqNullSafe(old["validators"]["etag"])) & \
           (mine["modified"].isNull() | mine["modified"].eqNullSafe(old["validators"]["modified"]))
    outcome = F.when(old.isNull(), "no_earlier").when(same, "resolved").otherwise("mismatch")
    asof = asof.withColumn("outcome", outcome)
    hit = F.col("outcome") == "resolved"
    # one that is not resolved asks for its own row hash, which no response has: nulls would all go to one task
    asof = asof.select("own", "outcome", F.when(hit, old["x"]).otherwise(F.col("x")).alias("rx"), F.when(hit, old["y"]).otherwise(F.col("y")).alias("ry"))
    stored = marked.where(full).select(F.col(x).alias("x"), F.col(y).alias("y"), F.struct(key, status, headers, body).alias("stored")) \
        .dropDuplicates(["x", "y"])
    out = asof.join(stored, (asof["rx"] == stored["x"]) & (asof["ry"] == stored["y"]), "left")
    s, o, hit = F.col("stored"), F.col("own"), F.col("stored").isNotNull()
    out = out.select(*[o[c].alias(c) for c in others], F.col("outcome").alias(x), s[key].alias(y),
                     F.coalesce(s[status], o[status]).alias(xs), s[body].alias(xb),
                     F.when(hit, merged(s[headers], o[headers])).otherwise(o[headers]).alias(xh))
    out = add(out, **{status: out[xs], headers: out[xh], body: out[xb],
                      "refers_to": out[y], "outcome": out[x]})
    return out.drop(x, y, xs, xb, xh)
