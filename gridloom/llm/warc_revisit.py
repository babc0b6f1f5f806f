"""WARC not-modified revisits: an as-of join to the latest earlier full response.

The join is two windows over narrow rows: within (url, time chunk), and over the
chunks of a url, of which each has one row. A url with a third of all records is thus
split by time. Bodies never move: the result names the record that holds the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a revisit may replace (RFC 9111: a 304 updates these; never the body's own).
PERMITTED = ("date", "expires", "cache-control", "etag", "last-modified", "vary")
CHUNK_SECONDS = 900


def canonical_url(url: str) -> Column:
    """Scheme and host lower-cased (A-Z); default port, fragment and one slash at the end
    of the path dropped. A query string stays as it is."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.regexp_replace(F.col(url), r"#.*\z", "")
    head = F.regexp_extract(plain, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    tail = F.substr(plain, F.length(head) + 1)
    head = F.regexp_replace(F.translate(head, upper, lower), r"\A(http://.*):80\z|\A(https://.*):443\z", "$1$2")
    return F.concat(head, F.regexp_replace(tail, r"\A([^?]*)/(\?[\s\S]*)?\z", "$1$2"))


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Resolve every ``revisit`` record.

    records: ``record_id long, url string, ts long`` (seconds), ``kind string``
    (``response`` or ``revisit``), ``etag, last_modified string`` (validators),
    ``headers map<string,string>``; further columns are ignored. Returns for each
    revisit ``record_id, canonical_url, ts, source_id, source_ts, validator, status,
    headers``:

    - source: the latest full response of the canonical url with an earlier ts; of
      several at that time the one with the largest record_id.
    - status: ``resolved`` if the revisit's etag equals the source's (weak prefix ``W/``
      ignored), or, where either lacks an etag, the last_modified values are equal;
      ``mismatch`` if the compared validators differ; ``unvalidated`` if there is
      nothing to compare; ``orphan`` without an earlier response.
    - headers: if resolved the source's, replaced by the revisit's for the permitted
      names only, whatever the letters' case; else null. Null header maps are empty ones.

    A null url or ts has no source (orphan). Urls and headers may be of any length. Rows
    that repeat are each resolved; a record_id that several urls share is taken by url; an
    empty table gives no rows.
    """
    base = records.select("record_id", canonical_url("url").alias("canonical_url"), "ts", "kind", "etag", "last_modified", "headers")
    base = base.withColumn("chunk", F.floor(F.col("ts") / chunk_seconds))
    is_response = (F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    full = F.when(is_response, F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    slim = base.withColumn("key", F.when(is_response, F.struct("ts", "record_id")))
    keyed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()

    ends = slim.filter(keyed).groupBy("canonical_url", "chunk").agg(F.max("key").alias("end"))
    before = Window.partitionBy("canonical_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("canonical_url", "chunk", F.max("end").over(before).alias("carried"))

    inside = Window.partitionBy("canonical_url", "chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    revisits = slim.filter(keyed).withColumn("own", F.max("key").over(inside)).filter("kind = 'revisit'")
    revisits = revisits.join(ends, ["canonical_url", "chunk"]).withColumn("source", F.coalesce("own", "carried")).drop("own", "carried", "key", "chunk")
    lost = base.filter(~keyed & (F.col("kind") == "revisit")).drop("chunk").withColumn("source", F.lit(None).cast("struct<ts:bigint,record_id:bigint>"))
    revisits = revisits.unionByName(lost)

    sources = base.select(F.col("canonical_url").alias("surl"), full.alias("s")).filter("s is not null").select("surl", F.col("s.record_id").alias("sid"), F.col("s.ts").alias("sts"), F.col("s.etag").alias("setag"), F.col("s.last_modified").alias("smod"), F.col("s.headers").alias("sheaders"))
    sources = sources.groupBy("surl", "sid", "sts").agg(F.min_by(F.struct("setag", "smod", "sheaders"), F.struct("setag", "smod")).alias("s"))
    out = revisits.join(sources, (F.col("canonical_url") == F.col("surl")) & (F.col("source.record_id") == F.col("sid")) & (F.col("source.ts") == F.col("sts")), "left")
    strong = lambda c: F.regexp_replace(F.col(c), r"\AW/", "")
    by_etag = F.col("etag").isNotNull() & F.col("s.setag").isNotNull()
    by_time = ~by_etag & F.col("last_modified").isNotNull() & F.col("s.smod").isNotNull()
    agrees = F.when(by_etag, strong("etag") == strong("s.setag")).when(by_time, F.col("last_modified") == F.col("s.smod"))
    status = F.when(F.col("sid").isNull(), "orphan").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    none = F.create_map().cast("map<string,string>")
    changed = F.map_filter("headers", lambda k, _: F.lower(k).isin(*[p.lower() for p in permitted]))
    out = out.withColumn("changed", F.coalesce(changed, none))
    names = F.transform(F.map_keys("changed"), F.lower)
    kept = F.map_filter(F.coalesce(F.col("s.sheaders"), none), lambda k, _: ~F.array_contains(names, F.lower(k)))
    return out.select(
        "record_id", "canonical_url", "ts", F.col("sid").alias("source_id"), F.col("sts").alias("source_ts"),
        F.when(F.col("sid").isNotNull(), F.when(by_etag, "etag").when(by_time, "last_modified")).alias("validator"),
        status.alias("status"), F.when(status == "resolved", F.map_concat(kept, "changed")).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history made of the ``pages`` table: each row is a full response at a
    time set by its id; two of three are fetched again, as not-modified revisits, some
    with a changed validator, some by another spelling of the url. Every page in eight
    shares one url, so that its history is long."""
    i = F.col("page_id")
    url = F.when(i % 8 == 0, F.lit("http://hub.example.org/")).otherwise(F.col("url"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 16), F.lit('"'))
    day = F.lit(86_400)
    base = pages.select("page_id", url.alias("url"), tag.alias("tag"), (F.pmod(i * 7919, F.lit(400)) * day + F.pmod(i, F.lit(86_400))).alias("t0"))
    text = lambda c: c.cast("string")
    response = base.select((F.col("page_id") * 4).alias("record_id"), "url", F.col("t0").alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 5 != 0, F.col("tag")).alias("etag"), text(F.col("t0") - 60).alias("last_modified"), F.create_map(F.lit("date"), text(F.col("t0")), F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    later = F.col("t0") + F.pmod(F.col("page_id") * 31, F.lit(5)) * day + 30
    revisit = base.filter(F.col("page_id") % 3 != 0).select(
        (F.col("page_id") * 4 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).when(F.col("page_id") % 5 != 0, F.concat(F.lit("W/"), F.col("tag"))).alias("etag"),
        F.when(F.col("page_id") % 11 != 0, text(F.col("t0") - 60)).alias("last_modified"),
        F.create_map(F.lit("date"), text(later), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=120")).alias("headers"),
    )
    return response.unionByName(revisit)
