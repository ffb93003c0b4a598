"""WARC records and the resolution of not-modified revisits.

A revisit that says 304 has no body: it stands for the latest earlier full response of the same canonical URL.
``resolve`` finds that response by an as-of join, compares validators, and merges the headers a 304 may change
into the response's.

The join never gathers a URL in one task.  Small columns only (no bodies) are range-partitioned by URL, time and
record id, so a URL with a third of all captures lies in many shards; each shard carries its last response
forward, and what a shard's URL had before comes from a table with one row for each shard and URL.

Canonical URL: scheme, default port, fragment, ``www.`` and ``m.`` and tracking parameters are dropped, the host
is lowered, other parameters are sorted, and a path loses its last slash.

Defined cases: a record without URL is never matched; captures of one instant are ordered by record id; rows
that repeat are resolved one by one; a revisit whose latest earlier response has other validators is
``validator_mismatch`` and refers to nothing; without an earlier response it is ``unresolved``; malformed records
have null fields; an empty table gives an empty result; further columns of the records are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import cut, slices

CRLF = "\r\n"
#: Header fields of a 304 that replace the stored response's.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """The URL's canonical form; null for null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\??(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def headers(block: Column) -> Column:
    """Lower-case names and values of the lines of a header block, in order; lines without a colon are left out."""
    lines = F.filter(F.split(block, CRLF), lambda line: F.instr(line, ":") > 1)
    return F.transform(
        lines,
        lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"), F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("value")),
    )


def header(found: Column, name: str) -> Column:
    """The last value of a field; null if there is none."""
    return F.try_element_at(F.filter(found, lambda h: h["name"] == name), F.lit(-1))["value"]


def record(kind: Column, record_id: Column, url: Column, date: Column, http: Column, body: Column) -> Column:
    """A WARC/1.1 record as text; http is the status line and header lines, body is empty for a revisit."""
    block = F.concat(http, F.lit(CRLF * 2), body)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block, F.lit(CRLF * 2))


def split_records(streams: DataFrame, keys: tuple[str, ...], stream: str = "stream") -> DataFrame:
    """keys, record_no (from 0) and record (binary) of the WARC records in each stream, parted by their Content-Length.

    A record without a valid length ends at the stream's end; bytes between records that are no record are skipped.
    """

    def parts(raw: bytes) -> list[bytes]:
        out, at = [], raw.find(b"WARC/")
        while at >= 0:
            gap = raw.find(b"\r\n\r\n", at)
            said = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", raw[at : gap if gap >= 0 else len(raw)])
            end = gap + 4 + int(said.group(1)) if said and gap >= 0 else len(raw)
            out.append(raw[at:end])
            at = raw.find(b"WARC/", end)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20):
            found = [parts(r or b"") for r in batch.column("_stream").to_pylist()]
            taken = batch.select(batch.schema.names[:-1]).take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
            made = [pa.array([k for f in found for k in range(len(f))], pa.int32()), pa.array([r for f in found for r in f], pa.binary())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*taken.schema.names, "record_no", "record"])

    fields = ", ".join(f"`{k}` {streams.schema[k].dataType.simpleString()}" for k in keys)
    return streams.select(*keys, F.col(stream).cast("binary").alias("_stream")).mapInArrow(run, f"{fields}, record_no int, record binary")


def parse(records: DataFrame, keys: tuple[str, ...], text: str = "record") -> DataFrame:
    """keys, kind, record_id, url, captured, status, http (header fields) and body (binary) of WARC records, text or binary.

    The block is as long as Content-Length says, or the rest of the record where it says nothing valid.
    """
    gap = CRLF * 2
    before = lambda c: F.substring_index(c.cast("string"), gap, 1)
    raw = F.col(text).cast("binary")
    split = records.select(*keys, raw.alias("_raw"), before(raw).alias("_top"))
    split = split.select(*keys, "_raw", headers(F.col("_top")).alias("_head"), (F.octet_length("_top") + 5).alias("_from"))
    said = header(F.col("_head"), "content-length").try_cast("int")
    size = F.when(said >= 0, said).otherwise(F.octet_length("_raw"))
    split = split.select(*keys, "_head", F.substring(F.col("_raw"), F.col("_from"), size).alias("_block"))
    split = split.select(*keys, "_head", "_block", before(F.col("_block")).alias("_http"))
    body = F.substring(F.col("_block"), F.octet_length("_http") + 5, F.octet_length("_block"))
    return split.select(
        *keys,
        F.lower(header(F.col("_head"), "warc-type")).alias("kind"),
        header(F.col("_head"), "warc-record-id").alias("record_id"),
        header(F.col("_head"), "warc-target-uri").alias("url"),
        F.try_to_timestamp(header(F.col("_head"), "warc-date")).alias("captured"),
        F.regexp_extract("_http", r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("status"),
        headers(F.col("_http")).alias("http"),
        F.coalesce(body, F.lit(b"")).alias("body"),
    )


def as_of(records: DataFrame, what: Column) -> DataFrame:
    """records with found: ``what`` of the latest earlier full response of each record's canonical URL.

    records has url_key, captured, record_id and is_full.
    """
    shards = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["captured", "record_id"]
    dealt = records.withColumn("_full", F.when(F.col("is_full"), F.struct(*order, what.alias("what"))))
    dealt = cut(dealt.repartitionByRange(shards, "url_key", *order).withColumn("_shard", F.spark_partition_id()), "warc-shards")
    within = W.partitionBy("_shard", "url_key").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt.withColumn("_near", F.last("_full", ignorenulls=True).over(within))
    ends = dealt.groupBy("_shard", "url_key").agg(F.max("_full").alias("_last"))  # a row for each shard and URL
    earlier = W.partitionBy("url_key").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col("_shard").alias("_s"), F.col("url_key").alias("_u"), F.last("_last", ignorenulls=True).over(earlier).alias("_before")).filter("_before IS NOT NULL")
    joined = local.join(carried, (F.col("_shard") == F.col("_s")) & (F.col("url_key") == F.col("_u")), "left")
    found = F.when(F.col("url_key").isNotNull(), F.coalesce("_near", "_before")["what"])
    return joined.withColumn("found", found).drop("_full", "_near", "_shard", "_s", "_u", "_before")


def same_version(own: Column, stored: Column) -> Column:
    """Whether a revisit's validators fit the response's: its entity tag (weakly), else its date, else nothing to object."""
    tag, stored_tag = (F.regexp_replace(header(h, "etag"), "^W/", "") for h in (own, stored))
    date, stored_date = (header(h, "last-modified") for h in (own, stored))
    return F.when(tag.isNotNull(), F.coalesce(tag == stored_tag, F.lit(False))).when(date.isNotNull(), F.coalesce(date == stored_date, F.lit(False))).otherwise(True)


def merged(own: Column, stored: Column) -> Column:
    """The response's header fields with the permitted ones of the 304 in place of its own, sorted by name."""
    new = F.filter(own, lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    return F.array_sort(F.concat(F.filter(stored, lambda h: ~F.array_contains(names, h["name"])), new))


def resolve(parsed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, url_key, kind, outcome, refers_to, headers, payload_sha256 and payload_bytes of every record.

    A full response keeps its own headers and payload; a resolved revisit has those it stands for.
    """
    small = parsed.select(
        *keys, "kind", "record_id", "captured", canonical_url(F.col("url")).alias("url_key"), F.coalesce("http", F.array().cast("array<struct<name:string,value:string>>")).alias("http"),
        F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False)).alias("is_full"),
        F.coalesce((F.col("kind") == "revisit") & (F.col("status") == 304), F.lit(False)).alias("is_revisit"),
        F.sha2("body", 256).alias("payload_sha256"), F.octet_length("body").cast("long").alias("payload_bytes"),
    )
    found = as_of(small, F.struct("record_id", "http", "payload_sha256", "payload_bytes"))
    revisit, stored = F.col("is_revisit"), F.col("found")
    fits = revisit & stored.isNotNull() & same_version(F.col("http"), stored["http"])
    outcome = F.when(~revisit, F.when(F.col("is_full"), "full").otherwise("other")).when(stored.isNull(), "unresolved").when(fits, "resolved").otherwise("validator_mismatch")
    return found.select(
        *keys, "url_key", "kind", outcome.alias("outcome"), F.when(fits, stored["record_id"]).alias("refers_to"),
        F.when(fits, merged(F.col("http"), stored["http"])).otherwise(F.array_sort("http")).alias("headers"),
        F.when(fits, stored["payload_sha256"]).when(~revisit, F.col("payload_sha256")).alias("payload_sha256"),
        F.when(fits, stored["payload_bytes"]).when(~revisit, F.col("payload_bytes")).alias("payload_bytes"),
    )
