import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import warc


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://www.Example.com:80/A/b/?utm_source=x&b=2&a=1&ref=q#top", "example.com/A/b?a=1&b=2"),
        ("https://m.example.com", "example.com"),
        ("https://example.com/x.html?", "example.com/x.html"),
        ("example.com/?reference=1", "example.com?reference=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_record_round_trip(spark):
    rows = [(1, "<p>a\r\n\r\nb</p>é"), (2, "")]
    df = spark.createDataFrame(rows, "id long, body string")
    text = warc.record(F.lit("response"), F.lit("<urn:1>"), F.lit("http://a/"), F.lit("2024-01-02T03:04:05Z"), F.lit("HTTP/1.1 200 OK\r\nETag: \"x:y\"\r\nbad line\r\nVary: a"), F.col("body"))
    got = warc.parse(df.select("id", text.alias("record")), ("id",)).orderBy("id").collect()
    assert [bytes(r.body).decode() for r in got] == [b for _, b in rows]
    assert got[0].kind == "response" and got[0].status == 200 and got[0].url == "http://a/" and got[0].captured == datetime(2024, 1, 2, 3, 4, 5)
    assert [(h.name, h.value) for h in got[0].http] == [("etag", '"x:y"'), ("vary", "a")]


def test_streams_are_parted_by_length_and_bodies_end_with_it(spark):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n%s"
    bodies = [b"\x00\xff\xfe binary WARC/1.1", b"", b"x" * 300_000]
    records = [one % (25 + len(b), b) for b in bodies]
    streams = spark.createDataFrame([(1, b"\r\n\r\n".join(records) + b"\r\n\r\n"), (2, None), (3, b""), (4, b"junk"), (5, records[1][:40])], "id long, stream binary")
    parted = warc.split_records(streams, ("id",))
    got = warc.parse(parted, ("id", "record_no")).filter("id = 1").orderBy("record_no").collect()
    assert [bytes(r.body) for r in got] == bodies and all(r.status == 200 for r in got)
    assert sorted((r.id, r.record_no) for r in parted.collect()) == [(1, 0), (1, 1), (1, 2), (5, 0)]
    whole = warc.parse(streams.filter("id = 1").withColumnRenamed("stream", "record"), ("id",)).first()
    assert bytes(whole.body) == bodies[0]


def test_malformed_and_null_records(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "junk"), (4, "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Date: x\r\n\r\nHTTP/1.1 3"), (4, "junk")], "id long, record string")
    got = warc.resolve(warc.parse(df, ("id",)), ("id",)).collect()
    assert len(got) == 5 and all(r.outcome == "other" and r.refers_to is None for r in got)
    assert warc.resolve(warc.parse(df.limit(0), ("id",)), ("id",)).count() == 0


def test_resolution_against_brute_force_with_a_hot_url(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for i in range(500):
        url = "http://www.hot.com/" if rng.random() < 0.4 else rng.choice(["http://b.com/x", "https://m.b.com/x/", "http://c.com/?b=1&a=2", None])
        full = rng.random() < 0.2
        at = start + timedelta(seconds=rng.randrange(120))
        fields = [("etag", f'"{rng.randrange(2)}"')] if rng.random() < 0.7 else [("last-modified", str(rng.randrange(2)))] if rng.random() < 0.5 else []
        rows.append((i, "response" if full else "revisit", f"{i:05d}", at, url, [*fields, ("server", "s"), ("date", str(i))], 200 if full else 304, f"body {i}" if full else ""))
    schema = "id long, kind string, record_id string, captured timestamp, url string, http array<struct<name:string,value:string>>, status int, body string"
    got = {r.id: r for r in warc.resolve(spark.createDataFrame(rows, schema), ("id",)).collect()}
    key = {"http://www.hot.com/": "hot.com", "http://b.com/x": "b.com/x", "https://m.b.com/x/": "b.com/x", "http://c.com/?b=1&a=2": "c.com?a=2&b=1", None: None}
    seen = set()
    for r in rows:
        mine = got[r[0]]
        if r[1] == "response":
            assert mine.outcome == "full"
            continue
        earlier = [x for x in rows if x[1] == "response" and key[x[4]] is not None and key[x[4]] == key[r[4]] and (x[3], x[2]) < (r[3], r[2])]
        if not earlier:
            want = "unresolved", None
        else:
            last = max(earlier, key=lambda x: (x[3], x[2]))
            own, stored = dict(r[5]), dict(last[5])
            fits = own["etag"] == stored.get("etag") if "etag" in own else own["last-modified"] == stored.get("last-modified") if "last-modified" in own else True
            want = ("resolved", last[2]) if fits else ("validator_mismatch", None)
            if fits:
                merged = stored | {k: v for k, v in own.items() if k != "server"}
                assert dict((h.name, h.value) for h in mine.headers) == merged and mine.payload_bytes == len(last[7])
        assert (mine.outcome, mine.refers_to) == want
        seen.add(want[0])
    assert seen == {"resolved", "unresolved", "validator_mismatch"}
