import hashlib
import io

from pyspark.sql import functions as F

from fraudlens.llm import warc as W
from fraudlens.session import ensure_checkpoint_dir
from tests.llm.util import SF, oracle, same

LONG = "<p>" + "x" * 1200
ODD = [(0, "http://a/", None), (1, None, ""), (2, "http://b/\r\nWARC/1.0", "short"), (3, "u", "short"), (4, "u", LONG), (5, "u", LONG),
       (6, "u", LONG + "é"), (7, "u", LONG + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"), (8, "u", "y" * 300_000), (8, "u", "y" * 300_000),
       (1, "u", "y" * 300_000), (None, "u", LONG), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (9, "u", "\u0000﻿ nul")]


def brute(rows):
    first = {}
    for d, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 1000:
            first[b] = max((x for x in (first.get(b), d) if x is not None), default=None)
    out = []
    for d, _, t in rows:
        b = (t or "").encode()
        f = first.get(b)
        again = f is not None and d != f
        out.append((d, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_odd_rows_match_brute_force(spark):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("n", "sha1", "id", "body", "first")})
    assert sorted((tuple(r) for r in W.warc_query(df).collect()), key=str) == brute(ODD)
    assert W.warc_query(df.limit(0)).count() == 0


def test_whole_table_matches_oracle(spark):
    from fraudlens.llm.queries import ORACLE, QUERIES
    df = QUERIES["op3_warc"](spark, SF)
    same(df, oracle(ORACLE["op3_warc"]))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)


def test_payload_urls_and_filters_survive_the_round_trip(spark):
    path = f"{ensure_checkpoint_dir(spark)}/warc-test-round-trip-{id(spark)}"
    W.write_archives(spark.createDataFrame(ODD, "page_id long, url string, html string"), path, compress=False)
    back = W.read_archives(spark, path).collect()
    assert len(back) == len(ODD)
    want = sorted(t or "" for d, _, t in ODD)
    got = sorted(r.payload.decode() for r in back if r.record_type == "response")
    assert set(got) == set(want)
    one = W.read_archives(spark, path, payload=False).where((F.col("record_type") == "response") & F.col("record_id").isin("<urn:page:2>", "<urn:page:8>"))
    assert sorted((r.record_id, r.target_uri, r.payload) for r in one.collect()) == [
        ("<urn:page:2>", "http://b/%0D%0AWARC/1.0", None), ("<urn:page:8>", "u", None), ("<urn:page:8>", "u", None)]
    pieces = W.WarcReader({"path": path, "partitionBytes": "1"}).partitions()
    assert len(pieces) > 1 and all(len(p.paths) == 1 for p in pieces)


def test_unwanted_payloads_are_not_parsed():
    rec = lambda kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    data = rec("request", b"a" * 10) + rec("response", b"\r\n\r\n") + rec("metadata", b"")
    got = list(W.records(io.BytesIO(data), True, lambda h: h["warc-type"] == "response"))
    assert [p for _, p in got] == [b"\r\n\r\n"]
    assert [p for _, p in W.records(io.BytesIO(data), False, lambda h: True)] == [None] * 3


def test_pushed_filters_are_taken_over():
    from pyspark.sql.datasource import EqualTo, GreaterThan
    r = W.WarcReader({"path": "/x"})
    rest = list(r.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(rest) == 1 and r.wanted == {"record_type": {"response"}}
