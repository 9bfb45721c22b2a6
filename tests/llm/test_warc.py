import gzip
import hashlib
from pathlib import Path

import pytest
from pairwright.llm import warc
from pyspark.sql import functions as F


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark, tmp_path):
    long = "".join(chr(97 + i % 26) for i in range(70_001)) + "é漢\r\nWARC/1.1\r\n\r\n0\r\n\r\n"
    same = "same " * 300
    rows = [(1, "http://a/", "hi"), (2, "http://b/", None), (3, None, ""), (4, "u", long), (5, "u", same), (6, "u", same), (9, "u", same), (7, "u", "s" * 999), (8, "u", "s" * 999), (9, "u", same), (None, "u", same), (None, "u", "alone")]
    out = warc.round_trip(pages(spark, rows).withColumn("payload", F.lit("clash")), str(tmp_path / "w")).collect()
    assert len(out) == len(rows) and all(r["problem"] is None for r in out)
    text = lambda t: (t or "").encode()
    want = sorted(str((i, len(text(t)), hashlib.sha1(text(t)).hexdigest(), *(("revisit", 9) if t == same and i != 9 else ("response", None)))) for i, _, t in rows)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out) == want
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("*.gz"))
    assert raw.count(b"WARC-Type: continuation") >= 4 and b"WARC-Segment-Total-Length" in raw and b"Transfer-Encoding: chunked" in raw


def test_damage_is_named(spark, tmp_path):
    warc.write(pages(spark, [(1, "u", "x" * 50_000), (2, "u", "y" * 50_000)]), str(tmp_path / "w"))
    records = warc.read(str(tmp_path / "w"), spark).cache()
    assert {r["problem"] for r in warc.reassemble(records).collect()} == {None}
    first = records.where("page_id = 1").first()["origin_id"]
    lost = warc.reassemble(records.where((F.col("origin_id") != first) | F.coalesce(F.col("segment") != 2, F.lit(True)))).collect()
    assert {r["page_id"]: r["problem"] for r in lost} == {1: "missing_segment", 2: None}
    cut = records.withColumn("block", F.when((F.col("origin_id") == first) & (F.col("segment") == 2), F.expr("substring(block, 1, 100)")).otherwise(F.col("block")))
    assert {r["page_id"]: r["problem"] for r in warc.reassemble(cut).collect()}[1] == "length_mismatch"


@pytest.mark.parametrize("block,want", [(b"HTTP/1.1 200 OK\r\n\r\nplain", (b"plain", None)), (b"no header", (b"", "no_http_header")), (b"H\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\n0\r\n\r\n", (b"abc", None)), (b"H\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc\r\n0\r\n\r\n", (b"", "bad_chunk"))])
def test_chunks(block, want):
    assert warc._payload(block) == want


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(pages(spark, []).limit(0), str(tmp_path / "e")).count() == 0
