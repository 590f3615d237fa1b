import base64
import gzip
import hashlib
import json
import os
import re

from pyspark.sql import functions as F

from simlattice.llm import warc

PAGES = "page_id long, url string, html string"


def read(folder):
    """All records of all files that the manifests list: (file, headers, block)."""
    out = []
    for shard in json.load(open(f"{folder}/manifest.json"))["shards"]:
        for f in json.load(open(f"{folder}/{shard}"))["files"]:
            raw = open(f"{folder}/{f['file']}", "rb").read()
            assert len(raw) == f["bytes"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
            data, at, n = gzip.decompress(raw), 0, 0
            while at < len(data):
                end = data.index(b"\r\n\r\n", at)
                lines = data[at:end].decode().split("\r\n")
                h = dict(x.split(": ", 1) for x in lines[1:])
                assert lines[0] == "WARC/1.1"
                block = data[end + 4 : end + 4 + int(h["Content-Length"])]
                at = end + 4 + len(block) + 4
                assert h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                n += h["WARC-Type"] == "response"
                out.append((f["file"], h, block))
            assert n == f["records"]
    return out


def test_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    folder = str(tmp_path / "w")
    index = warc.write(pages, folder, shard_bytes=40_000, file_bytes=6_000).collect()
    responses = [(f, h, b) for f, h, b in read(folder) if h["WARC-Type"] == "response"]
    bodies = sorted(b.split(b"\r\n\r\n", 1)[1].decode() for _, _, b in responses)
    assert bodies == sorted(r["html"] for r in pages.collect()) and len(index) == len(bodies)
    urls = [h["WARC-Target-URI"] for _, h, _ in responses]
    assert urls == sorted(urls) and len({f for f, _, _ in responses}) > 3
    for r in index:  # each record can be read alone
        with open(f"{folder}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            one = gzip.decompress(f.read(r["length"]))
        assert r["url"].encode() in one and one.startswith(b"WARC/1.1")
    assert not [x for x in os.listdir(folder) if x.startswith("_")]


def test_the_same_bytes_whatever_the_partitions(spark, sf, tmp_path):
    pages, out = spark.read.parquet(f"{sf}/pages.parquet"), []
    for i, p in enumerate((pages.repartition(1), pages.repartition(7, "html"))):
        folder = str(tmp_path / str(i))
        warc.write(p, folder, shard_bytes=60_000, file_bytes=9_000).count()
        out.append({x: open(f"{folder}/{x}", "rb").read() for x in os.listdir(folder) if not x.startswith(".")})
    assert out[0] == out[1]


def test_headers_are_made_anew(spark, tmp_path):
    page = "<p>ä</p>"
    warc.write(spark.createDataFrame([(1, "http://x/é b", page)], PAGES), str(tmp_path / "w")).count()
    _, h, block = [x for x in read(str(tmp_path / "w")) if x[1]["WARC-Type"] == "response"][0]
    head, body = block.split(b"\r\n\r\n", 1)
    assert h["WARC-Target-URI"] == "http://x/%C3%A9%20b" and body == page.encode() and f"Content-Length: {len(body)}".encode() in head
    assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", h["WARC-Record-ID"]) and h["WARC-Payload-Digest"] == warc.digest(body)


def test_cases(spark, tmp_path):
    rows = [(1, None, None), (None, "http://b", ""), (2, "http://a", "x" * 500_000), (2, "http://a", "x" * 500_000), (3, "http://a", "y")]
    d = spark.createDataFrame(rows, PAGES).select("*", *[F.lit(1).alias(c) for c in ("shard", "page", "k", "s", "file")])
    index = warc.write(d, str(tmp_path / "a"), file_bytes=100).collect()
    assert len(index) == 5 and [h["WARC-Target-URI"] for _, h, _ in read(str(tmp_path / "a")) if h["WARC-Type"] == "response"] == ["about:blank", *["http://a"] * 3, "http://b"]
    assert warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "b")).count() == 0 and read(str(tmp_path / "b")) == []


def test_page_ids_of_any_type(spark, tmp_path):
    import datetime
    import decimal

    values = {"date": datetime.date(2020, 2, 3), "decimal(20,3)": decimal.Decimal("12.500"), "binary": b"\xff\x00x", "string": "é", "timestamp": datetime.datetime(2021, 1, 1, 5), "double": 2.5, "boolean": True}
    for i, (kind, v) in enumerate(values.items()):
        d = spark.createDataFrame([(v, "http://a", "x"), (None, "http://a", "y")], f"page_id {kind}, url string, html string")
        index = warc.write(d, str(tmp_path / str(i)))
        assert index.schema["page_id"].dataType == d.schema["page_id"].dataType
        got = [r["page_id"] for r in index.collect()]
        assert len(got) == 2 and None in got and v in got, kind


def test_one_url_fills_many_shards(spark, tmp_path):
    d = spark.createDataFrame([(i % 5 or None, None if i % 2 else "http://hot", f"page {i} " + "x" * 200) for i in range(400)] + [(7, "http://hot", "same")] * 50, PAGES)
    index = warc.write(d, str(tmp_path / "a"), shard_bytes=20_000).collect()
    by = {}
    for r in index:
        by.setdefault(r["shard"], []).append(r)
    assert len(index) == 450 and len(by) > 5 and max(map(len, by.values())) < 150
    urls = [h["WARC-Target-URI"] for _, h, _ in read(str(tmp_path / "a")) if h["WARC-Type"] == "response"]
    assert urls == sorted(urls)
