import base64
import gzip
import hashlib
import io
import os

import pytest
from conftest import SF
from pyspark.sql import functions as F

from framestride.llm import shared, warc


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def read(data):
    return list(warc.read(Bytes(data), len(data)))


def one(i, payload=b"<p>x</p>", zipped=True):
    raw = warc.record("response", f"urn:page:{i}:X", "http://a/b c", payload, len(payload), warc.digest(payload), None, "2020-01-01T00:00:00Z")
    return warc._member(raw) if zipped else raw


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    # Some payloads again, below and above their first page.
    more = pages.unionAll(pages.where("page_id < 20").withColumn("page_id", F.col("page_id") + 100_000))
    rows = [(r["page_id"], r["html"]) for r in more.collect()]
    first = {}
    for i, h in rows:
        first[h] = min(i, first.get(h, i))
    want = sorted((i, len(h.encode()), digest(h.encode()), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in rows)
    assert sorted(map(tuple, warc.round_trip(more).collect())) == want


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "http://a", ""), (3, "u\nx", "é" * 10), (None, "u", "é" * 10), (4, "u", "z"), (4, "u", "z"), (None, "u", "only"), (5, "u", "big " * 500_000)]
    got = warc.round_trip(spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, size int")).collect()
    seen = sorted((repr(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    assert seen == sorted([("1", 0, "response", None), ("2", 0, "revisit", 1), ("3", 20, "response", None), ("None", 20, "revisit", 3), ("4", 1, "response", None), ("4", 1, "response", None), ("None", 4, "response", None), ("5", 2_000_000, "response", None)])
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_string_ids_and_reading_tasks(spark):
    rows = [("a:b", "x"), ("", "x"), (None, "x"), ("%", "own é"), ("<é\r\n>", "two"), ("+ %20", "two")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string").repartition(4)
    got = warc.round_trip(pages).collect()
    want = {("a:b", "revisit", ""), ("", "response", None), (None, "revisit", ""), ("%", "response", None), ("<é\r\n>", "revisit", "+ %20"), ("+ %20", "response", None)}
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == want
    names = spark.createDataFrame([(f"file:///none/{i}",) for i in range(7)] + [(None,)], "path string")
    assert warc.salvage(spark, names).rdd.getNumPartitions() == 7


def test_archives_are_gzip_that_others_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 2000)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    made = warc.write(pages, shared.scratch(spark, "warc")).collect()
    assert sum(r["records"] for r in made) == pages.count()
    for r in made:
        path = r["path"].removeprefix("file://")
        data = open(path, "rb").read()
        assert len(data) == r["bytes"] == os.path.getsize(path)
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == r["records"]
    paths = spark.createDataFrame([(r["path"],) for r in made], "path string")
    back = warc.salvage(spark, paths).where("gap is null").select(F.col("payload").cast("string")).collect()
    assert sorted(r[0] for r in back) == sorted(r["html"] for r in pages.collect())


@pytest.mark.parametrize("zipped", [True, False])
def test_damage_is_a_gap_and_the_rest_is_recovered(zipped):
    good = [one(i, bytes([65 + i]) * 200, zipped) for i in range(5)]
    at = [sum(map(len, good[:i])) for i in range(6)]
    ids = lambda found: [x["record_id"].split(":")[2] for x in found if x["gap"] is None]
    gaps = lambda found: [(x["begin"], x["end"]) for x in found if x["gap"] is not None]
    whole = read(b"".join(good))
    assert ids(whole) == list("01234") and not gaps(whole) and [(x["begin"], x["end"]) for x in whole] == list(zip(at[:-1], at[1:], strict=True))
    broken = bytearray(b"".join(good))
    broken[at[1] + len(good[1]) // 2] ^= 255
    broken[at[3] + len(good[3]) // 2] ^= 255
    found = read(bytes(broken))
    assert ids(found) == list("024") and gaps(found) == [(at[1], at[2]), (at[3], at[4])]
    cut = read(b"".join(good)[: at[4] + 30])
    assert ids(cut) == list("0123") and gaps(cut) == [(at[4], at[4] + 30)]
    noise = read(b"noise\x1f\x8b\x08" + good[0] + b"WARC/1." + good[1])
    assert ids(noise) == list("01") and gaps(noise) == [(0, 8), (8 + at[1], 8 + at[1] + 7)]
    assert read(b"") == [] and gaps(read(b"\0" * 1000)) == [(0, 1000)]


def test_a_false_digest_or_length_is_found():
    raw = one(1, b"abc", False)
    assert read(raw.replace(b"abc", b"abd"))[0]["gap"] == "block digest differs"
    assert read(raw.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"))[0]["gap"] == "payload digest differs"
    assert "length" in read(raw.replace(b"Content-Length: 3\r\n\r\nabc", b"Content-Length: 3\r\n\r\nabcdef"))[0]["gap"]


def test_several_records_in_one_member():
    both = warc._member(one(1, b"a", False) + one(2, b"b", False))
    assert [x["payload"] for x in read(both + one(3, b"c"))] == [b"a", b"b", b"c"]


@pytest.mark.parametrize("zipped", [True, False])
def test_a_long_incompressible_url(zipped):
    url = "http://a/" + os.urandom(1_000_000).hex()
    raw = warc.record("response", "urn:page:1:X", url, b"x", 1, warc.digest(b"x"), None, "2020-01-01T00:00:00Z")
    found = read((warc._member(raw) if zipped else raw) + one(2, b"y", zipped))
    assert [(x["gap"], x.get("payload")) for x in found] == [(None, b"x"), (None, b"y")] and found[0]["target_uri"] == url


def test_damage_in_a_member_of_several_records():
    raw = [one(i, os.urandom(50_000), False) for i in range(5)]
    ids = lambda found: [x["record_id"].split(":")[2] for x in found if x["gap"] is None]
    gaps = lambda found: [x["gap"] for x in found if x["gap"] is not None]
    at = [sum(map(len, raw[:i])) for i in range(6)]
    bad = bytearray(b"".join(raw))
    bad[at[2] - 100] ^= 255
    after = one(7)
    found = read(warc._member(bytes(bad)) + after)
    assert ids(found) == list("02347") and gaps(found) == [f"block digest differs (inflated bytes {at[1]} to {at[2]})"]
    length = b"".join(raw).replace(b"Content-Length: 50", b"Content-Length: 95", 1)
    assert ids(read(warc._member(length) + after)) == list("12347")
    whole = warc._member(b"".join(raw))
    found = read(whole[: len(whole) // 2])
    assert ids(found) == list("01") and len(gaps(found)) > 0 and found[-1]["end"] == len(whole) // 2
    torn = bytearray(whole)
    torn[len(whole) // 2 : len(whole) // 2 + 5000] = b""
    found = read(bytes(torn) + after)
    assert ids(found)[:2] == list("01") and ids(found)[-1] == "7" and gaps(found)
