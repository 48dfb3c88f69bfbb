"""Urls of any length keep their record and all records after it in the same file."""

import hashlib
from collections import Counter

import pytest

from lexmill.llm import warc


@pytest.mark.parametrize("length", [16_000, 16_384, 100_000])
def test_long_url(spark, length):
    long = "https://example.org/?q=" + "x" * length
    pages = [(1, "https://a", "<p>one</p>"), (2, long, "<p>two</p>"), (3, "https://c", "<p>three</p>"), (4, long + "4", "<p>same</p>" * 200), (5, long + "5", "<p>same</p>" * 200), (6, "https://f", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    want = {i: (len(h), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, _, h in pages}
    want[4] = (*want[4][:2], "revisit", 5)
    assert got == want


def test_urls_are_read_back_whole(spark, tmp_path):
    pages = [(i, "https://e/" + "é" * n, f"<p>{i}</p>") for i, n in enumerate([1, 9_000, 50_000, 2])]
    path = str(tmp_path / "w")
    warc.write(warc.records(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)), path)
    assert {r.id: (r.url, bytes(r.payload).decode()) for r in warc.read(spark, path).collect()} == {i: (u, h) for i, u, h in pages}


def test_a_megabyte_of_url(spark):
    pages = [(1, "https://a", "one"), (2, "data:," + "x" * 1_000_000, "two"), (3, "https://c", "three")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(df).collect()} == {1: 3, 2: 3, 3: 5}


def test_one_response_for_equal_payloads_of_equal_ids(spark):
    same = "y" * 1500
    pages = [(5, "u", same), (5, "u", same), (5, "v", same), (3, "u", same), (None, "u", same), (None, "u", "z" * 1200), (None, "w", "z" * 1200), (7, "u", "z" * 999), (7, "u", "z" * 999), (8, "u", "q" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == {
        (5, 1500, "response", None): 1, (5, 1500, "revisit", 5): 2, (3, 1500, "revisit", 5): 1, (None, 1500, "revisit", 5): 1,
        (None, 1200, "response", None): 1, (None, 1200, "revisit", None): 1, (7, 999, "response", None): 2, (8, 1000, "response", None): 1,
    }


def test_readings_cut_differently_agree(spark, tmp_path):
    pages = [(i, "u", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc" * (i % 4) + f"text {i} " * (i * 13 % 90)) for i in range(80)]
    path = str(tmp_path / "cut")
    warc.write(warc.records(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)), path)
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("700", "9000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append({(r.file, r.at): (r.id, bytes(r.payload).decode()) for r in warc.read(spark, path).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] == found[2] and dict(found[0].values()) == {i: h for i, _, h in pages}
