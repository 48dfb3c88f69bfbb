"""Archives of other programs, archives that end early, payloads full of version lines."""

import hashlib
import random
import time

import pytest

from lexmill.llm import warc


def record(payload, version="1.0", length="Content-Length", sep=": ", kind="WARC-Type", page=1):
    head = f"WARC/{version}\r\n{kind}{sep}response\r\nwarc-record-id{sep}<urn:page:{page}>\r\nWARC-Target-URI{sep}http://x/\r\n{length}{sep}{len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_header_names_in_any_case_and_versions(spark, tmp_path):
    payloads = [b"one", b"WARC/1.1\r\nWARC/1.0\r\ntwo", "dr\u00e9i WARC/1.".encode(), b""]
    data = record(payloads[0], length="content-length", page=1) + record(payloads[1], "1.1", page=2) + record(payloads[2], "1.1", "CONTENT-LENGTH", ":", "warc-type", 3) + record(payloads[3], sep=":  ", page=4)
    (tmp_path / "a.warc").write_bytes(data)
    got = sorted(warc.read(spark, str(tmp_path)).collect(), key=lambda r: r.id)
    assert [(r.id, r.type, bytes(r.payload), r.payload_digest, r.url) for r in got] == [(i + 1, "response", p, hashlib.sha1(p).hexdigest(), "http://x/") for i, p in enumerate(payloads)]


@pytest.mark.parametrize("tail", [b"WARC/1.0\r\nContent-Type: x\r\n\r\nno length", b"junk", b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort"])
def test_a_chain_that_ends_early_is_an_error(spark, tmp_path, tail):
    (tmp_path / "good.warc").write_bytes(record(b"fine"))
    (tmp_path / "bad.warc").write_bytes(record(b"one") + tail)
    with pytest.raises(ValueError, match="bad.warc"):
        warc.read(spark, str(tmp_path))


def test_files_without_records_are_an_error_and_empty_ones_are_not(spark, tmp_path):
    (tmp_path / "good.warc").write_bytes(record(b"fine"))
    (tmp_path / "empty.warc").write_bytes(b"")
    assert warc.read(spark, str(tmp_path)).count() == 1
    (tmp_path / "other.warc").write_bytes(b"not an archive at all")
    with pytest.raises(ValueError, match="other.warc"):
        warc.read(spark, str(tmp_path))


def test_payloads_full_of_version_lines_take_no_longer(spark):
    pages = lambda line: spark.createDataFrame([(1, "u", line * (1_000_000 // len(line))), (2, "v", "plain")], "page_id long, url string, html string")
    took = {}
    for name, line in (("plain", "abcdefgh\r\n"), ("warm", "abcdefgh\r\n"), ("lines", "WARC/1.0\r\n"), ("again", "WARC/1.0\r\n")):
        began = time.time()
        got = {r.page_id: r.payload_digest for r in warc.round_trip(pages(line)).collect()}
        took[name] = time.time() - began
        assert got[1] == hashlib.sha1((line * (1_000_000 // len(line))).encode()).hexdigest()
    assert took["again"] < took["warm"] + 15


def test_random_bytes_of_the_format_in_payloads(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rng.choices(["WARC/1.", "0\r\n", "\r\n", "Content-Length: 3", "x", "1"], k=rng.randrange(60)))) for i in range(80)]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.payload_digest for r in out} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows} and len(out) == len(rows)
