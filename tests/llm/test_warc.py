from __future__ import annotations

import io
import struct

import pytest
import zstandard

from tokenloom.llm import warc
from tokenloom.llm.warc import Archive, make_record, parse_record, read_archive, read_archives, settle_revisits, write_archives


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "http://a/x y\r\n", "<p>same</p>"), (5, "http://a/2", "<p>same</p>"), (None, None, "<p>same</p>"), (2, None, None), (3, "u", ""), (4, "u", "é" * 100_000), (5, "http://a/2", "<p>same</p>"), (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload int")
    path = str(tmp_path / "w")
    got = read_archives(write_archives(pages, path), path, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.page_id, r.payload_digest), []).append(r)
    same = warc.digest32(b"<p>same</p>")
    assert [x.record_type for x in by[5, same]] == ["response"] * 2
    assert [(x.record_type, x.refers_to, x.payload_bytes) for x in by[1, same] + by[None, same]] == [("revisit", 5, 11)] * 2
    empty = warc.digest32(b"")
    assert (by[2, empty][0].record_type, by[2, empty][0].refers_to) == ("revisit", 3) and by[3, empty][0].payload_bytes == 0
    assert bytes(by[4, warc.digest32("é".encode() * 100_000)][0].payload) == "é".encode() * 100_000
    assert by[None, warc.digest32(b"alone")][0].record_type == "response"


def test_small_payloads_stay_whole(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    got = {r.page_id: r.record_type for r in read_archives(write_archives(pages, path, least_bytes=3), path).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_archives(write_archives(pages, str(tmp_path)), str(tmp_path)).count() == 0


def test_dictionary_frame_and_single_records(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "a.warc.zst")
    a = Archive(fs.LocalFileSystem(), path, 3)
    records = [make_record(i, f"http://h/{i}", f"<html>{i} body text {i * 7}</html>".encode() * 20, warc.digest32(f"<html>{i} body text {i * 7}</html>".encode() * 20), None, "2026-01-01T00:00:00Z") for i in range(300)]
    for r in records:
        a.add(r)
    a.close()
    data = open(path, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(data[8 + size :])
    assert one == records[0]  # a frame holds one record
    assert list(read_archive(io.BytesIO(data))) == records
    assert len(data) - size < sum(map(len, records)) / 4
    with pytest.raises(ValueError):
        list(read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        parse_record(records[0].replace(b"body", b"BODY"))


def test_payloads_of_many_pages_are_settled_alike(spark, sf_dir):
    """A payload on more pages than the limit takes another way to the same revisits."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    pages = pages.union(pages.selectExpr("page_id + 100000", "''")).union(pages.selectExpr("page_id + 200000", "html")).union(spark.createDataFrame([(None, "")], pages.schema))
    options = {"page_id": "page_id", "payload": "html", "least_bytes": 0}
    few, many = (sorted(map(tuple, settle_revisits(pages, many_pages=m, **options).collect()), key=repr) for m in (1, 100_000))
    assert few == many and len(few) > 80


def test_attempts_do_not_share_names(spark, sf_dir, tmp_path):
    """Writing the same pages again leaves the first archives as they were, and each list reads back whole."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first, second = (write_archives(pages, str(tmp_path), archive_bytes=20_000) for _ in range(2))
    names = [{r.file for r in x.collect()} for x in (first, second)]
    assert not names[0] & names[1]
    a, b = (sorted(map(tuple, read_archives(x, str(tmp_path)).drop("file").collect()), key=repr) for x in (first, second))
    assert a == b and len(a) == pages.count()
