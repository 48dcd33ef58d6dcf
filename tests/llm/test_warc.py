"""WARC: exact round trips, payloads with magic lines, records over splits, revisits."""

import hashlib

import pytest

from cellgrove.llm import warc


def _expected(rows):
    by_digest = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            key = hashlib.sha1(data).hexdigest()
            by_digest[key] = max(by_digest.get(key, page), page)
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        key = hashlib.sha1(data).hexdigest()
        last = by_digest.get(key)
        revisit = last is not None and last != page
        out.add((page, len(data), key, "revisit" if revisit else "response", last if revisit else None))
    return out


def _round_trip(spark, rows, split):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    path = warc.archive(pages)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == len(rows)
    assert {tuple(r) for r in found} == _expected(rows)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 77\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"


def test_round_trip_with_magic_in_payloads(spark):
    rows = [(1, "http://a/1", "x" * 1500), (2, None, None), (3, "http://a/ b\r\nc", ""), (4, "http://a/4", "x" * 1500), (5, "u", "y" * 10), (6, "u", "y" * 10)]
    rows += [(7, "u", FAKE), (8, "u", "WARC/1.0\r\n" * 3), (9, "u", "é" * 700 + FAKE * 4), (10, "u", "\r\n\r\nWARC/1.0\r\n" + "Content-Length: 99999999\r\n\r\n"), (11, "u", "é" * 700 + FAKE * 4)]
    _round_trip(spark, rows, "128m")


def test_records_over_many_splits(spark):
    rows = [(i, f"http://h/{i}", (f"text {i} " * (i * 7 % 300)) + (FAKE if i % 5 == 0 else "")) for i in range(60)]
    rows.append((60, "u", "z" * 9000 + FAKE + "z" * 9000 + FAKE))
    _round_trip(spark, rows, "2000")


def test_numbers_that_do_not_fit_are_no_records(spark):
    huge = ["99999999999999999999999", "9223372036854775800", "9223372036854775807", "1" * 5000, "\u00b2", "-5", "1099511627777"]
    rows = [(i, "u", f"a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: {i}\r\nContent-Length: {x}\r\n\r\nb\r\n\r\n") for i, x in enumerate(huge)]
    rows += [(20 + i, "u", f"WARC/1.0\r\nWARC-Type: revisit\r\nX-Page-ID: {x}\r\nX-Refers-To-Page-ID: {x}\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\nWARC/1.0\r\n") for i, x in enumerate(huge)]
    rows += [(40 + i, "u", f"WARC/1.0\r\nWARC-Type: revisit\r\nContent-Length: 60\r\n\r\nHTTP/1.1 200 OK\r\nX-Payload-Length: {x}\r\n\r\n\r\n\r\nWARC/1.0\r\n") for i, x in enumerate(huge)]
    _round_trip(spark, rows, "128m")
    _round_trip(spark, rows, "1500")


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        warc.archive(spark.createDataFrame([("1", "u", "x")], "page_id string, url string, html string"))


def test_empty(spark):
    _round_trip(spark, [], "128m")
