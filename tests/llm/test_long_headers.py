"""WARC records whose header is long or holds a magic line."""

from cellgrove.llm import warc
from test_warc import _round_trip


def test_long_urls_between_ordinary_pages(spark):
    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(8)]
    rows[3] = (3, "data:" + "x" * 200_000, "long url")
    rows[5] = (5, "http://h/" + " " * 30_000, "blanks")
    rows[6] = (6, "http://h/WARC/1.0", "magic ends the url")
    _round_trip(spark, rows, "128m")


def test_long_urls_over_splits(spark):
    rows = [(i, "http://h/" + "y" * (70_000 if i % 4 == 1 else 9), f"page {i} " * 40) for i in range(20)]
    _round_trip(spark, rows, "30000")


def test_long_http_headers():
    head = b"HTTP/1.1 200 OK\r\nX-Fill: " + b"z" * 100_000 + b"\r\n\r\n"
    assert warc._payload(head + b"body")[:2] == (len(head), b"body")
