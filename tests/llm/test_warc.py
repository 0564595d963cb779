import base64
import hashlib

from chainsurf.llm import warc

PAGES = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (3, None, None),
    (4, "http://b.example/a b%20\r\nX: y\t\x00\x7fé%", "tail\r\n\r\nWARC/1.1\r\n\r\n"),
    (5, "http://b.example/", "é" * 5000),
    (6, "x", ""),
    (6, "y", ""),
    (None, "z", "<p>one</p>"),
    (None, "z", "alone"),
    (9, "big", "0123456789" * 900_000),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, refers_to int").repartition(2)
    got = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.round_trip(pages).collect()), key=str)
    want = []
    for k, _, html in PAGES:
        same = [a for a, _, b in PAGES if (b or "") == (html or "") and a is not None]
        top = max(same) if same else None
        revisit = top is not None and (k is None or k < top)
        want.append((k, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=str)


def test_smallest_and_index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = warc.new_path(spark, "test-warc")
    warc.write(pages, path, smallest=100, per_file=3)
    rows = {(x.page_id, x.url): x for x in warc.index(spark, path).collect()}
    assert all(x.record_type == "response" for x in rows.values()) and len(rows) == 10 - 1
    assert set(rows) == {(k, u or "") for k, u, _ in PAGES}
    some = warc.read(warc.index(spark, path).filter("page_id in (2, 5)")).collect()
    assert {x.page_id: x.payload.decode() for x in some} == {2: "<p>one</p>", 5: "é" * 5000}


def test_ranges_are_coalesced():
    assert warc.ranges([(0, 10), (14, 6), (1000, 5)], gap=10, chunk=100) == [(0, 20, [0, 1]), (1000, 1005, [2])]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
