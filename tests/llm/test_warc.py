import io

import pytest
from pyspark.sql import functions as F

from vecflow.llm import warc
from vecflow.session import scratch_dir

PAGES = "page_id long, url string, html string, content string, payload_digest string"
BIG = "<p>été</p>\r\n\r\nWARC/1.0\r\n" * 60
ROWS = [(1, "http://a/x y", BIG, "", ""), (5, None, BIG, "", ""), (3, "http://b", BIG, None, None), (5, "http://c", BIG, "", ""),
        (7, "http://d\nq", None, "", ""), (8, "", "", "", ""), (9, "http://e", "short", "", ""), (10, "http://e", "short", "", ""),
        (None, "http://n", "other " * 300, "", ""), (None, None, None, None, None), (11, "http://l", "long \u0000 text " * 200_000, "", "")]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    path = scratch_dir(spark, "test-warc")
    got = warc.archive_pages(pages, path).collect()
    import hashlib
    want = []
    for p, _, html, *_ in ROWS:
        data = (html or "").encode()
        again = html == BIG and p != 5
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    texts = warc.read_warc(spark, path, payloads=True).where("record_type = 'response' and page_id is not null")
    assert {(r.page_id, bytes(r.payload)) for r in texts.collect()} == {(p, (h or "").encode()) for p, _, h, *_ in ROWS if p is not None and (h != BIG or p == 5)}


def test_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(pages, scratch_dir(spark, "test-warc")).count() == 0


def test_both_versions_are_read_by_their_own_fields():
    for version in (1, 2):
        data = warc.arc_version_block(version, "f.arc", "20210102030405") + b"".join(
            warc.arc_record(version, f"http://h/{i}", "20210102030405", "text/html", b"x\n" * i, "f.arc", 0) for i in range(3))
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [(v, f["URL"], p) for v, f, p in got] == [(version, f"http://h/{i}", b"x\n" * i) for i in range(3)]
        assert ("Filename" in got[0][1]) == (version == 2)
    assert warc.iso_date("20210102030405") == "2021-01-02T03:04:05Z"


def test_broken_streams_raise():
    with pytest.raises(ValueError, match="version block"):
        list(warc.read_arc(io.BytesIO(b"http://h 0.0.0.0 2020 text/html 1\nx\n")))
    cut = warc.arc_version_block(1, "f", "2020") + warc.arc_record(1, "http://h", "2020", "text/html", b"abc", "f", 0)[:-3]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_arc(io.BytesIO(cut)))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_warc(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))


def test_arc_files_are_converted(spark, tmp_path):
    """Archive files read as binaryFile, plain and gzip."""
    import gzip
    data = warc.arc_version_block(2, "f.arc", "20210102030405") + warc.arc_record(2, "http://h/", "20210102030405", "text/html", b"<p>", "f.arc", 0)
    (tmp_path / "a.arc").write_bytes(data)
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(data))
    got = warc.convert_arc(spark.read.format("binaryFile").load(f"file://{tmp_path}")).select("url", "warc_date", "payload", "arc_version").collect()
    assert [tuple(r) for r in got] == [("http://h/", "2021-01-02T03:04:05Z", b"<p>", 2)] * 2


def test_payloads_of_any_bytes_and_addresses_that_look_like_ids(spark, tmp_path, monkeypatch):
    """An image, an address that ends in #page=2, a header that is not UTF-8: through ARC, WARC files of two records each, and back."""
    image = b"\x89PNG\r\n\x1a\n\r\n\r\nWARC/1.0\r\n" + bytes(range(256)) * 8
    parts = [("http://h/a#page=2", image), ("http://h/b", image), ("http://h/\xe9", b"\xff\xfe\x00"), ("http://h/c", b"")]
    data = warc.arc_version_block(1, "f.arc", "20210102030405") + b"".join(
        f"{u} 0.0.0.0 20210102030405 image/png {len(p)}\n".encode("latin-1") + p + b"\n" for u, p in parts)
    (tmp_path / "a.arc").write_bytes(data)
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    alone = warc.convert_arc(files)
    assert [(r.page_id, r.url, bytes(r.payload)) for r in alone.collect()] == [(None, *p) for p in parts]
    monkeypatch.setattr(warc, "FILE_RECORDS", 2)
    path = scratch_dir(spark, "test-warc")
    blocks = files.selectExpr("content", "array(4L, 9L, null, 5L) as page_ids")
    warc.write_warc(warc.with_revisits(warc.convert_arc(blocks), warc.convert_arc(blocks, payloads=False)), path)
    assert spark.read.format("binaryFile").load(path).count() >= 2
    got = {r.page_id: (r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_warc(spark, path, payloads=True).collect()}
    assert got == {4: ("revisit", 9, b""), 9: ("response", None, image), None: ("response", None, parts[2][1]), 5: ("response", None, b"")}
    with pytest.raises(Exception, match="comes with 1 page ids"):
        warc.convert_arc(files.selectExpr("content", "array(4L) as page_ids")).collect()


def test_query_matches_sql(spark):
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.001/pages.parquet')")
    df = E.queries()["op3_arc_to_warc"](spark, "/root/testdata/sf0.001")
    rel = con.sql(E.oracle_sql()["op3_arc_to_warc"])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(rel.project(", ".join(cols)).fetchall(), key=repr)
    assert df.where(F.col("page_id").isNull()).count() == 0
