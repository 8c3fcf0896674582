import gzip

import pytest
from pyspark.sql import functions as F

from netframe.llm.common import fresh_dir
from netframe.llm.warc import WarcReader, page_records, read_warc, register, write_pages

PAGES = [
    (3, "http://a/1", "x" * 120),
    (1, "http://a/ 2\n", "x" * 120),
    (2, None, "short"),
    (4, "http://b", "short"),
    (5, "http://c", None),
    (6, "http://d", "é" * 60),
    (7, "http://e", "é" * 60),
    (None, "http://f", "x" * 120),
    (8, "http://g", "a\r\n\r\nWARC/1.1\r\n" * 20),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    uri = fresh_dir(spark, "warc")
    write_pages(pages(spark), uri, compression=compression, file_bytes=500)
    rows = {r["record_id"]: r for r in read_warc(spark, uri).collect()}
    assert len(rows) == len(PAGES)
    assert rows["urn:page:1"]["record_type"] == "response" and bytes(rows["urn:page:1"]["payload"]) == b"x" * 120
    assert rows["urn:page:3"]["record_type"] == "revisit" and rows["urn:page:3"]["refers_to"] == "urn:page:1"
    assert rows["urn:page:3"]["payload"] is None and rows["urn:page:3"]["payload_bytes"] == 120
    assert rows["urn:page:2"]["record_type"] == rows["urn:page:4"]["record_type"] == "response"
    assert rows["urn:page:5"]["payload_bytes"] == 0 and bytes(rows["urn:page:5"]["payload"]) == b""
    assert rows["urn:page:7"]["refers_to"] == "urn:page:6" and rows["urn:page:7"]["payload_bytes"] == 120
    assert bytes(rows["urn:page:8"]["payload"]).decode() == PAGES[-1][2]
    assert rows["urn:page:1"]["target_uri"] == "http://a/%202%0A" and rows["urn:page:2"]["target_uri"] == "about:blank"


def test_pushed_predicates_and_skipped_payloads(spark):
    uri = fresh_dir(spark, "warc")
    write_pages(pages(spark), uri)
    again = read_warc(spark, uri).where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r["record_id"] for r in again.collect()] == ["urn:page:3"]
    none = read_warc(spark, uri, payload="false").where(F.col("record_type") == "response").collect()
    assert none and all(r["payload"] is None for r in none)
    reader = WarcReader({"path": uri})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.tests == [("in", "record_type", ("response",))]


def test_foreign_gzip_and_empty_folder(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record % (k, n)) for n, k in enumerate((b"warcinfo", b"resource", b"resource"))))
    rows = read_warc(spark, f"file://{tmp_path}").where("record_type = 'resource'").collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in rows) == [("urn:x:1", b"hello"), ("urn:x:2", b"hello")]
    register(spark)
    assert read_warc(spark, fresh_dir(spark, "nothing")).count() == 0


def test_extra_columns_and_empty_table(spark):
    wide = pages(spark).withColumn("payload", F.lit(1)).withColumn("id", F.lit(2)).withColumn("first", F.lit(3))
    assert page_records(wide).count() == len(PAGES)
    assert page_records(pages(spark, [])).count() == 0
