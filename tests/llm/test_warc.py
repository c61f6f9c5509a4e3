import gzip
import hashlib
import io
import os
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import warc

LONG = "<p>" + "long page é ☃ \r\n\r\nWARC/1.1\r\n" * 20_000
SAME = "<html>" + "copy " * 40
ROWS = [(3, "http://a/\r\nWARC-Type: metadata", SAME, 1), (1, "http://b/", SAME, 2), (1, "http://b/", SAME, 2), (2, None, None, 3), (4, "http://c/", "", 4), (5, "http://d/ü", "short", 5), (6, "http://e/", "short", 6), (None, "http://f/", SAME, 7), (7, "http://g/", LONG, 8), (8, "http://h/", LONG, 9), (None, "http://i/", "x" * 200, 10), (None, "http://j/", "x" * 200, 11), (9, "u", "y" * 99, 12), (10, "u", "y" * 99, 13), (11, "u", "z" * 100, 14), (12, "u", "z" * 100, 15)]
#: Names of columns that the operator itself uses.
SCHEMA = "page_id long, url string, html string, payload_digest int"


def by_hand(rows):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    out = []
    for page, body in payloads:
        ids = [p for p, b in payloads if b == body and p is not None]
        first = min(ids) if len(body) >= 100 and ids else None
        again = first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("parts, size", [(1, 1 << 20), (5, 300), (3, 1)])
def test_round_trip(spark, parts, size):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    assert read(warc.warc_round_trip(pages, archive_bytes=size)) == by_hand(ROWS)


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    assert read(warc.warc_round_trip(spark.createDataFrame(ROWS, SCHEMA))) == by_hand(ROWS)


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    raw = warc.write_archives(pages, f"{tmp_path}/raw", 1 << 20)
    assert raw.agg(F.sum("records")).first()[0] == len(ROWS)
    for r in raw.collect():
        one = zlib.decompressobj(31)
        with open(r.path, "rb") as f:
            one.decompress(f.read())
        assert one.eof and not one.unused_data  # one stream a file
    done = warc.normalise(raw, f"{tmp_path}/records")
    index = warc.read_index(spark, f"{tmp_path}/records")
    rows = index.collect()
    assert len(rows) == len(ROWS) + raw.count()  # and a warcinfo record for each archive
    for r in rows:
        with open(r.archive, "rb") as f:
            f.seek(r.offset)
            text = gzip.decompress(f.read(r.length))
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and r.record_id.encode() in text
    for r in done.collect():  # members fill the file
        mine = [x for x in rows if os.path.basename(x.archive) == os.path.basename(r.archive)]
        assert sum(x.length for x in mine) == os.path.getsize(r.archive)
    payloads = {r.page_id: r.payload for r in warc.read_pages(index, True).where("record_type = 'response'").collect()}
    assert payloads[7].decode() == LONG and payloads[5] == b"short" and payloads[2] == b""
    urls = {r.page_id: r.url for r in warc.read_pages(index).collect()}
    assert urls[3] == "http://a/%0D%0AWARC-Type: metadata" and urls[2] is None and urls[5] == "http://d/ü"
    again = warc.normalise(done.select(F.col("archive").alias("path")), f"{tmp_path}/again")  # many members, as well
    assert again.agg(F.sum("records")).first()[0] == len(rows)
    assert read(warc.read_pages(warc.read_index(spark, f"{tmp_path}/again"))) == by_hand(ROWS)


def stream(*blocks):
    return b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\nX: a\r\n  b\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)


def test_streams():
    blocks = [b"", b"a" * 200_000, b"\r\n\r\n" * 5, os.urandom(300_000)]
    raw = stream(*blocks)
    for data in (gzip.compress(raw), gzip.compress(raw[:77]) + gzip.compress(raw[77:]), gzip.compress(raw) + b"\0" * 10):
        got = [(f["x"], b"".join(b)) for _, f, b in warc.records_of(pa.BufferReader(data))]
        assert got == [("a b", b) for b in blocks]
    assert list(warc.records_of(io.BytesIO(b""))) == []
    for bad in (gzip.compress(raw)[:-9], gzip.compress(raw[:-7]), gzip.compress(raw[:30]), gzip.compress(b"no archive\r\n\r\n")):
        with pytest.raises(ValueError):
            for _, _, block in warc.records_of(pa.BufferReader(bad)):
                b"".join(block)


def test_damaged_payload(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:2], SCHEMA).coalesce(1)
    made = warc.write_archives(pages, f"{tmp_path}/raw").first().path
    with open(made, "rb") as f:
        raw = gzip.decompress(f.read())
    with open(made, "wb") as f:
        f.write(gzip.compress(raw.replace(b"copy copy", b"copy Copy")))
    warc.normalise(spark.createDataFrame([(made,)], "path string"), f"{tmp_path}/records")
    with pytest.raises(Exception, match="has the digest"):
        warc.read_pages(warc.read_index(spark, f"{tmp_path}/records")).collect()
