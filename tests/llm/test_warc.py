import base64
import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from meltframe.llm import warc as W

PAGES = "page_id long, url string, html string, bytes string, sha int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "mine", 1) for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://x y\n\r\nWARC/1.1", "<p>ü中\r\n\r\n</p>"),
    (6, "http://e/", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (None, "http://n/", "<p>null</p>"), (None, "http://n/", "<p>one</p>"), (7, "u", "<p>rep</p>"),
    (7, "u", "<p>rep</p>"), (9, "u", "<p>rep</p>"), (10, "long", "x" * 3_000_000), (11, "long", "ab" * 40_000),
]


def expected(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= min_bytes:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        keep = first.get(body)
        again = keep is not None and i != keep
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", keep if again else None))
    return sorted(out, key=str)


def through(spark, rows, tmp_path, **options):
    whole, members = f"{tmp_path}/whole", f"{tmp_path}/members"
    W.write_monolithic(pages_of(spark, rows).coalesce(2), whole, **options)
    W.normalise(spark, whole, members)
    return whole, members


def read(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def files(path, end=""):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-") and f.endswith(end)]


def test_pages_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "CLASS_BYTES", (10, 20, 100_000))  # several archives, of several classes
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 30)
    whole, members = through(spark, ROWS, tmp_path)
    assert read(W.read_archive(spark, members)) == expected(ROWS)
    texts = {r["payload"].decode() for r in W.read_archive(spark, members).where("record_type = 'response'").collect()}
    assert texts == {h or "" for _, _, h in ROWS}
    # each monolithic file is one gzip member
    for file in files(whole):
        stream = zlib.decompressobj(31)
        stream.decompress(open(file, "rb").read())
        assert stream.eof and not stream.unused_data
    # the members of an archive tile its file, and any reader of gzip gets all records
    for entry in W.read_index(spark, members).groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("e")).collect():
        file, = [f for f in files(f"{members}/kind=0") if f"part-{entry['archive']:05d}-" in f]
        content = open(file, "rb").read()
        at = 0
        for offset, length in entry["e"]:
            assert offset == at and gzip.decompress(content[offset:offset + length]).startswith(b"WARC/1.1\r\n")
            at += length
        assert at == len(content) and gzip.decompress(content).count(b"WARC-Record-ID") == len(entry["e"])


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """1,500 files from one task: all numbers differ and every record is found where the index says."""
    monkeypatch.setattr(W, "CLASS_BYTES", (40, 80, 160))
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 160)
    rows = [(i, "u", "x" * (i % 7 * 33)) for i in range(3_000)]
    whole, members = f"{tmp_path}/whole", f"{tmp_path}/members"
    W.write_monolithic(pages_of(spark, rows).coalesce(1), whole)
    sizes = [len(b"".join(W.inflate(open(f, "rb").read()))) for f in files(whole)]
    assert len(sizes) > 1_000 and max(sizes) < 160 + 4 * 600
    W.normalise(spark, whole, members)
    place = ["archive", "offset", "length"]
    joined = W.read_archive(spark, members).join(W.read_index(spark, members), place)
    assert joined.count() == 3_000 and read(W.read_archive(spark, members)) == expected(rows)


def test_bytes_that_are_no_text_pass_the_writer(spark, tmp_path):
    odd = [bytes([b]) * 3 + b"\xff\xfe\xc0\x80" + bytes(range(1, 256)) for b in range(1, 256)]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(odd)], "i int, value binary").coalesce(1).sortWithinPartitions("i")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").text(f"{tmp_path}/t")
    assert b"".join(open(f, "rb").read() for f in files(f"{tmp_path}/t")) == b"".join(b + b"\0" for b in odd)


def test_single_records_are_read_by_offset(spark, tmp_path):
    _, members = through(spark, ROWS, tmp_path)
    wanted = W.read_index(spark, members).where("id in ('<urn:page:5>', '<urn:page:2>')")
    got = {r["page_id"]: r for r in W.read_archive(spark, members, wanted).collect()}
    assert set(got) == {2, 5} and got[5]["payload"].decode() == ROWS[4][2] and got[2]["refers_to"] == 1
    assert got[5]["uri"] == "http://x%20y%0A%0D%0AWARC/1.1".replace("%0A", "%20").replace("%0D", "%20")


def test_small_payloads_stay_responses(spark, tmp_path):
    _, members = through(spark, ROWS, tmp_path, min_bytes=10**6)
    assert {r[3] for r in read(W.read_archive(spark, members))} == {"response"}


def test_empty_table(spark, tmp_path):
    whole = f"{tmp_path}/whole"
    W.write_monolithic(pages_of(spark, []), whole)
    assert not files(whole) or all(not b"".join(W.inflate(open(f, "rb").read())) for f in files(whole))
    W.normalise(spark, whole, f"{tmp_path}/members")
    assert W.read_archive(spark, f"{tmp_path}/members").count() == 0 and W.read_index(spark, f"{tmp_path}/members").count() == 0


def test_large_records_get_an_empty_member():
    record = b"r" * (1 << 24)
    member = W._member(record, 1)
    assert member[-1] == 0 and member.endswith(W.EMPTY_MEMBER) and gzip.decompress(member) == record
    assert not W._member(b"small", 6).endswith(W.EMPTY_MEMBER)


def test_broken_archives_are_errors():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r for _, r in W.split_records(iter([good[:7], good[7:] + good]))] == [good, good]
    for bad in (good[:-5], good[:12], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.split_records(iter([bad])))
    with pytest.raises(ValueError):
        list(W.inflate(gzip.compress(b"x" * 1000)[:-9]))
    assert b"".join(W.inflate(gzip.compress(b"a") + b"\0\0" + gzip.compress(b"b"))) == b"ab"
