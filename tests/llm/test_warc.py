"""WARC archives: exact round trip, revisits against a plain rule, and archives that must be refused."""

import hashlib
import io
import random
import struct

import pytest
import zstandard
from pyspark.errors import PythonException

from tideglass.llm import warc

SCHEMA = "page_id bigint, url string, html string"
DATE = "2001-02-03T04:05:06Z"


def pages(spark, rows, extra=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["digest", "top", "_key", "refers_to", "path", "records", "n"])]) if extra else df


def plain(rows):
    tops = {}
    for i, _, html in rows:
        if i is not None:
            tops[html or ""] = max(i, tops.get(html or "", i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        top = tops.get(html or "") if len(payload) >= 1000 else None
        older = top is not None and (i is None or i < top)
        out.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if older else "response", top if older else None))
    return sorted(out, key=str)


def html(n, seed):
    rng = random.Random(seed)
    return "<html>" + " ".join(f"<p>é{rng.randrange(99)}</p>" for _ in range(n)) + "</html>"


ROWS = (
    [(i, f"http://a/{i}", html(i % 40, i)) for i in range(120)]
    + [(200 + i, "http://hot/", html(300, 1)) for i in range(150)] + [(400 + i, None, html(200, 2)) for i in range(5)]
    + [(500, "http://x/ü?q=1 2%20\r\nBad: 1", None), (501, None, ""), (502, "", "x" * 999), (503, "", "x" * 999), (504, "u", "y" * 1000), (505, "u", "y" * 1000), (505, "u", "y" * 1000)]
    + [(None, None, None), (None, "n", "y" * 1000), (None, "m", "z" * 1500), (None, "m", "z" * 1500), (600, "long", "<p>" + "word " * 400_000), (601, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 200)]
)


def test_round_trip_equals_the_rule(spark):
    got = warc.round_trip(pages(spark, ROWS, extra=True).repartition(5))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ROWS)


def test_payloads_beyond_the_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 1)
    assert sorted((tuple(r) for r in warc.round_trip(pages(spark, ROWS)).collect()), key=str) == plain(ROWS)


def test_payloads_and_urls_come_back_whole(spark):
    manifest = warc.write(pages(spark, ROWS).repartition(3), DATE, roll=2000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    found = warc.read(manifest).filter("record_type = 'response'").collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in found} <= {(i, u, h or "") for i, u, h in ROWS}
    assert {r.url for r in found} >= {"http://x/ü?q=1 2%20\r\nBad: 1", None, "", "http://a/1"}


@pytest.mark.parametrize("url", [None, "", "http://a/b%20c?d=é", " x", "a\tb", "urn:x-url:none", "urn:x-url:escaped:%20", "a\x85b", "a\u2028"])
def test_urls_read_back(url):
    assert warc.url_of(warc.target(url)) == url
    assert warc.parsed(warc.record(1, url, b"", None, DATE))[1] == url


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def archive(*records, content=b"dictionary of nothing", head=True):
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content))
    return (struct.pack("<II", warc.SKIPPABLE, len(content)) + content if head else b"") + b"".join(encoder.compress(r) for r in records)


def test_frames_and_dictionary():
    records = [warc.record(i, f"u{i}", b"p" * i * 100, None, DATE) for i in range(50)]
    data = archive(*records)
    found = list(warc.frames(io.BytesIO(data)))
    assert [c for _, c in found] == records
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(b"dictionary of nothing"))
    for (at, content), (end, _) in zip(found, found[1:] + [(len(data), b"")]):
        assert whole.decompress(data[at:end]) == content  # one frame per record, each decodes alone
    packed = zstandard.compress(b"dictionary of nothing")
    squeezed = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + len(b"dictionary of nothing") :]
    assert [c for _, c in warc.frames(io.BytesIO(squeezed))] == records


@pytest.mark.parametrize("data", [b"", b"\x5d\x2a\x4d\x18", archive(head=False), archive(b"x" * 500)[:-3], archive(b"x") + b"rubbish", struct.pack("<II", warc.SKIPPABLE, 100) + b"short"])
def test_broken_frames_are_refused(data):
    with pytest.raises(warc.BadArchive):
        list(warc.frames(io.BytesIO(data)))


GOOD = warc.record(7, "u", b"payload", None, DATE)
REVISIT = warc.record(6, "u", b"payload", 7, DATE)


def test_records_read_back():
    assert warc.parsed(GOOD) == (7, "u", "response", None, hashlib.sha1(b"payload").hexdigest(), 7, b"payload")
    assert warc.parsed(REVISIT) == (6, "u", "revisit", 7, hashlib.sha1(b"payload").hexdigest(), 7, None)


@pytest.mark.parametrize(
    "data",
    [
        GOOD[:-1], GOOD + b"x", GOOD.replace(b"WARC/1.1", b"WARC/9.9"), GOOD.replace(b"payload\r\n", b"paylord\r\n"), GOOD.replace(b"WARC-Date", b"WARC-Dote"),
        GOOD.replace(b"Type: response", b"Type: metadata"), GOOD.replace(b"Content-Length: 7", b"Content-Length: 8"), GOOD.replace(b"Content-Length: 7", b"Content-Length: -"),
        REVISIT.replace(b"WARC-Profile", b"WARC-Other"), REVISIT.replace(b"identical-payload-digest", b"server-not-modified"), b"no header at all", GOOD.replace(b"WARC-Type:", b"WARC-Type"),
    ],
)
def test_broken_records_are_refused(data):
    with pytest.raises(warc.BadArchive):
        warc.parsed(data)


def test_reader_names_archive_and_counts_records(spark, tmp_path):
    path = str(tmp_path / "a.warc.zst")
    (tmp_path / "a.warc.zst").write_bytes(archive(GOOD, REVISIT))
    assert warc.read(spark.createDataFrame([(path,)], "path string")).count() == 2
    with pytest.raises(PythonException, match="2 records, 3 expected"):
        warc.read(spark.createDataFrame([(path, 3)], "path string, records bigint")).collect()
    (tmp_path / "a.warc.zst").write_bytes(archive(GOOD, REVISIT[:-1]))
    with pytest.raises(PythonException, match="a.warc.zst: offset"):
        warc.read(spark.createDataFrame([(path,)], "path string")).collect()
