"""WARC archives compressed with Zstandard and a dictionary: writer, reader, and revisits of equal payloads.

An archive (``.warc.zst``) starts with a skippable frame that holds the dictionary; then comes one Zstandard frame per record, so
any record can be decoded from its offset with the dictionary alone.

``write(pages)`` writes each page as a record. Of equal payloads of at least ``LEAST_REVISIT`` bytes, the largest page_id is a
``response`` with the payload, the others are ``revisit`` records that name it and hold no payload; smaller ones are all responses.
Digests travel without texts to find repeated payloads. Those that hold most rows, ``HOT`` of them at most, are broadcast,
so a payload that a third of the pages share is resolved where its rows are; the rest is an equality join that moves each page once.
Every task writes archives of its own below the cluster's shared folder, closed at ``ROLL`` bytes, under names never used twice, and returns a row
per archive; a task that is run again writes new archives, and only those in the manifest count.

``read(archives)`` decodes frame by frame, holding one record at a time, and checks version line, named fields, lengths, the blank lines
that end a record, and the payload digest. What does not fit ends in an error that names archive and offset. The record's page_id is the end of its
WARC-Record-ID. Archives are opened by ``pyarrow.fs``, which takes local and mounted folders as well as HDFS and object stores.

The dictionary is trained from ``SAMPLE`` pages by hash of id and URL, ``SAMPLE_CHARS`` characters of each; other rows only compress less well.

Rows: a null html is an empty payload, a null url, or one with control characters, is written as a URI of its own and read back as it was. A null page_id counts as smaller than any;
rows of the largest id and equal payload given twice are all responses. Very long pages are one record and one frame. An empty table gives no archives and
no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideglass.llm.common import written
from tideglass.session import new_path

LEAST_REVISIT = 1000
#: Payloads resolved by broadcast, pages and characters the dictionary is trained from, its size, bytes of an archive, bytes read at once.
HOT, SAMPLE, SAMPLE_CHARS, DICTIONARY, ROLL, CHUNK = 1000, 256, 16_384, 32_768, 128 << 20, 1 << 20
LEVEL = 3

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("response", "revisit")
#: Target URIs of pages without a URL and of URLs that a header line cannot hold as they are; record ids of pages.
NO_URL, ESCAPED_URL, RECORD = "urn:x-url:none", "urn:x-url:escaped:", "urn:x-page:"

MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"
_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


class BadArchive(ValueError):
    """An archive that does not keep to the format."""


def digest_field(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_uri(page_id: int | None) -> str:
    return f"<{RECORD}{'none' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    if not uri.startswith(f"<{RECORD}") or not uri.endswith(">"):
        raise BadArchive(f"unknown record id {uri}")
    name = uri[len(RECORD) + 1 : -1]
    return None if name == "none" else int(name)


def target(url: str | None) -> str:
    """The URL as it is, unless it holds control characters, ends in white space or reads like one of ours."""
    if url is None:
        return NO_URL
    plain = url == url.strip(" \t") and not any(ord(c) < 32 or ord(c) == 127 for c in url) and not url.startswith("urn:x-url:")
    return url if plain else ESCAPED_URL + quote(url, safe="")


def url_of(uri: str) -> str | None:
    if uri == NO_URL:
        return None
    return unquote(uri[len(ESCAPED_URL) :]) if uri.startswith(ESCAPED_URL) else uri


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record; with ``refers_to`` a revisit, whose block ends before the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", TYPES[refers_to is not None]), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", digest_field(hashlib.sha1(payload).digest())), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", SAME_PAYLOAD)]
    else:
        block += payload
    fields.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes, first: bytes) -> dict[str, str]:
    """Named fields below a first line, by name in lower case."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(first):
        raise BadArchive(f"first line is {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a named field: {line[:40]!r}")
        out[name.decode().lower()] = value.strip(b" \t").decode()
    return out


def _length(fields: dict[str, str]) -> int:
    text = fields.get("content-length", "")
    if not text.isascii() or not text.isdigit():
        raise BadArchive(f"Content-Length is {text!r}")
    return int(text)


def parsed(data: bytes) -> tuple:
    """A whole decoded frame as a row of RECORDS; raises BadArchive where lengths, fields or the digest do not fit."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise BadArchive("no end of the header")
    fields = _fields(head, VERSION)
    if head.split(b"\r\n", 1)[0] != VERSION:
        raise BadArchive("another version")
    size = _length(fields)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"block of {size} bytes expected, {len(rest) - 4} found")
    missing = [f for f in ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest") if f not in fields]
    if missing or fields["warc-type"] not in TYPES:
        raise BadArchive(f"missing {missing}, type {fields.get('warc-type')}")
    http, blank, payload = rest[:size].partition(b"\r\n\r\n")
    if not blank:
        raise BadArchive("no end of the HTTP header")
    n, wanted = _length(_fields(http, b"HTTP/1.1 ")), fields["warc-payload-digest"]
    revisit = fields["warc-type"] == "revisit"
    if revisit:
        if payload or fields.get("warc-profile") != SAME_PAYLOAD or "warc-refers-to" not in fields:
            raise BadArchive("a revisit with a payload, of another profile or without a target")
    elif len(payload) != n or digest_field(hashlib.sha1(payload).digest()) != wanted:
        raise BadArchive("payload and its length or digest differ")
    if not wanted.startswith("sha1:"):
        raise BadArchive(f"digest {wanted[:12]}")
    return (
        page_of(fields["warc-record-id"]), url_of(fields["warc-target-uri"]), fields["warc-type"], page_of(fields["warc-refers-to"]) if revisit else None,
        base64.b32decode(wanted[5:]).hex(), n, None if revisit else payload,
    )


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame of an archive; the dictionary comes from the skippable frame it starts with."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise BadArchive("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    held = stream.read(size)
    if len(held) != size:
        raise BadArchive("dictionary frame cut short")
    if held[:4] == ZSTD_FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    at, left = 8 + size, b""
    while left or (left := stream.read(CHUNK)):
        frame, parts, used = decoder.decompressobj(), [], 0
        while True:
            try:
                parts.append(frame.decompress(left))
            except zstandard.ZstdError as e:
                raise BadArchive(f"offset {at}: {e}") from e
            used += len(left) - len(frame.unused_data)
            if frame.eof:
                left = frame.unused_data
                break
            left = stream.read(CHUNK)
            if not left:
                raise BadArchive(f"offset {at}: last frame cut short")
        yield at, b"".join(parts)
        at += used


def dictionary(pages: DataFrame, column: str = "html") -> bytes:
    """A dictionary from a bounded sample; where too little can be sampled, the texts themselves are the content."""
    # About twice the sample passes by hash wherever it lies, so tasks send few rows however many there are.
    share = min(1.0, 2 * SAMPLE / max(1, pages.count()))
    place = F.pmod(F.xxhash64("page_id", "url"), F.lit(2**31))
    chosen = pages.filter((place < int(share * 2**31)) & (F.length(column) > 0)).select(place.alias("h"), F.substring(column, 1, SAMPLE_CHARS).alias("t"))
    texts = [record(0, None, r.t.encode(), None, "2000-01-01T00:00:00Z") for r in chosen.orderBy("h", "t").limit(SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:] or record(0, None, b"", None, "2000-01-01T00:00:00Z")


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): the pages with the response that a revisit refers to, null for responses."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    large = F.octet_length("html") >= LEAST_REVISIT
    rows = rows.withColumn("digest", F.when(large, F.sha1(F.col("html").cast("binary"))))
    repeated = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND top IS NOT NULL")
    repeated = written(repeated, "payloads")
    hot = written(repeated.orderBy(F.desc("n"), "digest").limit(HOT), "hot-payloads")
    rest = repeated.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(F.col("digest").alias("rest_digest"), F.col("top").alias("rest_top"))
    rows = rows.join(F.broadcast(hot.select("digest", F.col("top").alias("hot_top"))), "digest", "left")
    # Rows that need no partner get keys that match nothing, spread by page, so they do not meet in one task.
    alone = F.col("digest").isNull() | F.col("hot_top").isNotNull()
    rows = rows.withColumn("_key", F.when(alone, F.concat(F.lit("~"), F.xxhash64("page_id", "url"))).otherwise(F.col("digest")))
    rows = rows.join(rest, F.col("_key") == F.col("rest_digest"), "left").withColumn("top", F.coalesce("hot_top", "rest_top"))
    older = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    return rows.select("page_id", "url", "html", F.when(older, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns the manifest (path, bytes, records)."""
    folder = new_path(pages.sparkSession, "warc")
    held = dictionary(pages)

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True, write_content_size=True)
        name = stream = None
        n = 0

        def closed() -> pa.RecordBatch:
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "bytes": size, "records": n}], schema=_MANIFEST)

        for batch in batches:
            for row in range(len(batch)):
                if stream is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    stream = where.open_output_stream(f"{root}/{name}", compression=None)
                    stream.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
                page_id, url, html, refers_to = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "refers_to"))
                stream.write(encoder.compress(record(page_id, url, html.encode(), refers_to, date)))
                n += 1
                if stream.tell() >= roll:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return written(responses(pages).mapInArrow(archived, MANIFEST), "warc-manifest")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives, given by a column ``path``; archives of a manifest must hold as many records as it says.

    Without ``payloads`` records are checked all the same, but their bytes are not returned.
    """
    counted = F.col("records") if "records" in archives.columns else F.lit(None).cast("bigint")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                rows, held, n = [], 0, 0
                with where.open_input_stream(name, compression=None) as stream:
                    try:
                        for at, data in frames(stream):
                            try:
                                row = parsed(data)
                            except ValueError as e:
                                raise BadArchive(f"offset {at}: {e}") from e
                            n += 1
                            held += len(data) if payloads else 256
                            rows.append(row if payloads else (*row[:-1], None))
                            if held >= CHUNK:
                                yield _batch(rows)
                                rows, held = [], 0
                    except BadArchive as e:
                        raise BadArchive(f"{path}: {e}") from e
                if wanted is not None and n != wanted:
                    raise BadArchive(f"{path}: {n} records, {wanted} expected")
                if rows:
                    yield _batch(rows)

    paths = archives.select("path", counted.alias("records"))
    return paths.mapInArrow(decoded, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORDS.types)], schema=_RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write(pages)
    files = max(1, archives.count())
    found = read(archives.repartition(files), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
