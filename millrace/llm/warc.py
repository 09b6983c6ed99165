"""Dictionary-compressed WARC archives (.warc.zst).

Each archive begins with a skippable frame that holds its Zstandard dictionary,
trained on the archive's own records; then every record is a frame of its
own, compressed with the dictionary, so that a record can be read by offset and length. The first
record is a warcinfo; the pages' WARC-Date, which no table has, is the time of the call unless it is given.
Archives are cut from the partitions of the input as they are read, at
ARCHIVE_BYTES of records: nothing is shuffled, and no task holds more than one archive.

Defined results: a null url is written as urn:page:<page_id> (urn:page:unknown where
that is null too), characters that a URI can't hold are percent-encoded as UTF-8, a null html is an empty body; repeated rows are archived each, and have
the same WARC-Record-ID; an empty table makes no archive. Where
there is too little to train on, the dictionary is the first records' raw content. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import lean

MAGIC = 0x184D2A5D
ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 48 << 20, 112_640, 9
_URI = "!#$%&'()*+,/:;=?@[]~"
_KINDS = [("archive", pa.string()), ("record", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("raw_length", pa.int64()), ("frame", pa.binary())]
FRAMES = "archive string, record int, page_id bigint, url string, offset bigint, length bigint, raw_length bigint, frame binary"


def _block(kind: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(content)}", "", ""]
    return "\r\n".join(lines).encode() + content + b"\r\n\r\n"


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def information(archive: str, date: str) -> bytes:
    """The warcinfo record of an archive."""
    content = "\r\n".join(["software: millrace", "format: WARC File Format 1.1", "conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/", "", ""]).encode()
    return _block("warcinfo", [("WARC-Date", date), ("WARC-Filename", archive), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {date}')}>"), ("Content-Type", "application/warc-fields")], content)


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A response record of a page."""
    body = (html or "").encode("utf-8", "replace")
    target = quote("".join(c for c in url if c > " "), safe=_URI, errors="replace") if url else f"urn:page:{'unknown' if page_id is None else page_id}"
    head = ("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", "")
    http = "\r\n".join(head).encode() + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target} {digest}")
    return _block("response", [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")], http)


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained on all records."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 20)), records, k=1024, d=8, level=LEVEL)
    except zstandard.ZstdError:
        raw, left = [], size
        for r in records:
            raw.append(r[:left])
            left -= len(raw[-1])
            if left <= 0:
                break
        return zstandard.ZstdCompressionDict(b"".join(raw), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: list[bytes], level: int = LEVEL, size: int = DICTIONARY_BYTES) -> list[bytes]:
    """The leading skippable frame, then a frame a record."""
    made = dictionary(records, size)
    content = made.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=True, write_checksum=True)
    return [struct.pack("<II", MAGIC, len(content)) + content, *map(packer.compress, records)]


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    reader = _unpacker(data[8 : 8 + size])
    rest = memoryview(data)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        yield one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]


def _unpacker(content: bytes) -> zstandard.ZstdDecompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))


def read_record(head: bytes, frame: bytes) -> bytes:
    """One record from its frame and the archive's leading frame."""
    return _unpacker(head[8:]).decompress(frame)


def archive_frames(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str | None = None) -> DataFrame:
    """archive, record, page_id, url, offset, length, raw_length, frame: the frames of all archives in order; record -1 is the dictionary's.

    The frames of an archive, joined in the order of record, are its file; record 0 is its warcinfo, of no page.
    """
    date = date or now()

    def close(name: str, keys: list[tuple], records: list[bytes]) -> Iterator[pa.RecordBatch]:
        records = [information(name, date), *records]
        made = frames(records, level)
        rows, offset = [], 0
        for k, (key, raw, frame) in enumerate(zip([(None, None), (None, None), *keys], [0, *map(len, records)], made), -1):
            rows.append((name, k, *key, offset, len(frame), raw, frame))
            offset += len(frame)
            if len(rows) == 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, total = TaskContext.get().partitionId(), 0, 0
        keys: list[tuple] = []
        records: list[bytes] = []
        for batch in batches:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                keys.append((i, url))
                records.append(record(i, url, html, date))
                total += len(records[-1])
                if total >= archive_bytes:
                    yield from close(f"{part:06d}-{n:04d}.warc.zst", keys, records)
                    keys, records, total, n = [], [], 0, n + 1
        if records:
            yield from close(f"{part:06d}-{n:04d}.warc.zst", keys, records)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(lean(run), FRAMES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _KINDS)], names=[n for n, _ in _KINDS])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, date: str | None = None) -> DataFrame:
    """Writes the archives into a folder that all executors share; archive, records, bytes of each.

    A file appears under its name only when it is whole, so a task that is run again
    replaces it by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        attempt = TaskContext.get().taskAttemptId()
        name, file, records, size = None, None, 0, 0
        done: list[tuple] = []

        def close() -> None:
            file.close()
            os.replace(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            done.append((name, records, size))

        for batch in batches:
            for archive, frame in zip(batch.column(0).to_pylist(), batch.column(7).to_pylist()):
                if archive != name:
                    if file:
                        close()
                    name, records, size = archive, -1, 0
                    file = open(f"{folder}/.{name}.{attempt}", "wb")
                file.write(frame)
                records, size = records + 1, size + len(frame)
        if file:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["archive", "records", "bytes"])

    return archive_frames(pages, archive_bytes, level, date).mapInArrow(lean(run), "archive string, records bigint, bytes bigint")
