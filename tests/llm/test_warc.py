import random

from millrace.llm import warc as W


def test_archive_round_trip(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, f"http://x.org/{i}", "<html>" + " ".join(r.choice(["alpha", "beta", "gamma", "é"]) for _ in range(200)) + "</html>") for i in range(300)]
    rows += [(None, None, None), (500, "", ""), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, frame string").coalesce(2)
    date = "2024-05-01T00:00:00Z"
    frames = W.archive_frames(df, archive_bytes=150_000, date=date).collect()
    by = {}
    for f in frames:
        by.setdefault(f.archive, []).append(f)
    assert len(by) >= 3
    got = []
    for name, parts in by.items():
        parts.sort(key=lambda f: f.record)
        whole = b"".join(f.frame for f in parts)
        records = list(W.read_archive(whole))
        assert len(records) == len(parts) - 1 and parts[0].record == -1
        assert records[0] == W.information(name, date) and parts[1].page_id is None
        for f, rec in zip(parts[1:], records):
            assert whole[f.offset : f.offset + f.length] == f.frame and len(rec) == f.raw_length
            assert W.read_record(parts[0].frame, f.frame) == rec
            got += [rec] if f.record else []
    assert sorted(got) == sorted(W.record(*x, date) for x in rows)
    written = W.write_archives(df, str(tmp_path), archive_bytes=150_000, date=date).collect()
    assert {w.archive for w in written} == set(by) and sum(w.records for w in written) == len(rows) + len(by)
    for name, parts in by.items():
        assert (tmp_path / name).read_bytes() == b"".join(f.frame for f in parts)
    assert len({rec.split(b"WARC-Record-ID: ")[1][:60] for rec in got}) == len(rows) - 1


def test_dictionary_helps_and_little_data(spark):
    pages = [W.record(i, f"http://x.org/{i}", f"<html><body class=main><p>page {i} of the site</p></body></html>", W.now()) for i in range(2000)]
    import zstandard

    alone = sum(len(zstandard.ZstdCompressor(level=W.LEVEL).compress(p)) for p in pages)
    assert sum(map(len, W.frames(pages)[1:])) < 0.7 * alone
    assert list(W.read_archive(b"".join(W.frames(pages[:1])))) == pages[:1]
    assert W.archive_frames(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_page():
    page = W.record(1, "http://x.org/", "<p>long</p>" * 500_000, W.now())
    assert list(W.read_archive(b"".join(W.frames([page, page])))) == [page, page]


def test_headers():
    raw = W.record(1, "http://x.org/ä b\n?q=%20", "é", W.now())
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert b"http://x.org/%C3%A4b?q=%20\r\n" in head
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x.org/")
    size = int(head.rsplit(b"Content-Length: ", 1)[1])
    assert rest[size:] == b"\r\n\r\n" and rest[:size].endswith("é".encode())


def test_archive_read_by_the_formats_alone(spark, tmp_path):
    """Frames by zstandard's own reading, records by their headers: nothing of the writer is used."""
    import email.parser
    import hashlib
    import struct
    from base64 import b32decode

    import zstandard

    pages = [(i, f"http://x.org/{i}?q=ü", f"<p>page {i} {'text ' * (i % 50)}</p>") for i in range(200)]
    W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path))
    W.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), str(tmp_path)).collect()
    (path,) = [p for p in tmp_path.iterdir() if p.suffix == ".zst"]
    data = path.read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    known, rest, seen = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :], []
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        raw = one.decompress(rest)
        assert zstandard.get_frame_parameters(rest).has_checksum and zstandard.get_frame_parameters(rest).dict_id == known.dict_id()
        rest = one.unused_data
        version, _, more = raw.partition(b"\r\n")
        head, _, content = more.partition(b"\r\n\r\n")
        fields = email.parser.Parser().parsestr(head.decode("ascii"), headersonly=True)
        n = int(fields["Content-Length"])
        assert version == b"WARC/1.1" and content[n:] == b"\r\n\r\n"
        seen.append((fields, content[:n]))
    assert seen[0][0]["WARC-Type"] == "warcinfo" and seen[0][0]["WARC-Filename"] == path.name
    for (fields, content), (i, _, html) in zip(seen[1:], pages, strict=True):
        http, _, body = content.partition(b"\r\n\r\n")
        assert fields["WARC-Target-URI"] == f"http://x.org/{i}?q=%C3%BC" and body.decode() == html and http.startswith(b"HTTP/1.1 200")
        assert b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")) == hashlib.sha1(body).digest()
    assert len({f["WARC-Record-ID"] for f, _ in seen}) == 201
