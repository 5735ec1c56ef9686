import hashlib
import io
import struct
import zipfile
import zlib

from conftest_llm import documents
from tidewire.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    return {
        "image/png": png(),
        "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd123\xff\x00\xff\xd9",
        "image/gif": b"GIF89a\1\0\1\0\0\0\0\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0",
        "audio/wav": media.wav(b"ab" * 9),
        "application/zip": packed.getvalue(),
        "application/ogg": b"OggS\0\6" + b"\0" * 20 + b"\1\3abc",
        "application/pdf": b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF",
        "video/mp4": struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"moovabcd",
    }


def test_types_are_corrected_and_media_carved(spark):
    found = samples()
    rows = [(i, "text/plain", b) for i, b in enumerate(found.values())]
    rows += [(100, "x/y", b"junk BM PK\x03\x04 \xff\xd8\xff GIF8"), (101, "x/y", None), (102, None, b""), (103, "x/y", b"..." + found["image/png"] + b"--" + found["image/gif"] + b".")]
    rows += [(104, "image/png", found["image/png"][:-1]), (105, "x/y", found["audio/wav"][:20])]
    out = media.corrected(spark.createDataFrame(rows, "media_id long, declared_type string, content binary")).collect()
    by = {}
    for r in out:
        by.setdefault(r.media_id, []).append((r.media_type, r.offset, bytes(r.content)))
    for i, (kind, content) in enumerate(found.items()):
        assert by[i] == [(kind, 0, content)]
    assert by[100] == [("x/y", 0, rows[9][2])] and by[101] == [("x/y", 0, b"")] and by[102] == [(None, 0, b"")]
    assert by[103] == [("image/png", 3, found["image/png"]), ("image/gif", 5 + len(found["image/png"]), found["image/gif"])]
    assert by[104][0][0] == "image/png" and by[105][0][0] == "x/y"


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "RIFF BM WAVE PK\x03\x04 %PDF-1", "z" * 300_000, "a"]
    rows = {r.doc_id: r for r in media.media_report(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(media.wav(payload)).hexdigest())
    assert rows[2].feature == rows[8].feature
    assert media.media_report(documents(spark, ["a"]).limit(0)).count() == 0


def test_whole_pdf_and_mp4():
    import struct

    first = b"%PDF-1.7\n1 0 obj\n<<>>\nendobj\nstartxref\n9\n%%EOF\n"
    update = b"2 0 obj\n<<>>\nendobj\nxref\ntrailer\nstartxref\n60\n%%EOF"
    assert media.whole_pdf(b"xx" + first + update + b"\nrest", 2) == len(first + update)  # an updated or linearised file
    assert media.whole_pdf(first + b"no section %%EOF", 0) == len(first) - 1
    assert media.whole_pdf(first + first + update, 0) == len(first) - 1  # the next file is its own
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 40) + b"m" * 40
    head = box(b"ftyp", b"isom0000")
    assert media.whole_mp4(head + large + b"tail????", 0) == len(head + large)
    assert media.whole_mp4(head + struct.pack(">I4s", 0, b"mdat") + b"x" * 50, 0) == len(head) + 58
    assert media.whole_mp4(head + struct.pack(">I4sQ", 1, b"mdat", 3), 0) == 0
