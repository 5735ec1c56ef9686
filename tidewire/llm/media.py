"""Media columns: signature sniffing with Aho-Corasick, format validators and carving."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import chunks, text_bytes

#: Bytes by which a format begins, after so many bytes.
SIGNATURES = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "audio/wav": (b"WAVE", 8),
    "image/webp": (b"WEBP", 8),
    "video/x-msvideo": (b"AVI ", 8),
    "application/zip": (b"PK\x03\x04", 0),
    "application/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "video/mp4": (b"ftyp", 4),
}
#: Payloads are padded with PAD to a positive multiple of FRAME bytes.
FRAME, PAD = 576, b"\xff"
RATE = 8000


class Found(NamedTuple):
    media_type: str
    offset: int
    length: int


def whole_png(b: bytes, at: int) -> int:
    """Bytes of the PNG file at a place, 0 if it isn't one: chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def whole_jpeg(b: bytes, at: int) -> int:
    """Marker segments up to the scan, then entropy-coded bytes up to the end marker."""
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        marker, size = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2 or marker < 0xC0:
            return 0
        pos += 2 + size
        if marker == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return pos + 2 - at
                if b[pos + 1] != 0 and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                return 0
    return 0


def whole_gif(b: bytes, at: int) -> int:
    """Header, colour tables, blocks of chained sub-blocks, trailer."""
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    pos = at + 13 + table(b[at + 10])
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            pos += 11 + table(b[pos + 9])
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return 0


def whole_bmp(b: bytes, at: int) -> int:
    """The header's file size holds the header, the palette offset and rows of the stated width, depth and height."""
    if at + 54 > len(b):
        return 0
    size, reserved, start, header, width, height, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if reserved or planes != 1 or header < 40 or depth not in (1, 4, 8, 16, 24, 32) or packed or width <= 0:
        return 0
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    return size if start + rows <= size <= len(b) - at and start >= 14 + header else 0


def whole_riff(b: bytes, at: int) -> int:
    """RIFF with chunks that end where the file's stated size does."""
    if at < 0 or b[at : at + 4] != b"RIFF":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    pos = at + 12
    while pos + 8 <= end:
        size = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + size + size % 2
    return end - at if pos == end else 0


def whole_zip(b: bytes, at: int) -> int:
    """Up to an end record whose directory's place and size agree with where it stands."""
    pos = at
    while (pos := b.find(b"PK\x05\x06", pos)) >= 0 and pos + 22 <= len(b):
        size, start, note = struct.unpack_from("<IIH", b, pos + 12)
        if at + start + size == pos and pos + 22 + note <= len(b):
            return pos + 22 + note - at
        pos += 4
    return 0


def whole_ogg(b: bytes, at: int) -> int:
    """Pages from the first of a stream to its last."""
    pos = at
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        if pos == at and not b[pos + 5] & 2:
            return 0
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b):
            return 0
        if b[pos + 5] & 4:
            return end - at
        pos = end
    return 0


#: What begins a further section of a PDF file behind an end mark: an object, a cross-reference table, a trailer.
PDF_SECTION = re.compile(rb"[\x00\t\n\f\r ]*(?:[0-9]+[\t\n\f\r ]+[0-9]+[\t\n\f\r ]+obj\b|xref\b|trailer\b|startxref\b)")


def whole_pdf(b: bytes, at: int) -> int:
    """A version, a cross-reference pointer and the end mark after it; further sections, of updates or of a linearised file, belong to it."""
    if not b[at + 5 : at + 6].isdigit():
        return 0
    upto, pos, end = b.find(b"%PDF-", at + 5), at, -1
    upto = len(b) if upto < 0 else upto
    while (xref := b.find(b"startxref", pos, upto)) >= 0 and (mark := b.find(b"%%EOF", xref, upto)) >= 0:
        end = pos = mark + 5
        if not PDF_SECTION.match(b, pos, upto):
            break
    return end - at if end >= 0 else 0


def whole_mp4(b: bytes, at: int) -> int:
    """Boxes end to end, one of them moov or mdat; a size of 1 is followed by one of 64 bits, a size of 0 goes to the end."""
    pos, seen = at, set()
    while at >= 0 and pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if size == 1 and pos + 16 <= len(b):
            size = struct.unpack_from(">Q", b, pos + 8)[0]
            size = size if size >= 16 else 0
        elif size == 0 and pos > at:
            size = len(b) - pos
        if size < 8 or pos + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        pos += size
    return pos - at if seen & {b"moov", b"mdat"} else 0


VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "image/png": whole_png, "image/jpeg": whole_jpeg, "image/gif": whole_gif, "image/bmp": whole_bmp, "audio/wav": whole_riff, "image/webp": whole_riff,
    "video/x-msvideo": whole_riff, "application/zip": whole_zip, "application/ogg": whole_ogg, "application/pdf": whole_pdf, "video/mp4": whole_mp4,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for media_type, (magic, after) in SIGNATURES.items():
        found.add_word(magic.decode("latin-1"), (media_type, len(magic) + after))
    found.make_automaton()
    return found


def sniffed(content: bytes, machine: ahocorasick.Automaton) -> list[Found]:
    """All confirmed media in the bytes, outermost and leftmost first; media inside confirmed media are left to a scan of it."""
    out, upto = [], 0
    for last, (media_type, back) in sorted(machine.iter(content.decode("latin-1")), key=lambda x: (x[0] + 1 - x[1][1], x[1][0])):
        at = last + 1 - back
        if at >= upto and (size := VALIDATORS[media_type](content, at)):
            out.append(Found(media_type, at, size))
            upto = at + size
    return out


def wav(samples: bytes) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; an even number of them needs no padding."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(content: bytes) -> bytes:
    """The bytes of the data chunk."""
    pos = 12
    while content[pos : pos + 4] != b"data":
        size = struct.unpack_from("<I", content, pos + 4)[0]
        pos += 8 + size + size % 2
    return content[pos + 8 : pos + 8 + struct.unpack_from("<I", content, pos + 4)[0]]


def corrected(media: DataFrame) -> DataFrame:
    """media_id, declared_type and content to media_id, declared_type, media_type, offset, length and content of each media found.

    media_type is the type by content. A row in which nothing is confirmed keeps its declared type and content, with offset
    0; null and empty content likewise, length 0. Media after the first are carved out of the same content.
    """
    key = media.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in chunks(batch, "content"):
                rows = []
                for i, (declared, content) in enumerate(zip(part.column("declared_type").to_pylist(), part.column("content").to_pylist(), strict=True)):
                    content = content or b""
                    found = sniffed(content, machine) or [Found(declared, 0, len(content))]
                    rows += [(i, declared, f.media_type, f.offset, f.length, content[f.offset : f.offset + f.length]) for f in found]
                at, *rest = zip(*rows, strict=True) if rows else [()] * 6
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("media_id").take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["media_id", "declared_type", "media_type", "offset", "length", "content"])

    return media.select("media_id", "declared_type", "content").mapInArrow(run, f"media_id {key}, declared_type string, media_type string, offset long, length long, content binary")


def stored(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared_type and content: each text, padded to whole frames, as a WAV file of a declared type that says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                files = [wav(x + PAD * ((-len(x)) % FRAME if x else FRAME)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "declared_type", "content"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared_type string, content binary")


def features(samples: np.ndarray) -> str:
    """Samples, mean, deviation and zero crossings about 128."""
    above = samples >= 128
    return f"{len(samples)};{samples.mean():.3f};{samples.std():.3f};{int((above[1:] != above[:-1]).sum())}"


def media_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of each document row.

    A null text is empty and gives one frame of padding. Rows are independent, so repeated rows and equal texts give equal
    values; extra columns are ignored; nothing is shuffled. The payload is read back from the media that sniffing confirms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            for part in chunks(batch, "content"):
                rows = []
                for content in part.column("content").to_pylist():
                    found = sniffed(content, machine)[0]
                    if found.media_type != "audio/wav":
                        raise ValueError(f"stored as WAV, found {found}")
                    own = content[found.offset : found.offset + found.length]
                    payload = wav_samples(own)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(own), hashlib.sha256(own).hexdigest(), f"{found.media_type};{features(np.frombuffer(payload, np.uint8))}"))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = zip(*rows, strict=True) if rows else [()] * 6
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored(documents).mapInArrow(run, schema)
