"""WARC records in seekable Zstandard bundles: the byte formats."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import xxhash
import zstandard

# Fixed values of the formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20


def record(
    record_id: str, kind: str, payload: bytes, digest: str, uri: str | None, date: str, refers_to: str | None
) -> bytes:
    """One WARC record; a revisit has the HTTP head alone as its block. ``digest`` is a hex SHA-1."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if uri is None else quote(uri, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
        ("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields and the payload of the record that begins at ``at``, and where the next one begins."""
    head_end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:head_end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    block = data[head_end + 4 : head_end + 4 + size]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    return fields, payload, head_end + 4 + size + 4


def digest_of(fields: dict[str, str]) -> str:
    """The record's payload digest in hex."""
    return base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()


class BundleWriter:
    """Writes records to bundles that ``create`` opens: independent frames, then a seek table.

    A frame closes once it holds ``frame_bytes``; a longer record has a frame of its own.
    ``close`` and every full bundle hand over the places of the records written:
    (record id, bundle, frame, frame start, frame size, offset in the frame, size).
    """

    def __init__(
        self, create: Callable[[], tuple[str, BinaryIO]], frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
    ):
        self.create, self.frame_bytes, self.bundle_bytes = create, frame_bytes, bundle_bytes
        self.file: BinaryIO | None = None
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, record_id: str, data: bytes) -> list[tuple]:
        if self.file is None:
            self.name, self.file = self.create()
            self.at, self.frames, self.places = 0, [], []
            self.parts, self.held, self.waiting = [], 0, []
        if self.held and self.held + len(data) > self.frame_bytes:
            self._end_frame()
        self.waiting.append((record_id, self.held, len(data)))
        self.parts.append(data)
        self.held += len(data)
        return self.close() if self.at + self.held > self.bundle_bytes else []

    def _end_frame(self) -> None:
        data = b"".join(self.parts)
        packed = self.compressor.compress(data)
        self.file.write(packed)
        self.places += [(r, self.name, len(self.frames), self.at, len(packed), o, n) for r, o, n in self.waiting]
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.at += len(packed)
        self.parts, self.held, self.waiting = [], 0, []

    def close(self) -> list[tuple]:
        if self.file is None:
            return []
        self._end_frame()
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.file.close()
        self.file = None
        return self.places


def seek_table(file: BinaryIO, size: int) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of every frame, from the end of a bundle."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & CHECKSUMS else 8
    file.seek(size - 9 - count * width - 8)
    data = file.read(8 + count * width)
    if struct.unpack("<II", data[:8]) != (SKIPPABLE, count * width + 9):
        raise ValueError("broken seek table")
    out, at = [], 0
    for i in range(count):
        entry = struct.unpack("<III" if width == 12 else "<II", data[8 + i * width : 8 + (i + 1) * width])
        out.append((at, entry[0], entry[1], entry[2] if width == 12 else None))
        at += entry[0]
    return out


def read_frame(file: BinaryIO, entry: tuple) -> bytes:
    """One frame, checked."""
    start, packed, size, checksum = entry
    file.seek(start)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    if len(data) != size or (checksum is not None and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum):
        raise ValueError("broken frame")
    return data


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, payload) of every record of a frame."""
    at = 0
    while at < len(data):
        fields, payload, following = parse(data, at)
        yield at, fields, payload
        at = following


def sha1(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()
