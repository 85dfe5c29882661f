"""Seekable Zstandard files: independent frames, then a seek table in a skippable frame, as in the public seekable format."""

from __future__ import annotations

import struct

import zstandard

#: Fixed values of the format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9


class BundleWriter:
    """Writes records to a stream in frames of about `frame_bytes`; a record never crosses frames."""

    def __init__(self, stream, frame_bytes: int = 1 << 18, level: int = 3):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within the frame) of the record."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.held)
        self.parts.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.parts))
            self.stream.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Random access to the frames of a bundle: reads its footer, then only frames that are asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, _, magic = struct.unpack("<IBI", source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("not a seekable bundle")
        table = source.read_at(8 * count, size - FOOTER_BYTES - 8 * count)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.frames[k]
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=plain))
        return self.last[1]
