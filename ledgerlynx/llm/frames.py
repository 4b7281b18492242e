"""Independent zstandard frames, and the public seekable layout that lists them.

A seekable file is a row of independent frames, each with its content checksum, and ends
with a seek table: a skippable frame that holds the compressed size, the plain size and a
checksum of every frame before it.  Any zstandard tool decodes such a file from its start;
a reader of the table decompresses only the frames it needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import BinaryIO, NamedTuple

import numpy as np
import xxhash
import zstandard

# Fixed values of the public seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_WITH_CHECKS = 0x80


@cache
def _packer(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(data, level: int = 3) -> bytes:
    """One independent frame with its checksum."""
    return _packer(level).compress(data)


def unpack(frame) -> bytes:
    """The content of one frame; raises if its checksum does not fit."""
    return _unpacker().decompress(frame)


def check_of(data) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class Entry(NamedTuple):
    """Where a frame lies in its file, and where its content lies in the plain stream."""

    offset: int
    packed: int
    start: int
    plain: int
    check: int


class SeekableWriter:
    """Writes frames to an open stream; ``close`` adds the seek table."""

    def __init__(self, sink: BinaryIO, level: int = 3):
        self.sink, self.level, self.size = sink, level, 0
        self.entries: list[tuple[int, int, int]] = []

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def frame(self, data) -> None:
        packed = pack(data, self.level)
        self._write(packed)
        self.entries.append((len(packed), len(data), check_of(data)))

    def aside(self, data: bytes) -> None:
        """Content beside the stream: a skippable frame around a packed one."""
        packed = pack(data, self.level)
        self._write(_skippable(SKIPPABLE, packed))
        self.entries.append((len(packed) + 8, 0, check_of(data)))

    def close(self) -> int:
        """Write the table; returns the number of frames in the stream."""
        table = np.array(self.entries, dtype=_ENTRY).tobytes()
        foot = len(self.entries).to_bytes(4, "little") + bytes([_WITH_CHECKS])
        self._write(_skippable(SEEK_TABLE, table + foot + SEEKABLE.to_bytes(4, "little")))
        return sum(plain > 0 for _, plain, _ in self.entries)


def _skippable(magic: int, data: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


class SeekableReader:
    """Random access to an open file of ``size`` bytes by its trailing table."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        foot = self._at(size - 9, 9)
        if int.from_bytes(foot[5:], "little") != SEEKABLE or foot[4] != _WITH_CHECKS:
            raise ValueError("no seek table at the end of the file")
        n = int.from_bytes(foot[:4], "little")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype=_ENTRY)
        packed, plain = table["packed"].astype(np.int64), table["plain"].astype(np.int64)
        offsets, starts = np.cumsum(packed) - packed, np.cumsum(plain) - plain
        every = [
            Entry(*map(int, row)) for row in zip(offsets, packed, starts, plain, table["check"])
        ]
        self.frames = [e for e in every if e.plain]
        self.asides = [e for e in every if not e.plain]

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def content(self, e: Entry) -> bytes:
        """Decompress one frame and hold it against the table's checksum."""
        skip = 0 if e.plain else 8
        data = unpack(self._at(e.offset + skip, e.packed - skip))
        if check_of(data) != e.check:
            raise ValueError(f"frame at {e.offset} does not fit its checksum")
        return data


class Framed(NamedTuple):
    """Content held in memory as packed frames, with the plain end of each.

    ``blob`` are the frames one after another; ``packed`` their ends in it, ``plain``
    the ends of their contents.
    """

    blob: bytes
    packed: list[int]
    plain: list[int]

    def frame(self, k: int) -> bytes:
        low = self.packed[k - 1] if k else 0
        return unpack(memoryview(self.blob)[low : self.packed[k]])

    def stream(self, start: int, end: int) -> Iterator[memoryview]:
        """The content between two places, unpacking only the frames that hold it."""
        if start >= end:
            return
        k = int(np.searchsorted(self.plain, start, side="right"))
        low = self.plain[k - 1] if k else 0
        while low < end:
            part = memoryview(self.frame(k))
            yield part[max(0, start - low) : end - low]
            low, k = self.plain[k], k + 1


def framed(parts: Iterable, size: int, level: int = 3) -> Framed:
    """Pack a stream of byte strings into frames of ``size`` bytes; the last may be shorter."""
    blob, packed, plain, held = bytearray(), [], [], bytearray()

    def flush(data) -> None:
        blob.extend(pack(data, level))
        packed.append(len(blob))
        plain.append((plain[-1] if plain else 0) + len(data))

    for part in parts:
        held += part
        while len(held) >= size:
            flush(bytes(held[:size]))
            del held[:size]
    if held:
        flush(bytes(held))
    return Framed(bytes(blob), packed, plain)
