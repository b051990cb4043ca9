"""Archives put together from parts that were compressed piece by piece, elsewhere and in any order.

A piece ends with a full flush, so compressed pieces of a part can stand one behind the other; their checksums are combined without reading them
again. Only this module knows the archive's layout.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

#: The polynomial of CRC-32, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
#: An empty last block of a deflated stream.
LAST_BLOCK = b"\x03\x00"


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit is the coefficient of 1."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of two texts one behind the other, of their own and the length of the second in bytes."""
    shift, square = 1 << 31, 1 << 23  # 1, and x to the 8th: one byte
    while length:
        if length & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        length >>= 1
    return _times(shift, first) ^ second


def deflated(data: bytes, level: int = 6) -> tuple[int, int, bytes]:
    """(CRC-32, length, compressed piece)."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return zlib.crc32(data), len(data), z.compress(data) + z.flush(zlib.Z_FULL_FLUSH)


class Archive:
    """Bytes of an archive, part by part. Sizes follow the data, so nothing must be known before; beyond 4 GB they take 64 bits."""

    LIMIT = 0xFFFFFFFF

    def __init__(self):
        self.at = 0
        self.entries: list[tuple[bytes, int, int, int, int]] = []

    def part(self, name: str, pieces: Iterable[tuple[int, int, bytes]], large: bool = False) -> Iterator[bytes]:
        """``large``: it may hold 4 GB or more, before or after compression."""
        own, begin = name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if large else b""
        head = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if large else 20, 1 << 3 | 1 << 11, 8, 0, 33, 0, *[self.LIMIT if large else 0] * 2, len(own), len(extra)) + own + extra
        self.at += len(head)
        yield head
        crc = size = packed = 0
        for c, n, data in pieces:
            crc, size, packed = crc_joined(crc, c, n), size + n, packed + len(data)
            yield data
        yield LAST_BLOCK
        packed += len(LAST_BLOCK)
        if not large and max(size, packed) >= self.LIMIT:
            raise ValueError(f"{name} is too large for 32 bits")
        told = struct.pack("<4sIQQ" if large else "<4sIII", b"PK\7\x08", crc, packed, size)
        self.at += packed + len(told)
        self.entries.append((own, crc, packed, size, begin))
        yield told

    def directory(self) -> Iterator[bytes]:
        begin, n = self.at, len(self.entries)
        for own, crc, packed, size, at in self.entries:
            wide = max(packed, size, at) >= self.LIMIT
            extra = struct.pack("<HHQQQ", 1, 24, size, packed, at) if wide else b""
            short = [self.LIMIT] * 3 if wide else [packed, size, at]
            entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 1 << 3 | 1 << 11, 8, 0, 33, crc, short[0], short[1], len(own), len(extra), 0, 0, 0, 0, short[2]) + own + extra
            self.at += len(entry)
            yield entry
        size = self.at - begin
        if max(self.at, begin) >= self.LIMIT or n >= 0xFFFF:
            yield struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin)
            yield struct.pack("<4sIQI", b"PK\6\7", 0, self.at, 1)
        yield struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, self.LIMIT), min(begin, self.LIMIT), 0)
