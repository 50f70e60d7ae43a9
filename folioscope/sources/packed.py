"""Readers for 7z and rar files, which the standard library lacks. From the published formats; methods that need other code give names without contents."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta

#: (path, content or None where its method can't be read, (year, month, day)); directories and empty files are left out.
Found = tuple[str, bytes | None, tuple[int, int, int]]
UNKNOWN_DAY = (1970, 1, 1)


class Cursor:
    """Places in a byte string, read one after another. An end before the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the data breaks off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def whole(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def number(self) -> int:
        """7z: leading ones of the first byte say how many bytes follow; its other bits are the highest."""
        first = self.byte()
        more = next((k for k in range(8) if not first & (0x80 >> k)), 8)
        low = int.from_bytes(self.take(more), "little")
        return low | (first & ((0x80 >> more) - 1)) << (8 * more) if more < 8 else low

    def varint(self) -> int:
        """rar: seven bits a byte, the lowest first."""
        out = 0
        for k in range(10):
            b = self.byte()
            out |= (b & 0x7F) << (7 * k)
            if not b & 0x80:
                return out
        raise ValueError("a number without end")

    def bits(self, n: int) -> list[bool]:
        octets = self.take((n + 7) // 8)
        return [bool(octets[k >> 3] & (0x80 >> (k & 7))) for k in range(n)]

    def flags(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


# 7z --------------------------------------------------------------------------------------------------------------------

# Property numbers and method numbers of the 7z format.
END, HEADER, ARCHIVE, MAIN, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODER_SIZES, COUNTS, EMPTY, EMPTY_FILE, NAMES, MTIME, ENCODED = 0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 17, 20, 23
COPY, LZMA1, LZMA2, DELTA, X86, DEFLATE, BZIP2 = b"\x00", b"\x03\x01\x01", b"\x21", b"\x03", b"\x03\x03\x01\x03", b"\x04\x01\x08", b"\x04\x02\x02"


def _coder(method: bytes, properties: bytes, data: bytes, size: int) -> bytes:
    raw = None
    if method == COPY:
        out = data
    elif method == LZMA1:
        p, dictionary = properties[0], int.from_bytes(properties[1:5], "little")
        raw = {"id": lzma.FILTER_LZMA1, "dict_size": max(4096, dictionary), "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45}
    elif method == LZMA2:
        b = properties[0]
        raw = {"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if b == 40 else (2 | b & 1) << (b // 2 + 11)}
    elif method == DEFLATE:
        out = zlib.decompressobj(-15).decompress(data)
    elif method == BZIP2:
        out = bz2.decompress(data)
    else:
        raise NotImplementedError(method.hex())
    if raw:
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[raw]).decompress(data, size)
    if len(out) != size:
        raise ValueError("a stream breaks off")
    return out


class _Streams:
    """Where a 7z file's packed streams are, the chains of coders (folders) they go through, and the files' parts of what comes out."""

    def __init__(self, c: Cursor):
        self.sizes, self.folders, self.counts, self.parts, self.base = [], [], [], None, 0
        while (kind := c.number()) != END:
            if kind == PACK:
                self.base, n = c.number(), c.number()
                while (inner := c.number()) != END:
                    if inner == SIZE:
                        self.sizes = [c.number() for _ in range(n)]
                    elif inner == CRC:
                        self._crcs(c, n)
            elif kind == UNPACK:
                self._unpack(c)
            elif kind == SUBSTREAMS:
                self._substreams(c)
            else:
                raise ValueError(f"property {kind} among the streams")
        if self.parts is None:
            self.counts, self.parts = [1] * len(self.folders), [[f["sizes"][f["main"]]] for f in self.folders]

    @staticmethod
    def _crcs(c: Cursor, n: int) -> list[bool]:
        known = c.flags(n)
        c.take(4 * sum(known))
        return known

    def _unpack(self, c: Cursor) -> None:
        while (kind := c.number()) != END:
            if kind == FOLDER:
                n = c.number()
                if c.byte():
                    raise NotImplementedError("folders elsewhere")
                self.folders = [self._folder(c) for _ in range(n)]
            elif kind == CODER_SIZES:
                for f in self.folders:
                    f["sizes"] = [c.number() for _ in f["coders"]]
            elif kind == CRC:
                for f, known in zip(self.folders, self._crcs(c, len(self.folders)), strict=True):
                    f["crc"] = known

    @staticmethod
    def _folder(c: Cursor) -> dict:
        coders = []
        for _ in range(c.number()):
            b = c.byte()
            method = c.take(b & 15)
            if b & 16 and (c.number(), c.number()) != (1, 1):
                raise NotImplementedError("a coder of many streams")
            coders.append((method, c.take(c.number()) if b & 32 else b""))
        pairs = dict((c.number(), c.number()) for _ in range(len(coders) - 1))  # input, and the output that feeds it
        return {"coders": coders, "pairs": pairs, "main": next(k for k in range(len(coders)) if k not in pairs.values()), "crc": False}

    def _substreams(self, c: Cursor) -> None:
        self.counts, self.parts = [1] * len(self.folders), None
        while (kind := c.number()) != END:
            if kind == COUNTS:
                self.counts = [c.number() for _ in self.folders]
            elif kind == SIZE:
                self.parts = []
                for f, n in zip(self.folders, self.counts, strict=True):
                    own = [c.number() for _ in range(n - 1)]
                    self.parts.append([*own, f["sizes"][f["main"]] - sum(own)] if n else [])
            elif kind == CRC:
                self._crcs(c, sum(n for f, n in zip(self.folders, self.counts, strict=True) if n != 1 or not f["crc"]))
        if self.parts is None:
            self.parts = [[f["sizes"][f["main"]]] * (n == 1) for f, n in zip(self.folders, self.counts, strict=True)]

    def contents(self, data: bytes) -> Iterator[bytes | None]:
        """What the files hold, in order; None for those of a folder whose method is unknown."""
        at = 32 + self.base
        for f, size, parts in zip(self.folders, self.sizes, self.parts, strict=False):
            try:
                out = self._decoded(f, f["main"], data[at : at + size])
            except (NotImplementedError, ValueError, OSError, EOFError, IndexError, lzma.LZMAError, zlib.error):
                out = None
            at += size
            place = 0
            for n in parts:
                yield None if out is None else out[place : place + n]
                place += n

    def _decoded(self, f: dict, k: int, packed: bytes) -> bytes:
        method, properties = f["coders"][k]
        source = f["pairs"].get(k)
        return _coder(method, properties, packed if source is None else self._decoded(f, source, packed), f["sizes"][k])


def seven_zip(data: bytes) -> Iterator[Found]:
    """Files of a 7z archive: stored, LZMA, LZMA2, deflate or bzip2; others by name only. A header that can't be read is an error."""
    if data[:6] != b"7z\xbc\xaf\x27\x1c":
        raise ValueError("not a 7z file")
    start, size = struct.unpack_from("<QQ", data, 12)
    head = Cursor(data[32 + start : 32 + start + size])
    if not size:
        return
    while (kind := head.number()) == ENCODED:
        head = Cursor(next(iter(_Streams(head).contents(data)), None) or b"")
    if kind != HEADER:
        raise ValueError("no header")
    streams, kind = None, head.number()
    if kind == ARCHIVE:
        while head.number() != END:
            head.take(head.number())
        kind = head.number()
    if kind == MAIN:
        streams, kind = _Streams(head), head.number()
    if kind != FILES:
        return
    n = head.number()
    names, empty, days = [""] * n, [False] * n, [UNKNOWN_DAY] * n
    while (kind := head.number()) != END:
        own = Cursor(head.take(head.number()))
        if kind == EMPTY:
            empty = own.bits(n)
        elif kind == NAMES and not own.byte():
            names = own.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
        elif kind == MTIME:
            known = own.flags(n)
            if not own.byte():
                for k in range(n):
                    if known[k]:
                        day = datetime(1601, 1, 1) + timedelta(microseconds=own.whole("Q") // 10)
                        days[k] = (day.year, day.month, day.day)
    held = streams.contents(data) if streams else iter(())
    for k in range(n):
        if not empty[k]:
            content = next(held, None)
            if content is None or content:
                yield names[k], content, days[k]


# rar -------------------------------------------------------------------------------------------------------------------


def _dos_day(stamp: int) -> tuple[int, int, int]:
    return 1980 + (stamp >> 25), stamp >> 21 & 15, stamp >> 16 & 31


def _rar4(data: bytes) -> Iterator[Found]:
    at = 7
    while at + 7 <= len(data):
        _, kind, flags, size = struct.unpack_from("<HBHH", data, at)
        if size < 7:
            return
        c = Cursor(data, at + 7)
        more = 0
        if kind == 0x74:
            packed, plain, _, _, stamp, _, method, name_size, _ = struct.unpack("<IIBIIBBHI", c.take(25))
            if flags & 0x100:
                packed, plain = packed | c.whole("I") << 32, plain | c.whole("I") << 32
            name = c.take(name_size).split(b"\0")[0]
            try:
                path = name.decode("utf-8")
            except UnicodeDecodeError:
                path = name.decode("cp866", "replace")
            more = packed
            if flags & 0xE0 != 0xE0 and plain:
                split = flags & 3
                content = data[at + size : at + size + packed] if method == 0x30 and not flags & 4 and not split else None
                yield path.replace("\\", "/"), content, _dos_day(stamp)
        elif flags & 0x8000:
            more = c.whole("I")
        if kind == 0x7B:
            return
        at += size + more


def _rar5(data: bytes) -> Iterator[Found]:
    at = 8
    while at + 7 <= len(data):
        c = Cursor(data, at + 4)
        size = c.varint()
        body = c.at
        kind, flags = c.varint(), c.varint()
        extra = c.varint() if flags & 1 else 0
        packed = c.varint() if flags & 2 else 0
        if kind == 2:
            own, plain, _ = c.varint(), c.varint(), c.varint()
            day = UNKNOWN_DAY
            if own & 2:
                when = datetime(1970, 1, 1) + timedelta(seconds=c.whole("I"))
                day = (when.year, when.month, when.day)
            if own & 4:
                c.take(4)
            method, _ = c.varint() >> 7 & 7, c.varint()
            path = c.take(c.varint()).decode("utf-8", "replace")
            sealed = False
            x = Cursor(data[: body + size], body + size - extra)
            while extra and x.at < body + size:
                n = x.varint()
                sealed |= Cursor(data, x.at).varint() == 1
                x.take(n)
            if not own & 1 and plain:
                content = data[body + size : body + size + packed] if not method and not sealed and not flags & 0x18 else None
                yield path, content, day
        if kind == 5:
            return
        at = body + size + packed


def rar(data: bytes) -> Iterator[Found]:
    """Files of a rar archive (versions 4 and 5): stored ones whole, packed and sealed ones by name only."""
    if data[:8] == b"Rar!\x1a\x07\x01\x00":
        yield from _rar5(data)
    elif data[:7] == b"Rar!\x1a\x07\x00":
        yield from _rar4(data)
    else:
        raise ValueError("not a rar file")
