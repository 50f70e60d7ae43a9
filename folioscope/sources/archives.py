"""Entries of archives: zip, tar (plain, gz, bz2, xz), cpio, ISO 9660, 7z and rar, nested to any depth."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from folioscope.sources import formats, packed
from folioscope.sources.formats import PARSERS

ARCHIVES = (".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz", ".jar", ".cpio", ".iso", ".7z", ".rar")


@dataclass
class Entry:
    path: str
    content: bytes | None  # None: known by name only, as its method can't be read
    date: str


def extension_of(name: str) -> str:
    name = posixpath.basename(name).lower()
    at = name.find(".tar")
    return name[at:] if at >= 0 else name[name.rfind(".") :] if "." in name else ""


def stem_of(path: str) -> str:
    name = posixpath.basename(path)
    return name[: name.rfind(".")] if name.rfind(".") > 0 else name


def _date(year: int, month: int, day: int) -> str:
    return f"{day:02d}.{month:02d}.{year:04d}"


def _epoch(seconds: float) -> str:
    import time

    t = time.gmtime(seconds)
    return _date(t.tm_year, t.tm_mon, t.tm_mday)


def _cpio(content: bytes) -> Iterator[Entry]:
    """The "newc" and "odc" forms."""
    at = 0
    while at + 6 <= len(content):
        magic = content[at : at + 6]
        if magic in (b"070701", b"070702"):
            f = [int(content[at + 6 + 8 * k : at + 14 + 8 * k], 16) for k in range(13)]
            mode, mtime, size, name_size = f[1], f[5], f[6], f[11]
            start = at + 110
            name = content[start : start + name_size - 1]
            body = -(-(start + name_size) // 4) * 4
            after = -(-(body + size) // 4) * 4
        elif magic == b"070707":
            field = lambda a, n, at=at: int(content[at + a : at + a + n], 8)
            mode, mtime, name_size, size = field(18, 6), field(48, 11), field(59, 6), field(65, 11)
            name = content[at + 76 : at + 76 + name_size - 1]
            body = at + 76 + name_size
            after = body + size
        else:
            return
        if name == b"TRAILER!!!":
            return
        if mode & 0o170000 == 0o100000:
            yield Entry(name.decode("utf-8", "replace"), content[body : body + size], _epoch(mtime))
        at = after


def _iso(content: bytes) -> Iterator[Entry]:
    """The primary volume's tree, or the Joliet one where there is one."""
    sector, roots = 2048, {}
    at = 16 * sector
    while at + sector <= len(content) and content[at + 1 : at + 6] == b"CD001" and content[at] != 255:
        joliet = content[at] == 2 and content[at + 88 : at + 91] in (b"%/@", b"%/C", b"%/E")
        if content[at] == 1 or joliet:
            roots[joliet] = content[at + 156 : at + 190]
        at += sector
    if not roots:
        return
    joliet = True in roots
    todo, seen = [("", roots[joliet])], set()
    while todo:
        base, record = todo.pop()
        start, size = int.from_bytes(record[2:6], "little") * sector, int.from_bytes(record[10:14], "little")
        if start in seen:
            continue
        seen.add(start)
        at, end = start, min(start + size, len(content))
        while at < end:
            length = content[at]
            if not length:
                at = (at // sector + 1) * sector
                continue
            own = content[at : at + length]
            name = own[33 : 33 + own[32]]
            if name not in (b"\0", b"\1"):
                text = (name.decode("utf-16-be", "replace") if joliet else name.decode("ascii", "replace")).split(";")[0].rstrip(".")
                if own[25] & 2:
                    todo.append((f"{base}{text}/", own))
                else:
                    a, n = int.from_bytes(own[2:6], "little") * sector, int.from_bytes(own[10:14], "little")
                    yield Entry(base + text, content[a : a + n], _date(1900 + own[18], own[19], own[20]))
            at += length


def member(z: zipfile.ZipFile, content: bytes, x: zipfile.ZipInfo) -> bytes:
    """An entry's bytes out of a zip that is held whole: stored and deflated ones at one go, any other and whatever doesn't fit its header by the library, with its errors."""
    at, end = x.header_offset, getattr(x, "_end_offset", None)
    if x.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) and not x.flag_bits & 0x2061 and content[at : at + 4] == b"PK\3\4" and at + 30 <= len(content):
        n_name, n_extra = struct.unpack_from("<HH", content, at + 26)
        start = at + 30 + n_name + n_extra
        stop = start + x.compress_size
        named = content[at + 30 : at + 30 + n_name] == x.orig_filename.encode("utf-8" if x.flag_bits & 0x800 else "cp437", "replace")
        if named and stop <= len(content) and (end is None or stop <= end):
            try:
                data = content[start:stop] if x.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(content[start:stop], x.file_size + 1)
            except zlib.error:
                data = b""
            if len(data) == x.file_size and zlib.crc32(data) == x.CRC:
                return data
    return z.read(x)


def entries(extension: str, content: bytes) -> Iterator[Entry]:
    """Files of an archive, without empty ones and directories; a broken archive gives what comes before the break."""
    try:
        if extension in (".zip", ".jar"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for x in z.infolist():
                    if not x.is_dir() and x.file_size:
                        yield Entry(x.filename, member(z, content, x), _date(*x.date_time[:3]))
        elif extension == ".cpio":
            yield from (x for x in _cpio(content) if x.content)
        elif extension == ".iso":
            yield from (x for x in _iso(content) if x.content)
        elif extension in (".7z", ".rar"):
            for path, data, day in (packed.seven_zip if extension == ".7z" else packed.rar)(content):
                yield Entry(path, data, _date(*day))
        else:
            plain = {".tar.gz": gzip.decompress, ".tar.bz2": bz2.decompress, ".tar.xz": lzma.decompress, ".tar": bytes}.get(extension)
            if plain is None:
                return
            content = plain(content)
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                straight = type(t.fileobj) is io.BytesIO  # or else what is named .tar is packed, and the library unpacks it
                for x in t:
                    if x.isfile() and x.size:
                        end = x.offset_data + x.size
                        data = content[x.offset_data : end] if straight and not x.issparse() and end <= len(content) else t.extractfile(x).read()
                        yield Entry(x.name, data, _epoch(x.mtime))
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, struct.error, RuntimeError, NotImplementedError, IndexError, OverflowError):
        return


def books(extension: str, content: bytes, hops: list[str] | None = None, details: bool = True) -> Iterator[tuple[list[str], str | None, dict, dict]]:
    """(hops, fbd path, book, details) of the books in an archive, those in archives inside it too.

    A ``.fbd`` entry describes the entry beside it with the same stem: it replaces that one's own book, or makes one of a file
    of unknown format. One without such an entry is passed over. Details may be left out. An entry known by name only is a book by its stem and date.
    """
    yield from books_of(list(entries(extension, content)), hops, details)


def books_of(every: list[Entry], hops: list[str] | None = None, details: bool = True) -> Iterator[tuple[list[str], str | None, dict, dict]]:
    """The same for entries that are read already."""
    hops = hops or []
    sidecars = {x.path[: -len(".fbd")]: x for x in every if x.path.lower().endswith(".fbd")}
    used: set[str] = set()
    for x in every:
        ext = extension_of(x.path)
        if ext == ".fbd":
            continue
        key = x.path[: len(x.path) - len(ext)] if ext else x.path
        side = sidecars.get(key)
        if x.content is None:
            if ext in PARSERS and side is None:
                yield [*hops, x.path], None, *formats.unread(stem_of(x.path), x.date)
                continue
            if side is None or side.content is None:
                continue
        if ext in ARCHIVES and side is None:
            yield from books(ext, x.content, [*hops, x.path], details)
            continue
        if side is not None and key not in used:
            used.add(key)
            made = formats.parse(".fb2", side.content, stem_of(x.path), x.date, details) if side.content is not None else None
            if made:
                yield [*hops, x.path], side.path, *made
                continue
        if ext in PARSERS and x.content is not None and (made := formats.parse(ext, x.content, stem_of(x.path), x.date, details)):
            yield [*hops, x.path], None, *made
