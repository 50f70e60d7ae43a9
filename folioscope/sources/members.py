"""Members of archives too large to be held, read one by one: a data source whose partitions are ranges of zip files, and streams of tar files."""

from __future__ import annotations

import json
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER = "file_path string, entry string, size long, date string, content binary"
#: Packed bytes of members that one task reads.
GROUP_BYTES = 1 << 26
ZIPS = (".zip", ".jar", ".inpx")
#: How a tar file is read as a stream.
TARS = {".tar": "r|", ".tar.gz": "r|gz", ".tar.bz2": "r|bz2", ".tar.xz": "r|xz"}


def opened(path: str):
    """A file for reading at any place: a mounted one, or one in a store that pyarrow knows."""
    at = urlsplit(path)
    if at.scheme in ("", "file"):
        return open(unquote(at.path) if at.scheme else path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def kind_of(path: str) -> str:
    from folioscope.sources.archives import extension_of

    return extension_of(unquote(path))


@dataclass
class Range(InputPartition):
    """Some members of a zip file (place of the header, method, packed size, size, name, date), or a whole tar file (None)."""

    path: str
    members: list[tuple[int, int, int, int, str, str]] | None = None

    def __post_init__(self):
        super().__init__(None)


def _date(t) -> str:
    return f"{t[2]:02d}.{t[1]:02d}.{t[0]:04d}"


def _member(f, place: int, method: int, packed: int, size: int, name: str) -> bytes:
    """A member's bytes, from its own header on: only its range is read."""
    f.seek(place)
    head = f.read(30)
    f.seek(place + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = f.read(packed)
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompressobj(-15).decompress(raw, size)
    f.seek(0)
    with zipfile.ZipFile(f) as z:  # a rare method: the library reads the directory again
        return z.read(name)


class Members(DataSource):
    """``paths`` (JSON list of files), ``suffixes`` (JSON list of endings of names, all if empty), ``single`` (a task a member), ``most`` (bytes of a member up to which its content is read; a larger one's is null), ``group`` (packed bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "folioscope_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.suffixes = tuple(json.loads(options.get("suffixes", "[]")))
        self.single = options.get("single", "false") == "true"
        self.most = int(options.get("most", 1 << 30))
        self.group = int(options.get("group", GROUP_BYTES))

    def _wanted(self, name: str) -> bool:
        return not self.suffixes or name.lower().endswith(self.suffixes)

    def partitions(self) -> list[Range]:
        """Of each zip file only its directory is read."""
        out: list[Range] = []
        for path in self.paths:
            if kind_of(path) in TARS:
                out.append(Range(path))
                continue
            try:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    found = [(x.header_offset, -1 if x.flag_bits & 1 else x.compress_type, x.compress_size, x.file_size, x.filename, _date(x.date_time)) for x in z.infolist() if not x.is_dir() and x.file_size and self._wanted(x.filename)]
            except zipfile.BadZipFile:
                out.append(Range(path, []))
                continue
            group, size = [], 0
            for x in found:
                if group and (self.single or size + x[2] > self.group):
                    out.append(Range(path, group))
                    group, size = [], 0
                group.append(x)
                size += x[2]
            if group:
                out.append(Range(path, group))
        return out or [Range("", [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            if part.members == []:
                yield pa.RecordBatch.from_arrays([pa.array([part.path]), *(pa.nulls(1, t) for t in (pa.string(), pa.int64(), pa.string(), pa.binary()))], names=[x.split()[0] for x in MEMBER.split(", ")])
                return
            with opened(part.path) as f:
                for name, size, date, content in self._of(f, part):
                    yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([name]), pa.array([size], pa.int64()), pa.array([date]), pa.array([content], pa.binary())], names=[x.split()[0] for x in MEMBER.split(", ")])

    def _of(self, f, part: Range) -> Iterator[tuple[str, int, str, bytes | None]]:
        import time

        if part.members is not None:
            for place, method, packed, size, name, date in part.members:
                content = None
                if size <= self.most and method >= 0:
                    try:
                        content = _member(f, place, method, packed, size, name)
                    except (zlib.error, zipfile.BadZipFile, NotImplementedError, RuntimeError):
                        pass
                yield name, size, date, content
            return
        try:
            with tarfile.open(fileobj=f, mode=TARS[kind_of(part.path)]) as t:
                for x in t:
                    if x.isfile() and x.size and self._wanted(x.name):
                        yield x.name, x.size, _date(time.gmtime(x.mtime)), t.extractfile(x).read() if x.size <= self.most else None
        except (tarfile.TarError, OSError, EOFError, zlib.error):  # what comes before the break counts
            return


def members(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = (), single: bool = False, most: int = 1 << 30, group: int = GROUP_BYTES) -> DataFrame:
    """(see MEMBER): members of zip and tar files of any size, without directories and empty ones.

    A zip file is read by ranges of its members, in as many tasks as they need; a tar file, which has no directory, as a stream
    in one task, one member at a time. A member of more than ``most`` bytes, or of a method that can't be read, has null content. A file that is no
    zip although it is named so has one row, without an entry.
    """
    spark.dataSource.register(Members)
    return spark.read.format(Members.name()).options(paths=json.dumps(paths), suffixes=json.dumps(suffixes), single=str(single).lower(), most=most, group=group).load()
