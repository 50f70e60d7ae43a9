"""Helpers for single archives, on bytes: listing, packing, removing an entry. They run where the caller is; nothing here deletes a file."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.paths import extension
from folioscope.sources.archives import ARCHIVES, entries, extension_of, member


def pack(kind: str, files: dict[str, bytes]) -> bytes:
    """A new archive: ``.zip``, ``.tar`` or ``.tar.gz``. Times are fixed, so equal content gives equal bytes."""
    out = io.BytesIO()
    if kind == ".zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in files.items():
                z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    elif kind in (".tar", ".tar.gz"):
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    else:
        raise ValueError(f"can't write archives of kind {kind}")
    return gzip.compress(out.getvalue(), mtime=0) if kind == ".tar.gz" else out.getvalue()


#: How the kinds that can be written anew are packed.
PACKERS = {".tar": bytes, ".tar.gz": lambda x: gzip.compress(x, mtime=0), ".tar.bz2": bz2.compress, ".tar.xz": lzma.compress}
UNPACKERS = {".tar": bytes, ".tar.gz": gzip.decompress, ".tar.bz2": bz2.decompress, ".tar.xz": lzma.decompress}


def _rewritten(kind: str, content: bytes, change: Callable[[str, bytes | None], bytes | None]) -> bytes | None:
    """An archive whose members are what ``change`` makes of their names and bytes (None for what is no file): None leaves one out, the same bytes keep it.

    Members that stay keep their order, names, times and rights, empty ones and those of equal names too. None if no file is left.
    """
    out, files = io.BytesIO(), 0
    if kind in (".zip", ".jar"):
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
            new.comment = old.comment
            for x in old.infolist():
                data = member(old, content, x)
                if x.is_dir():
                    new.writestr(x, data)
                elif (made := change(x.filename, data)) is not None:
                    new.writestr(x, made, x.compress_type)
                    files += 1
        return out.getvalue() if files else None
    if kind not in PACKERS:
        raise NotImplementedError(f"archives of kind {kind} can't be written")
    with tarfile.open(fileobj=io.BytesIO(UNPACKERS[kind](content))) as old, tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as new:
        for x in old:
            if not x.isfile():
                new.addfile(x)
            elif (made := change(x.name, old.extractfile(x).read())) is not None:
                x.size = len(made)
                new.addfile(x, io.BytesIO(made))
                files += 1
    return PACKERS[kind](out.getvalue()) if files else None


def without(kind: str, content: bytes, hops: list[str]) -> bytes | None:
    """An archive without the entry at ``hops`` and its ``.fbd`` beside it, at any depth; all else in it stays as it is. None if no file is left.

    A rar on the way goes whole, as its books do. An error if the entry isn't there, or an archive on the way is of a kind that
    can't be written: nothing is ever written as another kind than its name says.
    """
    name, *deeper = hops
    ext, found = extension_of(name), []
    side = (name[: len(name) - len(ext)] if ext else name) + ".fbd"
    whole = not deeper or ext == ".rar"

    def change(own: str, data: bytes) -> bytes | None:
        if own == name and (whole or not found):
            found.append(own)
            return None if whole else without(ext, data, deeper)
        return None if whole and own == side else data

    out = _rewritten(kind, content, change)
    if not found:
        raise FileNotFoundError(name)
    return out


def remove_book(spark: SparkSession, file_path: str, hops: list[str] | None = None) -> bool:
    """Takes a book out of its file on disk, and says whether the file is still there; a refresh of the collection follows.

    A plain file or a rar goes whole; of another archive the entry and its description go, by writing the archive anew beside
    the old one and renaming it over. One file is held on the driver.
    """
    from folioscope.operators.maintain import file_system, rename_over
    from folioscope.sources.ingest import crawl_files

    at, fs = file_system(spark, file_path)
    kind, left = extension_of(file_path), None
    if hops and kind != ".rar":
        left = without(kind, bytes(crawl_files(spark, [file_path]).first()["content"]), hops)
    if left is None:
        fs.delete(at, False)
        return False
    staged, _ = file_system(spark, f"{file_path}.{uuid.uuid4().hex}.new")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(left))
    finally:
        out.close()
    rename_over(spark, staged, at)
    return True


def _listed(content: bytes, ext: str) -> Iterator[tuple[str, int | None, str]]:
    """Name, size and date of an archive's entries; of a zip from its central directory, so that nothing is inflated."""
    if ext in (".zip", ".jar"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((x.filename, x.file_size, "{2:02d}.{1:02d}.{0:04d}".format(*x.date_time)) for x in z.infolist() if not x.is_dir() and x.file_size)
            return
        except zipfile.BadZipFile:
            return
    yield from ((x.path, None if x.content is None else len(x.content), x.date) for x in entries(ext, content))


def extract(kind: str, content: bytes, folder: str) -> list[str]:
    """Writes an archive's entries below a local folder, and gives their paths. An entry that would lie outside it is an error."""
    import os

    root, made = os.path.realpath(folder), []
    for x in entries(kind, content):
        if x.content is None:
            raise NotImplementedError(f"{x.path}: its method can't be read")
        path = os.path.realpath(os.path.join(root, x.path))
        if not path.startswith(root + os.sep):
            raise ValueError(f"{x.path} lies outside")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(x.content)
        made.append(path)
    return made


def listing(crawled: DataFrame) -> DataFrame:
    """(file_path, entry, size, date): entries of the archives among crawled files, without those of archives inside them. An entry known by name only has a null size."""

    def over(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, ext, content = (batch.column(i)[k].as_py() for i in range(3))
                found = list(_listed(content or b"", ext))
                names, sizes, dates = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(dates, pa.string())], names=["file_path", "entry", "size", "date"])

    own = crawled.select("file_path", extension(F.col("file_path")).alias("ext"), "content").where(F.col("ext").isin(*ARCHIVES))
    return own.mapInArrow(over, "file_path string, entry string, size long, date string")
