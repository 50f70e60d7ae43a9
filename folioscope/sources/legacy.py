"""Old binary stores, little-endian: books, bookmarks and notes from the bytes of a ``binaryFile`` scan."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.paths import file_name
from folioscope.schema import BOOKS, NOTES, author, sequence

# Sizes of the numbers that say how long a field is.
_FORMATS = {2: "<H", 4: "<I", 8: "<Q"}


class Broken(ValueError):
    """A length that reaches beyond the data."""


def frame(data: bytes, at: int, width: int) -> tuple[bytes, int]:
    """A field behind its length, and where the next one begins."""
    if at + width > len(data):
        raise Broken(f"no length at place {at}")
    (size,) = struct.unpack_from(_FORMATS[width], data, at)
    at += width
    if at + size > len(data):
        raise Broken(f"{size} bytes from place {at} are more than there are")
    return data[at : at + size], at + size


def frames(data: bytes, width: int) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        field, at = frame(data, at, width)
        yield field


def comma_list(text: str) -> list[str]:
    """Items that a comma ends; a text without comma is one item. What follows the last comma is lost."""
    if "," not in text:
        return [text] if text else []
    return [x.strip(" ") for x in text.split(",")[:-1] if x.strip(" ")]


def shrinking(text: str) -> list[str]:
    """A title once for each comma, shorter by an item each time; one without comma as it is."""
    if "," not in text:
        return [text] if text else []
    parts = text.split(",")
    return [x for k in range(len(parts) - 1) if (x := ",".join(parts[k:]).strip(" "))]


def _book(data: bytes) -> dict:
    fields = [x.decode("utf-8", "replace") for x in frames(data, 2)]
    fields += [""] * (6 - len(fields))
    hops, authors, title, series, genre, date = fields[:6]
    return {
        "path_in_file": hops.split("\n") if hops else None, "fbd_path": None,
        "authors": [author(full=x) for x in comma_list(authors)], "titles": shrinking(title),
        "sequences": [sequence(full=x) for x in comma_list(series)], "genres": comma_list(genre), "dates": [date] if date else [],
    }


def collection(data: bytes) -> tuple[str, Iterator[dict]]:
    """Books directory and books of an old collection; file paths are below that directory. A broken length is an error."""
    base, at = frame(data, 0, 2)
    root = base.decode("utf-8", "replace").rstrip("/")

    def rows() -> Iterator[dict]:
        for entry in frames(data[at:], 8):
            path, k = frame(entry, 0, 2)
            _, k = frame(entry, k, 2)  # the old hash, of another kind than today's
            for book in frames(entry[k:], 8):
                yield {"file_path": f"{root}/{path.decode('utf-8', 'replace')}"} | _book(book)

    return root, rows()


def bookmarks(data: bytes) -> Iterator[dict]:
    """Old bookmarks: entries of eight bytes' length, with file, place and the five fields of a book; lists by comma and blank."""
    for entry in frames(data, 8):
        fields = [x.decode("utf-8", "replace") for x in frames(entry, 2)]
        fields += [""] * (7 - len(fields))
        path, hops, authors, title, series, genre, date = fields[:7]
        listed = lambda x: [y for y in x.split(", ") if y]
        yield {
            "file_path": path, "path_in_file": hops.split("\n") if hops else None, "fbd_path": None, "authors": [author(full=x) for x in listed(authors)], "titles": [title] if title else [],
            "sequences": [sequence(full=x) for x in listed(series)], "genres": listed(genre), "dates": [date] if date else [],
        }


def notes(data: bytes) -> Iterator[dict]:
    """Old notes: four fields of four bytes' length a record: one that is passed over, file, place, and the note's own file."""
    fields = [x.decode("utf-8", "replace") for x in frames(data, 4)]
    for k in range(0, len(fields) - 3, 4):
        _, path, hops, own = fields[k : k + 4]
        yield {"file_path": path, "path_in_file": hops.split("\n") if hops else None, "note_file": own, "note_text": None}


def _of(files: DataFrame, parser, ddl: str, strict: bool) -> DataFrame:
    from folioscope.sources.ingest import _arrow

    schema = _arrow(files.sparkSession, ddl)

    def over(batches):
        for batch in batches:
            for x in batch.column(0):
                rows = []
                try:
                    for row in parser(x.as_py() or b""):
                        rows.append(row)
                except Broken:
                    if strict:
                        raise
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("content").mapInArrow(over, ddl)


def books_of(files: DataFrame, strict: bool = False) -> DataFrame:
    """Books of old collections whose bytes are in ``content``; a broken one gives what comes before the break, or (``strict``) an error."""
    return _of(files, lambda data: collection(data)[1], BOOKS, strict)


def bookmarks_of(files: DataFrame, strict: bool = False) -> DataFrame:
    return _of(files, bookmarks, BOOKS, strict)


def notes_of(files: DataFrame, strict: bool = False) -> DataFrame:
    """Old notes, without their texts, which are files of their own: see ``with_texts``."""
    return _of(files, notes, NOTES, strict)


def with_texts(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Notes with the texts of their files, found by name among ``files`` (file_path, content)."""
    from folioscope.sources.charset import to_text

    texts = files.select(file_name(F.col("file_path")).alias("note_file"), to_text("content").alias("note_text")).groupBy("note_file").agg(F.min("note_text").alias("note_text"))
    return listed.drop("note_text").join(texts, "note_file", "left").select("file_path", "path_in_file", "note_file", "note_text")


def read(spark: SparkSession, kind: str, path: str, strict: bool = True) -> DataFrame:
    """An old ``books``, ``bookmarks`` or ``notes`` store, read through Spark's file systems: on any store, by any executor."""
    return {"books": books_of, "bookmarks": bookmarks_of, "notes": notes_of}[kind](spark.read.format("binaryFile").load(path), strict)
