"""From directories and files to the tables ``files``, ``books`` and ``details``."""

from __future__ import annotations

import hashlib
import os
import posixpath
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.paths import extension, supported
from folioscope.functions.text import ddmmyyyy
from folioscope.operators.shared import held
from folioscope.schema import BOOKS, DETAILS
from folioscope.sources import archives, formats
from folioscope.sources.members import TARS, ZIPS, members

#: Bytes of a file up to which it is read whole. A larger zip or tar is read member by member, and so are its books; any other
#: larger file isn't opened: it is one book, by its stem and date. Neither has a hash.
MAX_FILE_BYTES = 1 << 30
#: Files up to which those to be read are named one by one; of more, their directories are scanned again.
NAMED_FILES = 10_000
#: Bytes of a file that are hashed at a time.
PIECE = 1 << 22
#: Books, and bytes of their covers, that a task hands on at a time.
BATCH_ROWS, BATCH_BYTES = 1 << 10, 1 << 23


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _scanned(found: DataFrame, root) -> DataFrame:
    name = F.regexp_replace("path", "^file:/+", "/")
    return found.select(name.alias("file_path"), root.alias("root_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


EMPTY_CRAWL = "file_path string, root_path string, file_size long, modified timestamp, content binary"


def crawl(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_path, root_path, file_size, modified, content): supported files under every path, recursively, through Spark's file systems, so on any store.

    Missing paths are passed over; links to directories are followed where the file system does. Content is read only if asked for.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for path in dict.fromkeys(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(conf).exists(at):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
        own = _scanned(found, F.lit(path.rstrip("/")))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = spark.createDataFrame([], EMPTY_CRAWL)
    return out.where(supported(F.col("file_path")))


def crawl_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The same for single files, each its own root. Signs that mean something in a pattern are taken as they are."""
    if not files:
        return spark.createDataFrame([], EMPTY_CRAWL)
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", x) for x in files])
    return _scanned(found, F.regexp_replace("path", "^file:/+", "/"))


#: Directories that a task lists, rows that it hands on at a time, and files that it hashes.
DIRS_A_TASK, LISTED_ROWS, HASHED_A_TASK = 64, 1 << 13, 1 << 12
_LISTED = "path string, is_dir boolean, file_size long, millis long"


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands in the directories of (path): (see _LISTED); one that can't be read has nothing, however many entries it has they are handed on as they come."""
    types = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _LISTED.split(", ")])
    rows: list[tuple] = []
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with os.scandir(path) as found:
                    for x in found:
                        if _hidden(x.name):
                            continue
                        try:
                            s = x.stat()
                        except OSError:
                            continue
                        rows.append((x.path.encode("utf-8", "replace").decode(), x.is_dir(), s.st_size, s.st_mtime_ns // 1_000_000))
                        if len(rows) >= LISTED_ROWS:
                            yield batch_of(rows)
                            rows = []
            except OSError:
                continue
    if rows:
        yield batch_of(rows)


def _mounted(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def listed(spark: SparkSession, *paths: str) -> DataFrame:
    """``crawl`` without content. Of a mounted file system directories are listed by tasks, level by level, and what is found stands in the shared folder: the driver holds no list of files, as it does for other stores."""
    out = None
    for path in dict.fromkeys(paths):
        if not _mounted(spark, path):
            own = crawl(spark, path).drop("content")
        else:
            at = re.sub("^file:/+", "/", path).rstrip("/") or "/"
            levels = []
            if os.path.isfile(at):
                s = os.stat(at)
                levels.append(spark.createDataFrame([(at, False, s.st_size, s.st_mtime_ns // 1_000_000)], _LISTED))
            dirs = spark.createDataFrame([(at,)] if os.path.isdir(at) else [], "path string")
            while n := dirs.count():
                level = held(dirs.repartition(-(-n // DIRS_A_TASK), "path").mapInArrow(_entries, _LISTED))
                levels.append(level.where("not is_dir"))
                dirs = level.where("is_dir").select("path")
            rows = levels[0] if levels else spark.createDataFrame([], _LISTED)
            for x in levels[1:]:
                rows = rows.unionByName(x)
            own = rows.select(F.col("path").alias("file_path"), F.lit(path.rstrip("/")).alias("root_path"), "file_size", F.timestamp_millis("millis").alias("modified"))
            own = own.where(supported(F.col("file_path")))
        out = own if out is None else out.unionByName(own)
    return spark.createDataFrame([], EMPTY_CRAWL).drop("content") if out is None else out


def _hashed_by_path(rows: DataFrame) -> DataFrame:
    """``files_of`` for files of a mounted file system, each read by a task; one that isn't there any more is passed over."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, (path, size) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    h = hashlib.blake2b(digest_size=32)
                    if size <= MAX_FILE_BYTES:
                        with open(path, "rb") as f:
                            while piece := f.read(PIECE):
                                h.update(piece)
                    found.append((k, h.digest() if size <= MAX_FILE_BYTES else None))
                except OSError:
                    continue
            own = batch.take(pa.array([k for k, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x for _, x in found], pa.binary())], names=["file_path", "root_path", "file_size", "file_hash"])

    tasks = max(1, -(-rows.count() // HASHED_A_TASK))
    read = rows.select("file_path", "root_path", "file_size").repartition(tasks, "file_path").mapInArrow(over, "file_path string, root_path string, file_size long, file_hash binary")
    return read.select("file_path", F.lit("dir").alias("root_kind"), "root_path", F.lit(None).cast("string").alias("link_path"), "file_hash", "file_size")


def files_of(crawled: DataFrame, hashes: bool = True) -> DataFrame:
    """(file_path, root_kind, root_path, link_path, file_hash, file_size); without ``hashes`` no content is read. Files over MAX_FILE_BYTES have a null hash."""

    def over(batches):
        for batch in batches:
            hashed = [hashlib.blake2b(x.as_py() or b"", digest_size=32).digest() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(hashed, pa.binary())], names=["file_path", "root_path", "file_size", "file_hash"])

    none = F.lit(None).cast("binary").alias("file_hash")
    if hashes:
        rows = _opened(crawled).select("file_path", "root_path", "file_size", "content").mapInArrow(over, "file_path string, root_path string, file_size long, file_hash binary")
        rows = rows.unionByName(_closed(crawled).select("file_path", "root_path", "file_size", none))
    else:
        rows = crawled.select("file_path", "root_path", "file_size", none)
    return rows.select("file_path", F.lit("dir").alias("root_kind"), "root_path", F.lit(None).cast("string").alias("link_path"), "file_hash", "file_size")


def _opened(crawled: DataFrame) -> DataFrame:
    return crawled.where(F.col("file_size") <= MAX_FILE_BYTES)  # pushed into the scan, which then never reads the others


def _closed(crawled: DataFrame) -> DataFrame:
    return crawled.where(F.col("file_size") > MAX_FILE_BYTES).drop("content")


def rehash(known: DataFrame, since, *paths: str) -> DataFrame:
    """``files_of`` for everything under ``paths``, with the hashes of ``known`` (files) for paths of the same size that haven't been modified after ``since`` (a timestamp): only the others are read."""
    spark = known.sparkSession
    every = held(listed(spark, *paths))
    hashed = known.where("file_hash is not null").select("file_path", "file_size", "file_hash").dropDuplicates(["file_path"])
    same = every.where(F.col("modified") <= F.lit(since)).join(hashed, ["file_path", "file_size"])
    rest = every.join(same.select("file_path"), "file_path", "left_anti")
    columns = ["file_path", "root_kind", "root_path", "link_path", "file_hash", "file_size"]
    kept = files_of(same, hashes=False).drop("file_hash").join(same.select("file_path", "file_hash"), "file_path").select(*columns)
    if all(_mounted(spark, x) for x in paths):
        return kept.unionByName(_hashed_by_path(rest).select(*columns))
    named = [r["file_path"] for r in rest.select("file_path").limit(NAMED_FILES + 1).collect()]
    if len(named) > NAMED_FILES:
        fresh = files_of(crawl(spark, *paths)).join(rest.select("file_path"), "file_path", "left_semi")
    else:
        hashed = files_of(crawl_files(spark, named)).select("file_path", "file_hash")
        fresh = files_of(rest, hashes=False).drop("file_hash").join(hashed, "file_path", "left")
    return kept.unionByName(fresh.select(*columns))


def _parsed(ext: str, content: bytes, path: str, date: str, details: bool):
    """(hops or None, fbd path, book, details) of one file's books."""
    if ext in archives.ARCHIVES:
        for hops, side, book, more in archives.books(ext, content, details=details):
            yield hops, side, book, more
    elif made := formats.parse(ext, content, archives.stem_of(path), date, details):
        yield None, None, *made


def _handed_on(found: Iterator[tuple], schema: pa.Schema, details: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (file path, hops, fbd path, book, details), as many together as BATCH_ROWS and BATCH_BYTES of covers allow: a batch for each file costs more than its parsing."""
    rows, size = [], 0
    for path, hops, side, book, more in found:
        rows.append({"file_path": path, "path_in_file": hops, "fbd_path": side, **book, **(more if details else {})})
        size += len(more["cover"]["data"] or b"") if details and more["cover"] else 0
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield _rows(rows, schema)
            rows, size = [], 0
    if rows:
        yield _rows(rows, schema)


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """As ``RecordBatch.from_pylist``; a column of empty lists alone, as most details are, isn't made value by value."""
    columns = []
    for f in schema:
        own = [r[f.name] for r in rows]
        if pa.types.is_list(f.type) and not any(own) and None not in own:
            columns.append(pa.ListArray.from_arrays(pa.array([0] * (len(own) + 1), pa.int32()), pa.array([], f.type.value_type), type=f.type))
        else:
            columns.append(pa.array(own, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def parse(crawled: DataFrame, details: bool = False) -> DataFrame:
    """Books of crawled files, a row each (see ``schema.BOOKS``), with ``schema.DETAILS`` beside them if asked for.

    Files are parsed where they are read, in Arrow batches, and their books handed on some together; nothing is shuffled. A
    missing title becomes the file's stem, a missing date the file's (or the archive entry's) modification date.
    A zip or tar over MAX_FILE_BYTES is read by its members (see ``members``), a member being held at a time; another file of that
    size is one book of that title and date.
    """
    spark = crawled.sparkSession
    ddl = BOOKS + (", " + DETAILS if details else "")
    schema = _arrow(spark, ddl)

    def over(batches):
        def found():
            for batch in batches:
                for k in range(batch.num_rows):
                    path, ext, date, content = (batch.column(i)[k].as_py() for i in range(4))
                    for hops, side, book, more in _parsed(ext, content or b"", unquote(path), date, details):
                        yield path, hops, side, book, more

        return _handed_on(found(), schema, details)

    def unread(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                path, _, date = (batch.column(i)[k].as_py() for i in range(3))
                book, more = formats.unread(archives.stem_of(unquote(path)), date)
                rows.append({"file_path": path, "path_in_file": None, "fbd_path": None} | book | (more if details else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    columns = ["file_path", extension(F.col("file_path")).alias("ext"), ddmmyyyy(F.col("modified")).alias("date")]
    rows = _opened(crawled).select(*columns, "content").mapInArrow(over, ddl)
    large = _closed(crawled)
    packed = extension(F.col("file_path")).isin(*ZIPS, *TARS)
    paths = [r["file_path"] for r in large.where(packed).select("file_path").collect()]
    closed = large.where(~packed)
    if paths:
        every = members(spark, paths, most=MAX_FILE_BYTES)
        rows = rows.unionByName(_large(spark, every, paths, ddl, details))
        closed = closed.unionByName(large.join(every.where("entry is null").select("file_path"), "file_path", "left_semi").select(*large.columns))
    return rows.unionByName(closed.select(*columns).mapInArrow(unread, ddl))


def _large(spark: SparkSession, every: DataFrame, paths: list[str], ddl: str, details: bool) -> DataFrame:
    """Books of large archives. Each member is a row of its own; a member that describes another one comes to it by a join of their stems."""
    schema = _arrow(spark, ddl)

    def over(batches):
        def found():
            for batch in batches:
                for path, entry, date, content, side, described in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held = [archives.Entry(entry, content, date)] + ([archives.Entry(side, described, date)] if side else [])
                    for hops, fbd, book, more in archives.books_of(held, details=details):
                        yield path, hops, fbd, book, more

        return _handed_on(found(), schema, details)

    every = every.where("entry is not null")
    stem = F.when(F.lower("entry").endswith(".fbd"), F.expr("left(entry, length(entry) - 4)"))
    sides = members(spark, paths, suffixes=(".fbd",), most=MAX_FILE_BYTES).where("entry is not null").select("file_path", stem.alias("stem"), F.col("entry").alias("side"), F.col("content").alias("described"))
    ext = extension(F.col("entry"))
    own = every.where(ext != ".fbd").withColumn("stem", F.substring(F.col("entry"), F.lit(1), F.length("entry") - F.length(ext)))
    return own.join(sides, ["file_path", "stem"], "left").select("file_path", "entry", "date", "content", "side", "described").mapInArrow(over, ddl)


def create(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(files, books) of a new collection: crawled, parsed, one file of each content, and only files that hold a book."""
    from folioscope.operators.maintain import dedup_by_hash

    crawled = crawl(spark, *paths)
    files = dedup_by_hash(files_of(crawled))
    books = parse(crawled).join(files.select("file_path"), "file_path", "left_semi").select(*[x.split()[0] for x in ("file_path", "path_in_file", "fbd_path", "authors", "titles", "sequences", "genres", "dates")])
    return files.join(books.select("file_path"), "file_path", "left_semi"), books


def details_of(spark: SparkSession, file_path: str, path_in_file: list[str] | None = None) -> DataFrame:
    """Details of one book, read from its file; of an archive's books the one at the given place."""
    rows = parse(crawl(spark, file_path), details=True)
    return rows if path_in_file is None else rows.where(F.col("path_in_file") == F.array(*map(F.lit, path_in_file)))


def book_bytes(content: bytes, file_path: str, path_in_file: list[str] | None) -> bytes:
    """Bytes of one book out of its file, hop by hop; an error if a hop isn't there."""
    ext = archives.extension_of(file_path)
    for hop in path_in_file or []:
        content = next((x.content for x in archives.entries(ext, content) if x.path == hop), None)
        if content is None:
            raise FileNotFoundError(posixpath.join(file_path, *path_in_file))
        ext = archives.extension_of(hop)
    return content


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
