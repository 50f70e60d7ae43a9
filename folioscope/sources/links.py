"""A crawl that tells directories, links and files apart: directories are listed side by side, level by level, and none twice."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.paths import supported
from folioscope.operators.shared import held

#: Bytes of a file that are hashed at a time.
PIECE = 1 << 22
#: Directories that a task lists.
DIRS_A_TASK = 64
FOUND = "root_path string, root_kind string, path string, link_path string, kind string, real string, file_size long, modified double"
FILE = "file_path string, root_kind string, root_path string, link_path string, file_size long, modified timestamp"
_TYPES = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def look(root: str, root_kind: str, path: str) -> tuple | None:
    """What stands at a path: (see FOUND). A link to a file is that file, with the link's path; one to a directory is a directory. None for nothing, broken links and what can't be asked."""
    try:
        link = path if os.path.islink(path) else None
        real = os.path.realpath(path, strict=True)
        if os.path.isdir(real):
            return root, root_kind, path, link, "dir", real, None, None
        if os.path.isfile(real):
            s = os.stat(real)
            return root, root_kind, real if link else path, link, "file", real, s.st_size, s.st_mtime
    except OSError:
        pass
    return None


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the directories of (root_path, root_kind, path); a directory that may not be read has none."""
    for batch in batches:
        for root, root_kind, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                with os.scandir(path) as entries:
                    names = sorted(x.path for x in entries)
            except OSError:
                continue
            rows = [x for x in (look(root, root_kind, p) for p in names) if x]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def crawl_links(spark: SparkSession, *paths: str) -> DataFrame:
    """(see FILE): supported files under the given directories, links and files of a mounted file system.

    ``root_kind`` says what the given path is: ``dir`` (a link to a directory too), ``symlink`` (a link to a file) or ``file``.
    ``link_path`` is the link at which a file was met, whose ``file_path`` is the link's target then; null without one. Links to
    directories are followed, and each directory is listed once for each given path, by its real place and under its smallest
    path, so loops end. Missing paths, broken links and directories that may not be read are passed over; a file that is met in
    several ways is there with each link that names it.

    Directories of one level are listed side by side; what has been listed is a table in the shared folder, not on the driver.
    """
    roots = []
    for p in dict.fromkeys(os.path.abspath(x) for x in paths):
        if (found := look(p, "", p)) is not None:
            kind = "dir" if found[4] == "dir" else "symlink" if found[3] else "file"
            # a link that was given is itself the root, its target's files are met in it and not by it
            roots.append((p, kind, *found[2:3], None if kind == "dir" else found[3], *found[4:]))
    level = spark.createDataFrame(roots, FOUND)
    seen, every = None, []
    while True:
        level = held(level)
        every.append(level.where("kind = 'file'"))
        dirs = level.where("kind = 'dir'").groupBy("root_path", "root_kind", "real").agg(F.min("path").alias("path"))
        if seen is not None:
            dirs = dirs.join(seen, ["root_path", "real"], "left_anti")
        dirs = held(dirs)
        n = dirs.count()
        if not n:
            break
        own = dirs.select("root_path", "real")
        seen = own if seen is None else held(seen.unionByName(own))
        tasks = max(1, -(-n // DIRS_A_TASK))
        level = dirs.repartition(tasks, "real").select("root_path", "root_kind", "path").mapInArrow(_listed, FOUND)
    files = every[0]
    for x in every[1:]:
        files = files.unionByName(x)
    rows = files.where(supported(F.col("path"))).select(F.col("path").alias("file_path"), "root_kind", "root_path", "link_path", "file_size", F.timestamp_seconds("modified").alias("modified"))
    return rows.distinct()


def with_content(crawled: DataFrame, most: int | None = None) -> DataFrame:
    """(file_path, root_path, file_size, modified, content) for ``ingest.parse``: each file of a crawl once, read by the task that has it. Files of more than ``most`` bytes (``ingest.MAX_FILE_BYTES``) and those that can't be read have null content."""
    from folioscope.sources import ingest

    limit = ingest.MAX_FILE_BYTES if most is None else most

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content = None
                try:
                    if batch.column(2)[k].as_py() <= limit:
                        with open(batch.column(0)[k].as_py(), "rb") as f:
                            content = f.read()
                except OSError:
                    pass
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([content], pa.binary())], names=[*batch.schema.names, "content"])

    one = crawled.groupBy("file_path").agg(F.min("root_path").alias("root_path"), F.max("file_size").alias("file_size"), F.max("modified").alias("modified"))
    return one.mapInArrow(over, "file_path string, root_path string, file_size long, modified timestamp, content binary")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of files of any size, a piece at a time."""
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            try:
                h = hashlib.blake2b(digest_size=32)
                with open(path, "rb") as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                out.append(h.digest())
            except OSError:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file_path", "file_hash"])


def create(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(files, books) of a new collection on a mounted file system, as ``ingest.create`` makes them, with kinds of roots and links told apart and hashes of files of any size."""
    from folioscope.operators.maintain import dedup_by_hash
    from folioscope.schema import BOOKS
    from folioscope.sources import ingest

    crawled = held(crawl_links(spark, *paths))
    files = dedup_by_hash(files_of(crawled, hashes=True))
    columns = [f.name for f in spark.createDataFrame([], BOOKS).schema]
    books = ingest.parse(with_content(crawled)).join(files.select("file_path"), "file_path", "left_semi").select(*columns)
    return files.join(books.select("file_path"), "file_path", "left_semi"), books


def files_of(crawled: DataFrame, hashes: bool = False) -> DataFrame:
    """A collection's ``files`` (see ``schema.FILES``) of such a crawl: a file that several links name is one row, with the first link, or none where it is met by itself."""
    first = F.min(F.struct(F.col("link_path").isNotNull().alias("linked"), "root_path", "root_kind", "link_path", "file_size")).alias("x")
    rows = crawled.groupBy("file_path").agg(first)
    if not hashes:
        return rows.select("file_path", "x.root_kind", "x.root_path", "x.link_path", F.lit(None).cast("binary").alias("file_hash"), "x.file_size")
    rows = held(rows)
    own = rows.select("file_path").mapInArrow(_hashed, "file_path string, file_hash binary")
    return rows.join(own, "file_path").select("file_path", "x.root_kind", "x.root_path", "x.link_path", "file_hash", "x.file_size")
