"""INPX catalogues: zip files of ``.inp`` lists, a record a line, fields ended by character 4."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.paths import extension
from folioscope.sources import charset
from folioscope.sources.members import members

FIELD = "\x04"
#: Lines that a task hands on at a time.
LINES = 1 << 14
# Places of a record's fields.
AUTHORS, GENRES, TITLE, SERIES, NUMBER, STEM, EXTENSION, DATE = 0, 1, 2, 3, 4, 5, 9, 10


def _field(parts: Column, i: int) -> Column:
    """A field that is ended, else null: what follows the last end is no field."""
    return F.when(F.size(parts) > i + 1, F.get(parts, F.lit(i)))


def ended(text: Column, separator: str) -> Column:
    """Items that are ended by the separator; the rest behind the last one is lost, empty items go."""
    parts = F.split(text, separator)
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def parse_authors(field: Column) -> Column:
    """Authors of ``Last,First,Middle:`` lists. A part counts only if a comma ends it; authors without parts go."""
    some = lambda p, i: F.when(F.size(p) > i + 1, F.nullif(F.get(p, F.lit(i)), F.lit("")))

    def one(text: Column) -> Column:
        p = F.split(text, ",")
        null = F.lit(None).cast("string")
        return F.struct(null.alias("full"), some(p, 0).alias("last"), some(p, 1).alias("first"), some(p, 2).alias("middle"), null.alias("nick"))

    every = F.transform(ended(F.coalesce(field, F.lit("")), ":"), one)
    return F.filter(every, lambda a: F.coalesce(a["last"], a["first"], a["middle"]).isNotNull())


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Books of INPX records, other columns kept in front. A record without title, file or extension makes none; one cut before the extension has no place in its file.

    Column expressions only.
    """
    parts = F.split(F.col(column), FIELD)
    f = lambda i: F.nullif(_field(F.col("__p"), i), F.lit(""))
    rows = lines.withColumn("__p", parts)
    # A field that is there but empty ends the record for title, file and extension; one that isn't there does not.
    for i in (TITLE, STEM, EXTENSION):
        rows = rows.where(~F.coalesce(_field(F.col("__p"), i) == "", F.lit(False)))
    rows = rows.where(F.size("__p") > 1)
    null = F.lit(None).cast("string")
    series = F.when(f(SERIES).isNotNull() & _field(F.col("__p"), NUMBER).isNotNull(), F.array(F.struct(null.alias("full"), f(SERIES).alias("name"), f(NUMBER).alias("number"))))
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        *[c for c in lines.columns if c != column],
        F.when(f(EXTENSION).isNotNull(), F.array(F.concat(F.coalesce(f(STEM), F.lit("")), F.lit("."), f(EXTENSION)))).alias("path_in_file"),
        parse_authors(f(AUTHORS)).alias("authors"),
        one(f(TITLE)).alias("titles"),
        F.coalesce(series, F.array().cast("array<struct<full:string,name:string,number:string>>")).alias("sequences"),
        ended(F.coalesce(f(GENRES), F.lit("")), ":").alias("genres"),
        one(f(DATE)).alias("dates"),
    )


def lines_in(files: DataFrame) -> DataFrame:
    """(entry, line): ended lines of every ``.inp`` list in the INPX files whose bytes are in ``content``; entry is the list's path without its extension."""

    def over(batches):
        for batch in batches:
            for x in batch.column(0):
                names, lines = [], []
                try:
                    with zipfile.ZipFile(io.BytesIO(x.as_py() or b"")) as z:
                        for info in z.infolist():
                            if info.filename.lower().endswith(".inp"):
                                own = charset.decode(z.read(info)).split("\r\n")[:-1]
                                names += [info.filename[:-4]] * len(own)
                                lines += own
                except zipfile.BadZipFile:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["entry", "line"])

    return files.select("content").mapInArrow(over, "entry string, line string")


def lists_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for INPX files by their paths: every list is a task of its own, which reads only the list's range of the file."""

    def over(batches):
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = charset.decode(content or b"").split("\r\n")[:-1]
                for a in range(0, len(own), LINES):
                    part = own[a : a + LINES]
                    yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(part), pa.string()), pa.array(part, pa.string())], names=["entry", "line"])

    return members(spark, paths, suffixes=(".inp",), single=True, most=1 << 31).where("entry is not null").select("entry", "content").mapInArrow(over, "entry string, line string")


def load(spark: SparkSession, path: str, files: DataFrame, books_dir: str) -> DataFrame:
    """Books of an INPX collection (a file, a folder or a pattern of them): see ``matched``."""
    found = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return matched(lists_of(spark, found), files, books_dir)


def matched(lines: DataFrame, files: DataFrame, books_dir: str) -> DataFrame:
    """Each list's records joined with the file of the same relative path without extension (one, the smallest); lists without a file are passed over."""
    base = books_dir.rstrip("/") + "/"
    ext = extension(F.col("file_path"))
    relative = F.expr("substring(file_path, %d)" % (len(base) + 1))
    keyed = files.where(F.startswith("file_path", F.lit(base))).select(F.substring(relative, F.lit(1), F.length(relative) - F.length(ext)).alias("entry"), "file_path")
    one = keyed.groupBy("entry").agg(F.min("file_path").alias("file_path"))
    null = F.lit(None).cast("string")
    return parse_lines(lines.join(one, "entry")).withColumn("fbd_path", null).select("file_path", "path_in_file", "fbd_path", "authors", "titles", "sequences", "genres", "dates")
