"""Tables dealt out by file path when they are written, so that joins by path move nothing."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.maintain import current, file_system, switch_table, version_name

SPEC = "_spec"


def save(spark: SparkSession, df: DataFrame, path: str, buckets: int, key: str = "file_path") -> None:
    """Writes a new version of a table, a sorted file a bucket of its key, and puts it in place of the one before.

    Tables that are to be joined have the same number of buckets. A key with very many rows is one bucket, as it is one task of a
    join; of a collection's tables only the books of one archive share a path.
    """
    version = version_name()
    name = _name(f"{path}/{version}")
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{path}/{version}").saveAsTable(name)
    at, fs = file_system(spark, f"{path}/{version}/{SPEC}")
    out = fs.create(at, True)
    try:
        out.write(bytearray(json.dumps({"schema": df.schema.jsonValue(), "buckets": buckets, "key": key}).encode("utf-8")))
    finally:
        out.close()
    switch_table(spark, path, version)


def _name(folder: str) -> str:
    return f"folioscope_{hashlib.sha256(folder.encode()).hexdigest()[:32]}"


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table as it was dealt out. A session that hasn't written it learns of its buckets from the file beside them."""
    folder = current(spark, path)
    if folder is None:
        raise ValueError(f"no table at {path}")
    name = _name(folder)
    if not spark.catalog.tableExists(name):
        from pyspark.sql.types import StructType

        at, fs = file_system(spark, f"{folder}/{SPEC}")
        stream = fs.open(at)
        try:
            spec = json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(spec["schema"]))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{spec['key']}`) SORTED BY (`{spec['key']}`) INTO {spec['buckets']} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def _equal(a: Column, b: Column) -> Column:
    """Null-safe equality that isn't a key of a join: the tables are dealt out by path alone."""
    return (a.isNull() & b.isNull()) | F.coalesce((a <= b) & (a >= b), F.lit(False))


def with_notes(books: DataFrame, notes: DataFrame) -> DataFrame:
    """See ``catalog.with_notes``; tables with the same buckets are joined where they lie."""
    test = (books["file_path"] == notes["file_path"]) & (books["path_in_file"].isNull() | _equal(books["path_in_file"], notes["path_in_file"]))
    return books.join(notes, test, "left_semi")


def new_bookmarks(bookmarks: DataFrame, more: DataFrame) -> DataFrame:
    """Of ``more`` those that aren't there yet, see ``maintain.add_bookmarks``."""
    test = (more["file_path"] == bookmarks["file_path"]) & _equal(more["path_in_file"], bookmarks["path_in_file"])
    return more.join(bookmarks, test, "left_anti")
