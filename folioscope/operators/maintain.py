"""Dedup, pruning, refresh, edits, bookmarks and notes. Each gives a new DataFrame; ``replace_table`` puts it in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.catalog import same_place


def dedup_by_hash(files: DataFrame, key: str = "file_hash", order: str = "file_path") -> DataFrame:
    """One file of each content hash, the smallest by ``order``; files without a hash all stay.

    A minimum by hash, combined before the shuffle, so that a hash with very many files is no burden to one task; rows of
    null hashes never move. Ties in ``order`` keep one row.
    """
    hashed = files.where(F.col(key).isNotNull())
    row = F.struct(order, *[c for c in files.columns if c != order])
    kept = hashed.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*files.columns), row).alias("r")).select("r.*")
    return kept.unionByName(files.where(F.col(key).isNull()))


def prune_empty(roots: DataFrame, files: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, files) without files that have no book, and roots that then have no file."""
    files = files.join(books.select("file_path"), "file_path", "left_semi")
    return roots.join(files.select("root_path"), "root_path", "left_semi"), files


def classify_refresh(old: DataFrame, now: DataFrame, fast: bool = False) -> DataFrame:
    """(file_path, change): added, vanished, changed or same. ``fast`` compares sizes, else hashes; a missing one counts as changed."""
    field = "file_size" if fast else "file_hash"
    a, b = old.select("file_path", F.col(field).alias("was")), now.select("file_path", F.col(field).alias("is"))
    a, b = a.withColumn("in_old", F.lit(True)), b.withColumn("in_new", F.lit(True))
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "vanished")
        .when(F.col("was").isNotNull() & (F.col("was") == F.col("is")), "same")
        .otherwise("changed")
    )
    return a.join(b, "file_path", "full").select("file_path", change.alias("change"))


def refresh(old_books: DataFrame, changes: DataFrame, parsed: DataFrame) -> DataFrame:
    """Books after a refresh: those of unchanged files as they are (edits stay), and ``parsed`` ones for added and changed files."""
    kept = old_books.join(changes.where("change = 'same'").select("file_path"), "file_path", "left_semi")
    new = parsed.join(changes.where("change in ('added', 'changed')").select("file_path"), "file_path", "left_semi")
    return kept.unionByName(new, allowMissingColumns=True)


def to_parse(changes: DataFrame, now: DataFrame) -> DataFrame:
    """Files that a refresh has to read."""
    return now.join(changes.where("change in ('added', 'changed')").select("file_path"), "file_path", "left_semi")


def add_files(files: DataFrame, more: DataFrame) -> DataFrame:
    """Both, each path once (the old one stays), and one file of each hash."""
    new = more.join(files.select("file_path"), "file_path", "left_anti")
    return dedup_by_hash(files.unionByName(new, allowMissingColumns=True))


def edit_book(books: DataFrame, file_path: str, path_in_file: list[str] | None, changes: dict[str, Column]) -> DataFrame:
    """Every copy of a book with the given fields replaced."""
    test = F.col("file_path") == file_path
    if path_in_file is not None:
        test = test & F.col("path_in_file").eqNullSafe(F.array(*map(F.lit, path_in_file)))
    return books.withColumns({k: F.when(test, v).otherwise(F.col(k)) for k, v in changes.items()})


def clean_authors(authors: Column) -> Column:
    """Author fields as the editor leaves them: empty parts go, then authors without first, middle or last name (so nicknames and whole names alone do)."""
    some = lambda c: F.nullif(c, F.lit(""))
    rebuilt = F.transform(authors, lambda a: F.struct(F.lit(None).cast("string").alias("full"), some(a["last"]).alias("last"), some(a["first"]).alias("first"), some(a["middle"]).alias("middle"), F.lit(None).cast("string").alias("nick")))
    return F.filter(rebuilt, lambda a: F.coalesce(a["last"], a["first"], a["middle"]).isNotNull())


def clean_sequences(sequences: Column) -> Column:
    """Series without a name go; empty numbers become null."""
    rebuilt = F.transform(sequences, lambda s: F.struct(s["full"].alias("full"), F.nullif(s["name"], F.lit("")).alias("name"), F.nullif(s["number"], F.lit("")).alias("number")))
    return F.filter(rebuilt, lambda s: s["name"].isNotNull())


def clean_strings(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def meant(file_path: str, path_in_file: list[str] | None = None) -> Column:
    """Whether a row is of a removed book. A plain file or a rar goes with all its books; so do all books of a rar at any depth of the place; else the one entry goes."""
    own = F.col("file_path") == file_path
    if path_in_file is not None and not file_path.lower().endswith(".rar"):
        rar = next((i for i, hop in enumerate(path_in_file) if hop.lower().endswith(".rar")), None)
        place = F.col("path_in_file")
        if rar is not None:
            own = own & (F.slice(place, 1, rar + 1) == F.array(*map(F.lit, path_in_file[: rar + 1])))
        else:
            own = own & place.eqNullSafe(F.array(*map(F.lit, path_in_file)))
    return F.coalesce(own, F.lit(False))


def remove_book(books: DataFrame, file_path: str, path_in_file: list[str] | None = None) -> DataFrame:
    """Books without a removed one, see ``meant``."""
    return books.where(~meant(file_path, path_in_file))


def _marks(left: DataFrame, right: DataFrame) -> Column:
    return (left["file_path"] == right["file_path"]) & left["path_in_file"].eqNullSafe(right["path_in_file"])


def add_bookmarks(bookmarks: DataFrame, more: DataFrame) -> DataFrame:
    """Inserts the bookmarks whose file and place aren't there yet; repeated new ones once."""
    new = more.dropDuplicates(["file_path", "path_in_file"])
    return bookmarks.unionByName(new.join(bookmarks, _marks(new, bookmarks), "left_anti"), allowMissingColumns=True)


def remove_bookmarks(bookmarks: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the bookmarks of the given books; a book without a place takes all of its file's."""
    test = (bookmarks["file_path"] == gone["file_path"]) & (gone["path_in_file"].isNull() | bookmarks["path_in_file"].eqNullSafe(gone["path_in_file"]))
    return bookmarks.join(gone, test, "left_anti")


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes after ``changes`` (one row a key): a new text replaces the old one or comes in, an empty or null one deletes."""
    kept = notes.join(changes, _marks(notes, changes), "left_anti")
    return kept.unionByName(changes.where("coalesce(note_text, '') <> ''"), allowMissingColumns=True)


def remove_notes(notes: DataFrame, books: DataFrame) -> DataFrame:
    return notes.join(books, same_place(books, notes), "left_anti")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder that holds a table's rows now; None where none has been written."""
    at, fs = file_system(spark, f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return f"{path}/{bytes(stream.readAllBytes()).decode('utf-8')}"
    finally:
        stream.close()


#: The file of a table's folder that names the version to be read.
POINTER = "_current"


def rename_over(spark: SparkSession, old, new) -> None:
    """Renames a file over another one, in one step where the file system can."""
    sc = spark.sparkContext
    options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    conf = sc._jsc.hadoopConfiguration()
    uri = old.getFileSystem(conf).makeQualified(old).toUri()
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf).rename(old, new, options)


def version_name() -> str:
    """The name of a new version's folder, which ``switch_table`` can put in place."""
    return f"version-{uuid.uuid4().hex}"


def stage_table(spark: SparkSession, df: DataFrame, path: str, max_records: int = 0) -> str:
    """Writes a new version beside those that are there; nobody reads it before ``switch_table`` names it."""
    version = version_name()
    df.write.option("maxRecordsPerFile", max_records).parquet(f"{path}/{version}")
    return version


def switch_table(spark: SparkSession, path: str, version: str) -> None:
    """Names a staged version in the pointer, by one rename over the old pointer: a reader sees the old rows or the new ones.

    The version before it stays for those who are reading it; older ones go.
    """
    before = current(spark, path)
    at, fs = file_system(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    out = fs.create(at, True)
    try:
        out.write(bytearray(version.encode("utf-8")))
    finally:
        out.close()
    rename_over(spark, at, file_system(spark, f"{path}/{POINTER}")[0])
    kept = {version, (before or "").rsplit("/", 1)[-1]}
    for found in fs.listStatus(file_system(spark, path)[0]):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in kept:
            fs.delete(found.getPath(), True)


def replace_table(spark: SparkSession, df: DataFrame, path: str, max_records: int = 0) -> None:
    """Replaces a table's rows as a whole; it may be computed from itself, and a failed write leaves it as it is."""
    switch_table(spark, path, stage_table(spark, df, path, max_records))
