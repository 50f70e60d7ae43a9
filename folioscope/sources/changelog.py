"""Tables that are changed row by row: a base that stays as it is, a log of numbered changes beside it, and both merged when read."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import maintain
from folioscope.operators.catalog import same_place
from folioscope.operators.maintain import current, file_system, stage_table, switch_table

#: The place of a record in a collection.
KEY = ("file_path", "path_in_file")
LOG = "_log"
#: Rows of a log up to which its keys are broadcast; a longer one is joined by a shuffle.
FEW = 200_000
#: Tries of a change that others come before.
TRIES = 20
GONE, SEQUENCE = "__gone", "__sequence"


@dataclass(frozen=True)
class Entry:
    """A change that counts: its number, the folder of its rows, and how many there are."""

    number: int
    folder: str
    rows: int


@dataclass(frozen=True)
class State:
    """What a table is made of now: the folder of its base, the number of the last change that is in it, and the changes after that."""

    base: str
    number: int
    entries: tuple[Entry, ...]

    @property
    def last(self) -> int:
        return self.entries[-1].number if self.entries else self.number


def _text(spark: SparkSession, path: str) -> str:
    at, fs = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, fs = file_system(spark, f"{path}/{LOG}")
    return sorted(int(name) for x in fs.listStatus(at) if (name := x.getPath().getName()).isdigit()) if fs.exists(at) else []


def state(spark: SparkSession, path: str) -> State:
    """Reads the pointer, then the names in the log. An error where there is no table."""
    base = current(spark, path)
    if base is None:
        raise ValueError(f"no table at {path}")
    held = _number(spark, base)
    entries = []
    for n in _numbers(spark, path):
        if n > held:
            folder, rows = _text(spark, f"{path}/{LOG}/{n:020d}").split()
            entries.append(Entry(n, f"{path}/{folder}", int(rows)))
    return State(base, held, tuple(entries))


def _number(spark: SparkSession, base: str) -> int:
    """The number of the last change that a base has in it; 0 where none was written, as no change can be before it."""
    at, fs = file_system(spark, f"{base}/_number")
    return int(_text(spark, f"{base}/_number")) if fs.exists(at) else 0


def number_base(spark: SparkSession, path: str, version: str) -> None:
    """Marks a staged version of a table as one that has all changes so far in it: who rewrites a table as a whole says so before the version is put in place."""
    numbers = _numbers(spark, path)
    _write_text(spark, f"{path}/{version}/_number", str(numbers[-1] if numbers else 0))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def _claim(spark: SparkSession, path: str, number: int, text: str) -> bool:
    """Gives a change its number by a rename that fails where the number is taken. That is the moment from which it counts."""
    _write_text(spark, mine := f"{path}/{LOG}/.{uuid.uuid4().hex}", text)
    (at, fs), (to, _) = file_system(spark, mine), file_system(spark, f"{path}/{LOG}/{number:020d}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), conf).rename(fs.makeQualified(at), fs.makeQualified(to), none)
        return True
    except Exception as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise


def _put_base(spark: SparkSession, path: str, df: DataFrame, number: int) -> None:
    version = stage_table(spark, df, path)
    _write_text(spark, f"{path}/{version}/_number", str(number))
    switch_table(spark, path, version)


def create(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Writes a table anew, with an empty log. Changes that were there before it don't count any more."""
    version = stage_table(spark, df, path)
    number_base(spark, path, version)
    switch_table(spark, path, version)


def _same(a: DataFrame, b: DataFrame, key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & a[c].eqNullSafe(b[c])
    return out


def _latest(spark: SparkSession, found: State, key: tuple[str, ...], test: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, rows): the keys that the log changes, and the rows that they have after it. Of several changes of a key the last one counts, with all its rows."""
    log = None
    for e in found.entries:
        own = spark.read.parquet(e.folder).withColumn(SEQUENCE, F.lit(e.number).cast("long"))
        log = own if log is None else log.unionByName(own)
    log = log if test is None else log.where(test)
    keys = log.groupBy(*key).agg(F.max(SEQUENCE).alias(SEQUENCE))
    few = sum(e.rows for e in found.entries) <= FEW
    keys = F.broadcast(keys) if few else keys
    rows = log.join(keys, _same(log, keys, key) & (log[SEQUENCE] == keys[SEQUENCE]), "left_semi").where(~F.col(GONE)).drop(GONE, SEQUENCE)
    return keys.drop(SEQUENCE), rows


def _merged(spark: SparkSession, found: State, key: tuple[str, ...], test: Column | None = None) -> DataFrame:
    base = spark.read.parquet(found.base)
    base = base if test is None else base.where(test)
    if not found.entries:
        return base
    keys, rows = _latest(spark, found, key, test)
    if sum(e.rows for e in found.entries) <= FEW:
        keys = F.broadcast(keys)
    return base.join(keys, _same(base, keys, key), "left_anti").unionByName(rows.select(*base.columns))


def read(spark: SparkSession, path: str, key: tuple[str, ...] = KEY, test: Column | None = None) -> DataFrame:
    """A table as it is after all its changes: rows of the base whose key no change names, and the rows of each key's last change.

    ``test``, a condition on key columns, is pushed into the scans. The base isn't shuffled while the log is short.
    """
    return _merged(spark, state(spark, path), key, test)


def change(spark: SparkSession, path: str, edit: Callable[[DataFrame], DataFrame], test: Column | None = None, keys: DataFrame | None = None, key: tuple[str, ...] = KEY) -> int:
    """Writes one change and returns its number, 0 if nothing changes.

    ``edit`` makes the new rows out of the rows that a condition on key columns (``test``) or a table of ``keys`` names; rows of
    other keys that it adds are inserted, or replace that key's. Only the named keys' rows are written: those that it leaves and,
    for keys of which it leaves none, a mark. A change counts from the moment its number is taken: one that breaks off before
    leaves nothing that is read. If another comes first, this one is made anew from what that left, so none is lost.
    """
    for _ in range(TRIES):
        found = state(spark, path)
        rows = _merged(spark, found, key, test)
        if keys is not None:
            rows = rows.join(named := keys.select(*key).distinct(), _same(rows, named, key), "left_semi")
        new = edit(rows).select(*rows.columns)
        folder = f"rows-{uuid.uuid4().hex}"
        # a mark for every key that was there: where the edit leaves rows, they come with the same number
        old = rows.select(*key).distinct()
        left = new.select(*key).distinct()
        gone = old.join(left, _same(old, left, key), "left_anti")
        marks = gone.select(*[F.col(c) if c in key else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes], F.lit(True).alias(GONE))
        written = new.withColumn(GONE, F.lit(False)).unionByName(marks)
        written.write.parquet(f"{path}/{folder}")
        count = spark.read.parquet(f"{path}/{folder}").count()
        if not count:
            _remove(spark, f"{path}/{folder}")
            return 0
        if _claim(spark, path, found.last + 1, f"{folder} {count}"):
            return found.last + 1
        _remove(spark, f"{path}/{folder}")
    raise RuntimeError(f"others changed {path} {TRIES} times meanwhile")


def _remove(spark: SparkSession, path: str) -> None:
    at, fs = file_system(spark, path)
    fs.delete(at, True)


def compact(spark: SparkSession, path: str, key: tuple[str, ...] = KEY) -> None:
    """Writes base and log as a new base. Who reads meanwhile sees the old ones or the new one, with the same rows; changes that come meanwhile stay in the log.

    What the base before this one held is removed, as are rows of changes that broke off or are in that base: nobody reads them any more.
    """
    found = state(spark, path)
    if found.entries:
        _put_base(spark, path, _merged(spark, found, key), found.last)
    kept = {e.folder.rsplit("/", 1)[-1] for e in (*found.entries, *state(spark, path).entries)}
    at, fs = file_system(spark, path)
    for n in _numbers(spark, path):
        if n <= found.number:
            _remove(spark, f"{path}/{LOG}/{n:020d}")
    for x in fs.listStatus(at):
        name = x.getPath().getName()
        if name.startswith("rows-") and name not in kept and spark.sparkContext._jvm.System.currentTimeMillis() - x.getModificationTime() > STALE_MS:
            fs.delete(x.getPath(), True)


#: Age from which rows without a number are those of a change that broke off.
STALE_MS = 24 * 3600 * 1000


# The changes of a collection's tables ------------------------------------------------------------------------------------


def edit_book(spark: SparkSession, path: str, file_path: str, path_in_file: list[str] | None, changes: dict[str, Column]) -> int:
    """See ``maintain.edit_book``: only the copies of the book, or the books of the file, are written."""
    own = F.col("file_path") == file_path
    if path_in_file is not None:
        own = own & F.col("path_in_file").eqNullSafe(F.array(*map(F.lit, path_in_file)))
    return change(spark, path, lambda rows: maintain.edit_book(rows, file_path, path_in_file, changes), own)


def remove_book(spark: SparkSession, path: str, file_path: str, path_in_file: list[str] | None = None) -> int:
    """See ``maintain.remove_book``: a mark is written for each place that goes."""
    return change(spark, path, lambda rows: rows.where("false"), maintain.meant(file_path, path_in_file))


def upsert_notes(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """See ``maintain.upsert_notes``."""
    return change(spark, path, lambda rows: maintain.upsert_notes(rows, changes), keys=changes)


def remove_notes(spark: SparkSession, path: str, books: DataFrame) -> int:
    """See ``maintain.remove_notes``."""
    notes = read(spark, path)
    return change(spark, path, lambda rows: rows.where("false"), keys=notes.join(books, same_place(books, notes), "left_semi"))


def add_bookmarks(spark: SparkSession, path: str, more: DataFrame) -> int:
    """See ``maintain.add_bookmarks``: only those that aren't there are written."""
    own = read(spark, path)
    new = more.join(own, _same(more, own, KEY), "left_anti")
    return change(spark, path, lambda rows: maintain.add_bookmarks(rows, new), keys=new)


def remove_bookmarks(spark: SparkSession, path: str, gone: DataFrame) -> int:
    """See ``maintain.remove_bookmarks``."""
    own = read(spark, path)
    kept = maintain.remove_bookmarks(own, gone)
    return change(spark, path, lambda rows: rows.where("false"), keys=own.join(kept, _same(own, kept, KEY), "left_anti"))
