"""A refresh as a stream: what has come, changed and gone since the last look at a directory, with a state for every share of the paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.sources import changelog

#: A row for every file of a look at the directory, and for every share of paths one without a path that says how many rows (``n``) the look has in it.
SCAN = "scanned_at timestamp, share int, n long, file_path string, file_size long, file_hash binary"
CHANGE = "file_path string, change string"
STATE = "last long, files binary, coming binary"
#: Shares of the paths, by hash: each is one state. A folder's looks and its streams have the same number.
SHARES = 256
_FILES = pa.schema([("at", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("hash", pa.binary())])


def share_of(path, shares: int = SHARES):
    return F.pmod(F.xxhash64(path), F.lit(shares)).cast("int")


def add_scan(files: DataFrame, folder: str, at: datetime | None = None, shares: int = SHARES) -> None:
    """Appends a look at a directory, its files (file_path, file_size, file_hash), to a folder that a stream reads. Looks are told apart by their times, a millisecond at least; a later one has a later time."""
    at = at or datetime.now(timezone.utc)
    stamp = F.timestamp_millis(F.lit(int(at.timestamp() * 1000)))
    own = files.where("file_path is not null").groupBy("file_path").agg(F.max(F.struct("file_size", "file_hash")).alias("x")).select("file_path", "x.*").withColumn("share", share_of(F.col("file_path"), shares))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("file_path", "string"), ("file_size", "long"), ("file_hash", "binary"))]
    every = files.sparkSession.range(shares).select(F.col("id").cast("int").alias("share"))
    sizes = every.join(own.groupBy("share").agg(F.count("*").alias("n")), "share", "left").select("share", F.coalesce("n", F.lit(0)).alias("n"), *none)
    rows = own.select("share", F.lit(None).cast("long").alias("n"), "file_path", "file_size", "file_hash").unionByName(sizes)
    rows.select(stamp.alias("scanned_at"), "share", "n", "file_path", "file_size", "file_hash").write.mode("append").parquet(folder)


def scans(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCAN).parquet(folder)


def _held(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _FILES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _read(octets: bytes | None) -> dict[int, dict[str | None, tuple]]:
    """Files by path, by look; the number of a look's rows stands under no path."""
    out: dict[int, dict[str | None, tuple]] = {}
    if octets:
        for at, path, size, own in zip(*(c.to_pylist() for c in pa.ipc.open_stream(octets).read_all().columns), strict=True):
            out.setdefault(at, {})[path] = (size, own)
    return out


def _table(looks: dict[int, dict[str | None, tuple]]) -> bytes:
    rows = [(at, path, *own) for at, files in looks.items() for path, own in files.items()]
    return _held(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _FILES, strict=True)], schema=_FILES))


def changes(scanned: DataFrame, fast: bool = False) -> DataFrame:
    """(file_path, change): ``added``, ``changed`` or ``vanished`` for every path that isn't as at the look before; ``fast`` compares sizes, else hashes, and a missing one counts as changed.

    The state of a share of the paths is what they were like at the last whole look, and what has come of later ones. A look counts
    in a share as soon as all its rows are there, however many batches they come in; it is then compared with the one before,
    and changes come out look by look. A look that comes again, or late, changes nothing. The states are spread by share and
    kept with the stream's checkpoint; one holds the paths of its share.
    """
    field = 0 if fast else 1

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held, coming = state.get if state.exists else (None, None, None)
        before = _read(held).get(0, {})
        looks = _read(coming)
        for frame in frames:
            for at, n, path, size, own in frame[["at", "n", "file_path", "file_size", "file_hash"]].itertuples(index=False, name=None):
                if last is None or at > last:
                    known = lambda x: None if x is None or pd.isna(x) else int(x)
                    looks.setdefault(at, {})[None if pd.isna(path) else path] = (known(n), None) if pd.isna(path) else (known(size), own)
        out: list[tuple[str, str]] = []
        for at in sorted(looks):
            now = looks[at]
            if None not in now or len(now) - 1 < now[None][0]:
                break  # not all there yet, so later looks wait too
            del looks[at], now[None]
            for path, own in now.items():
                was = before.get(path)
                if was is None:
                    out.append((path, "added"))
                elif own[field] is None or was[field] != own[field]:
                    out.append((path, "changed"))
            out += [(path, "vanished") for path in before if path not in now]
            before, last = now, at
        state.update((last, _table({0: before}), _table(looks)))
        if out:
            yield pd.DataFrame(out, columns=["file_path", "change"])

    rows = scanned.select("share", F.unix_millis("scanned_at").alias("at"), "n", "file_path", "file_size", "file_hash")
    return rows.groupBy("share").applyInPandasWithState(step, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def record(changed: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes changes to a Parquet folder, with the number of their batch; a batch that is repeated after a failure replaces its own rows. With ``once`` it stops when all looks are read."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def follow(changed: DataFrame, books: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps a table of books with a change log (see ``changelog``) up to a stream of changes.

    Books of files that vanished or changed go; those that ``parse`` makes of added and changed files (file_path) come, in one
    change a batch. A batch that is repeated does the same again. Books of other files, edited or not, stay as they are.
    """
    spark = changed.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        own = df.persist()
        try:
            if own.limit(1).count():
                fresh = parse(own.where("change <> 'vanished'").select("file_path"))
                there = changelog.read(spark, books).join(own.select("file_path"), "file_path", "left_semi")
                keys = there.select(*changelog.KEY).union(fresh.select(*changelog.KEY))
                changelog.change(spark, books, lambda rows: rows.where("false").unionByName(fresh, allowMissingColumns=True), keys=keys)
        finally:
            own.unpersist()

    writer = changed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
