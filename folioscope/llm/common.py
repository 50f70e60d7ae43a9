"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; the default where an operator is given no path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's, the one in ``spark.checkpoint.dir``, or (both unset, and Spark runs in this process alone, as in tests) a new temporary one."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if not found:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = os.path.join(tempfile.gettempdir(), f"folioscope-{uuid.uuid4().hex}")
        sc.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a small table that one task reads.
ROWS_A_TASK = 1 << 15


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage. A lost executor costs no recomputation from the start."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_small(df: DataFrame) -> DataFrame:
    """The same for rows of a few numbers, read again by a task for each ROWS_A_TASK of them: what is small after a wide shuffle goes on in few tasks and files."""
    held = cut(df)
    return held.coalesce(max(1, -(-held.count() // ROWS_A_TASK)))


def hand_back() -> None:
    """Freed memory goes back to the machine: this process lives on beside others."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def clean_up(spark: SparkSession) -> None:
    """Has the driver drop what nothing refers to any more, so that Spark's cleaner removes its shuffle files and checkpoints now, not when the heap happens to fill."""
    hand_back()
    spark.sparkContext._jvm.System.gc()


def tidied(over):
    """A function for ``mapInArrow`` that hands freed memory back when its task ends: workers live on beside those of later stages."""

    def run(batches):
        try:
            yield from over(batches)
        finally:
            hand_back()

    return run


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, m: int):
    """crc32 of the decimal text of an id, modulo ``m``; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % F.lit(m)


def hash_below(column: str, rate: float):
    """True for about ``rate`` of the ids, always the same ones."""
    span = 1 << 30
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(span)) < F.lit(int(min(1.0, rate) * span))
