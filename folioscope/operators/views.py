"""Sorted views that are kept on disk, read by pages, and filtered by the three-letter parts of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.maintain import current, switch_table, version_name

#: Rows of one part of a view; also the bits of a bitmap of the index.
PART_ROWS = 1 << 15
GRAM = 3
BATCH = 1 << 14


def build(spark: SparkSession, rows: DataFrame, path: str, *order: Column, texts: tuple[str, ...] = (), part_rows: int = PART_ROWS) -> None:
    """Writes ``rows`` in an order (with tie-breaking columns, where it matters) to the folder ``path``; a view that is there is replaced when the new one is whole.

    It has the rows, sorted over parts by ranges of the order, of at most PART_ROWS rows in the mean; the first place and the
    number of rows of each part; and for each text column of ``texts`` an index: for every three letters in a row that occur in its
    lower-case texts, a bitmap of the rows of each part that have them.
    """
    part_rows = min(part_rows, PART_ROWS)
    version = version_name()
    at = f"{path}/{version}"
    parts = max(1, -(-2 * rows.count() // part_rows))
    numbered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows.limit(0).write.parquet(f"{at}/schema")
    numbered.write.partitionBy("part").parquet(f"{at}/rows")
    held = _rows(spark, at)
    held.groupBy("part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{at}/sizes")
    for name in texts:
        grams = held.select("part", "at", F.lower(name).alias("text")).where("text is not null").mapInArrow(_grams, "gram string, part int, at long")
        # a part may have more rows than a bitmap has bits: it has several then
        bits = grams.groupBy("gram", "part", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits.repartitionByRange(max(1, parts // 8), "gram", "part").sortWithinPartitions("gram").write.parquet(f"{at}/index-{name}")
    switch_table(spark, path, version)


def _rows(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{at}/schema").schema.add("at", "long").add("part", "integer")).parquet(f"{at}/rows")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each three letters in a row of each text, once."""
    grams, parts, ats = [], [], []
    for batch in batches:
        for part, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
            grams += own
            parts += [part] * len(own)
            ats += [at] * len(own)
            if len(grams) >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(parts, pa.int32()), pa.array(ats, pa.int64())], names=["gram", "part", "at"])
                grams, parts, ats = [], [], []
    if grams:
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(parts, pa.int32()), pa.array(ats, pa.int64())], names=["gram", "part", "at"])


def _starts(spark: SparkSession, at: str) -> list[tuple[int, int, int]]:
    """(part, first place, rows) of every part, in order: a row a part of PART_ROWS rows."""
    out, before = [], 0
    for r in spark.read.parquet(f"{at}/sizes").orderBy("part").collect():
        out.append((r["part"], before, r["n"]))
        before += r["n"]
    return out


def _at(spark: SparkSession, path: str) -> str:
    at = current(spark, path)
    if at is None:
        raise ValueError(f"no view at {path}")
    return at


def count(spark: SparkSession, path: str) -> int:
    return sum(n for _, _, n in _starts(spark, _at(spark, path)))


def page(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """The rows from place ``first`` (from 1) on, ``n`` at most, in order, with their ``place``. Only the parts that hold them are read; nothing is sorted but they."""
    at = _at(spark, path)
    own = [(part, start) for part, start, size in _starts(spark, at) if start < first - 1 + n and start + size >= first]
    rows = _rows(spark, at).where(F.col("part").isin([part for part, _ in own]))
    start = F.lit(0)
    for part, before in own:
        start = F.when(F.col("part") == part, before).otherwise(start)
    rows = rows.withColumn("place", (F.col("at") + 1 + start).cast("long")).where((F.col("place") >= first) & (F.col("place") < first + n))
    return rows.drop("part", "at").orderBy("place")


def containing(spark: SparkSession, path: str, column: str, text: str) -> DataFrame:
    """Rows of a view whose column contains ``text``, whatever the case: what ``search.filter_contains`` gives.

    The bitmaps of the text's three-letter parts say which parts of the view can have such rows; only those are read, and their
    rows tested. A text of fewer letters, and a column without an index, are looked for in all rows; an empty text changes nothing.
    """
    at = _at(spark, path)
    rows, low = _rows(spark, at).drop("at"), text.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not text:
        return rows.drop("part")
    if grams and _indexed(spark, at, column):
        found = spark.read.parquet(f"{at}/index-{column}").where(F.col("gram").isin(grams))
        both = found.groupBy("part", "bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits")).where((F.col("n") == len(grams)) & (F.bitmap_count("bits") > 0))
        rows = rows.where(F.col("part").isin([r["part"] for r in both.select("part").distinct().collect()]))
    return rows.where(F.contains(F.lower(column), F.lit(low))).drop("part")


def _indexed(spark: SparkSession, at: str, column: str) -> bool:
    from folioscope.operators.maintain import file_system

    where, fs = file_system(spark, f"{at}/index-{column}/_SUCCESS")
    return fs.exists(where)
