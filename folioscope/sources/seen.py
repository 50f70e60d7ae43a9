"""Which hashes a collection has: bit tables that say at once that a hash is new, beside the hashes themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.maintain import current, dedup_by_hash, switch_table, version_name
from folioscope.operators.shared import held

#: Places of a hash in the bit table, and bits of the table for each hash: one hash in about a hundred that isn't there looks as if it were.
PLACES, BITS_A_HASH = 5, 10
#: Bits of one row of the table, as the bitmap functions have it.
ROW_BITS = 1 << 15
#: Rows of the bit table, and hashes, up to which a side of a join is broadcast.
FEW = 50_000


def _places(key: Column, rows: int) -> Column:
    """The places of a hash: the number of a row of the bit table, the same for all of them, and bits in it."""
    row = F.pmod(F.xxhash64(key, F.lit(0)), F.lit(rows))
    bits = F.array(*(F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(ROW_BITS)) for k in range(PLACES)))
    return F.struct(row.alias("row"), bits.alias("bits"))


def build(spark: SparkSession, files: DataFrame, path: str, key: str = "file_hash") -> None:
    """Writes what hashes ``files`` has to the folder ``path``; what was there is replaced when the new one is whole.

    The hashes are sorted, so that few of them are found by reading little. All places of a hash lie in one row of the bit
    table, so a look for a hash touches one row; rows are made by hash, so none is larger than another. Null hashes are left out.
    """
    version = version_name()
    at = f"{path}/{version}"
    own = files.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    rows = max(1, -(-own.count() * BITS_A_HASH // ROW_BITS))
    own.repartitionByRange(max(1, rows // 64), "key").sortWithinPartitions("key").write.parquet(f"{at}/hashes")
    stored = spark.read.parquet(f"{at}/hashes").select(_places(F.col("key"), rows).alias("p")).select("p.row", F.explode("p.bits").alias("bit"))
    stored.groupBy("row").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"), F.lit(rows).cast("long").alias("rows")).write.parquet(f"{at}/bits")
    switch_table(spark, path, version)


def _bit(bits: Column, place: Column) -> Column:
    """Whether a bit of a bitmap is set: of its byte, the lowest bit is the first place."""
    octet = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.expr("1") == F.pmod(F.floor(octet / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2))


def maybe_known(spark: SparkSession, more: DataFrame, path: str, key: str = "file_hash") -> DataFrame:
    """The rows of ``more`` whose hash the bit table doesn't rule out, all known ones among them. The bit table is joined by row: its size is a small part of the hashes'."""
    at = current(spark, path)
    if at is None:
        raise ValueError(f"no hashes at {path}")
    table = spark.read.parquet(f"{at}/bits")
    first = table.select("rows").limit(1).collect()
    if not first:
        return more.where("false")
    asked = more.where(F.col(key).isNotNull()).withColumn("__p", _places(F.col(key), first[0]["rows"]))
    bits = table.select(F.col("row").alias("__row"), F.col("bits").alias("__bits"))
    bits = F.broadcast(bits) if first[0]["rows"] <= FEW // 64 else bits
    met = asked.join(bits, F.col("__p.row") == F.col("__row"))
    return met.where(F.forall("__p.bits", lambda b: _bit(F.col("__bits"), b))).drop("__p", "__row", "__bits")


def known(spark: SparkSession, more: DataFrame, path: str, key: str = "file_hash") -> DataFrame:
    """(key): the hashes of ``more`` that are stored. Only those that the bit table lets through are looked for among the stored ones."""
    asked = held(maybe_known(spark, more, path, key).select(F.col(key).alias("key")).distinct())
    stored = spark.read.parquet(f"{current(spark, path)}/hashes")
    n = asked.count()
    if not n:
        return asked
    low, high = asked.agg(F.min("key"), F.max("key")).first()
    stored = stored.where(F.col("key").between(F.lit(low), F.lit(high)))  # the stored ones are sorted: what lies outside isn't read
    return stored.join(F.broadcast(asked) if n <= FEW else asked, "key", "left_semi")


def additions(spark: SparkSession, more: DataFrame, path: str, key: str = "file_hash") -> DataFrame:
    """The files of ``more`` that a collection whose hashes are stored at ``path`` takes: one of each hash that it doesn't have yet, the smallest path; files without a hash all stay.

    What ``add_files`` adds, if a file that is in the collection wins over an added copy; the collection's own files aren't read.
    """
    own = dedup_by_hash(more, key)
    return own.join(known(spark, own, path, key).withColumnRenamed("key", key), key, "left_anti").select(*more.columns)
