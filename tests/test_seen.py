"""Files added by stored hashes are those that a dedup of everything would take."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators.maintain import add_files
from folioscope.sources import seen

FILES = "file_path string, file_hash binary"


def rows_of(spark, ks):
    return spark.createDataFrame([(f"{'z' if k % 2 else 'a'}/{k}", None if k % 17 == 0 else hashlib.sha256(str(k % 3000).encode()).digest()) for k in ks], FILES)


def test_additions_are_those_of_the_whole(spark, tmp_path):
    path = str(tmp_path / "hashes")
    own, more = rows_of(spark, range(4000)), rows_of(spark, range(3500, 8000, 3))
    with pytest.raises(ValueError):
        seen.additions(spark, more, path)
    seen.build(spark, own, path)
    fresh = spark.createDataFrame([(f"n/{k}", hashlib.sha256(f"new {k % 900}".encode()).digest()) for k in range(1000)], FILES)
    more = more.unionByName(fresh)
    got = sorted(r["file_path"] for r in seen.additions(spark, more, path).collect())
    hashes = {bytes(r["file_hash"]) for r in own.collect() if r["file_hash"]}
    best, null = {}, []
    for r in more.collect():
        if r["file_hash"] is None:
            null.append(r["file_path"])
        elif bytes(r["file_hash"]) not in hashes:
            best[bytes(r["file_hash"])] = min(best.get(bytes(r["file_hash"]), r["file_path"]), r["file_path"])
    assert got == sorted([*best.values(), *null])
    # the same as the whole dedup, of hashes that the collection doesn't have
    whole = add_files(own.withColumn("file_path", F.concat(F.lit("!"), "file_path")), more)
    assert sorted(r["file_path"] for r in whole.where("file_path not like '!%'").collect()) == got
    assert {bytes(r["key"]) for r in seen.known(spark, more, path).collect()} == {bytes(r["file_hash"]) for r in more.collect() if r["file_hash"]} & hashes


def test_bit_tables_rule_out_most_that_is_new(spark, tmp_path):
    path = str(tmp_path / "hashes")
    own = spark.range(20_000).select(F.col("id").cast("string").alias("file_path"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("file_hash"))
    seen.build(spark, own, path)
    new = spark.range(20_000, 30_000).select(F.col("id").cast("string").alias("file_path"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("file_hash"))
    assert seen.maybe_known(spark, own, path).count() == 20_000
    assert seen.maybe_known(spark, new, path).count() < 400
    seen.build(spark, own.where("false"), path)
    assert seen.additions(spark, new, path).count() == 10_000
