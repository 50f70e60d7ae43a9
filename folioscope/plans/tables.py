"""The test tables in the catalogue's model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.hashing import sha256_hex
from folioscope.operators.shared import shared_folder


def scratch(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads again: in the folder for checkpoints, or (none set, and Spark runs in this process alone) a temporary one."""
    return f"{shared_folder(spark)}/folioscope-{uuid.uuid4().hex}"


#: Rows of a table that a task makes files of.
FILES_A_TASK = 1 << 12


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in as many tasks as their number asks for, by their keys: a table of a few dense row groups, whose rows become files, is read by a few tasks only."""
    return rows.repartition(max(1, -(-rows.count() // FILES_A_TASK)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_path, root_path, file_hash hex, file_size): a file for each document."""
    d = table(spark, sf_dir, "documents")
    root = F.concat(F.lit("/lib/"), F.col("source"))
    return d.select("doc_id", F.concat(root, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), root.alias("root_path"), sha256_hex(F.col("text")).alias("file_hash"), F.octet_length("text").cast("long").alias("file_size"))


FILES_SQL = "(SELECT doc_id, concat('/lib/', source, '/', doc_id, '.txt') AS file_path, concat('/lib/', source) AS root_path, sha256(text) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS file_size FROM documents)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each part: whole author names, one title, a numbered series, a genre."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("/lib/part/"), F.col("p_partkey").cast("string"), F.lit(".fb2")).alias("file_path"),
        F.expr("cast(null as array<string>)").alias("path_in_file"),
        F.expr("cast(null as string)").alias("fbd_path"),
        F.expr("array(struct(p_brand as full, cast(null as string) as last, cast(null as string) as first, cast(null as string) as middle, cast(null as string) as nick))").alias("authors"),
        F.array("p_name").alias("titles"),
        F.expr("array(struct(cast(null as string) as full, p_brand as name, cast(p_size as string) as number))").alias("sequences"),
        F.array("p_type").alias("genres"),
        F.expr("cast(array() as array<string>)").alias("dates"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each customer, whose name's parts are an author's last and first name."""
    c = table(spark, sf_dir, "customer")
    author = "array(struct(cast(null as string) as full, split(c_name, '#')[0] as last, split(c_name, '#')[1] as first, c_mktsegment as middle, '' as nick))"
    return c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("/lib/customer/"), F.col("c_custkey").cast("string")).alias("file_path"), F.expr("cast(null as array<string>)").alias("path_in_file"), F.expr(author).alias("authors"), F.array("c_name").alias("titles"))
