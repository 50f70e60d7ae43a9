"""The corpus pipeline: five stages over ``documents``, each reading what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, line_dedup, near_text, pieces, toxicity
from folioscope.llm.common import crc_mod, ensure_checkpoint_dir, read, remove


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity; the classifier learns from the labels outside the held-out fold.

    Rows are judged one by one, so repeated ones share their fate. Null, empty and wordless texts score low and stay, and so
    does everything where no label says toxic.
    """
    labels = read(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    return docs.where(toxicity.scorer(model)(F.col("text").cast("string")) < 0.5)


def lines_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines they share with earlier ones; one that loses all its text goes. ``n_chars`` follows the text.

    Null and empty texts and rows of a null id stay as they are; of exact copies the one of the smallest id stays, or, with the same id, all.
    """
    own = {c: f"__fs_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.deduplicated(docs.withColumnsRenamed(own))
    left = (F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.where(left).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group that pairs of Jaccard similarity 0.8 or more (sets of five-word shingles) join.

    Rows are told apart by id and text, so different texts of one id have fates of their own; of a repeated row one stays.
    Wordless, empty and null texts are one group. Null ids come last.
    """
    return near_text.one_of_each(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text. Null and empty texts stay; repeated rows share their fate; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and digests of ids and decoded text of every row; a null text counts as empty, repeated rows and null ids stay."""
    return pieces.encode_decode(docs, window_chars=1 << 19, cache_chunks=60_000)  # little memory, as executors have grown in the stages before


STAGES = [("toxicity", toxic_out), ("line dedup", lines_deduplicated), ("simhash near-dedup", one_of_each), ("decontamination", leaks_out), ("sentencepiece", encoded)]

#: Training, fingerprints, alignments and the vocabulary are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Each result is written as Parquet in the shared checkpoint folder and read again; the one before it goes then."""
    docs, folder = read(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
