"""Queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import collocations, decontaminate, language, licenses, line_dedup, main_text, pieces, simhash, spelling, token_counts, toxicity, warc, weighted_sampling
from folioscope.llm.common import crc_mod, read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, with item, edits and place."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences, rules and licences of every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by prototypes learned from the documents of the training folds."""
    docs = read(spark, sf_dir, "documents")
    prototypes = language.learn(docs.where(crc_mod("doc_id", 3) != 1))
    return language.predict(docs, prototypes).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records of every page: two rows a page, the block with its digests; headers as JSON, sorted by name."""
    records = warc.derivatives(warc.responses_of(read(spark, sf_dir, "pages")), key="page_id")
    return records.withColumn("headers", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, at 3 or fewer differing bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), width=3)


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return weighted_sampling.with_edits(read(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return pieces.encode_decode(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a classifier learned outside the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    return toxicity.predict(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, how many went, and a digest of what stays."""
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return main_text.extract(pages, main_text.learn(pages))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language, by how much more often their words stand together than apart."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the more frequent word that each is a spelling of, and where its chain of forms ends."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_license_scan, op3_language_id, op4_warc_derivatives, op5_simhash, op6_weighted_sampling, op7_sentencepiece, op8_toxicity, op9_token_counts, op10_line_dedup, op11_main_text, op12_collocations, op13_spelling_variants)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.sql(), "op10_line_dedup": line_dedup.sql(), "op12_collocations": collocations.sql()}
