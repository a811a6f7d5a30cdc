"""The corpus pipeline: each stage works on what the one before it kept.

Defined cases, in every stage: the columns of docs are kept whatever their names, but for doc_id and text they aren't read
(source is evidence of language, lang labels its training sample); an empty table gives an empty table. A null text is an empty
one and has no accepted language, so it goes with the first stage. Rows without a doc_id are kept by the first stage and the
fourth; of equal texts they lose against rows with one, and they are linked with nothing. Repeated rows stay once from the second
stage on. A very long text is one row of every stage, read in pieces or held whole by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermaline.llm import common, op2_byte_bpe, op3_decontaminate, op7_exact_dedup, op8_language_id, op10_jaccard_join


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an accepted language."""
    return op8_language_id.accept(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of equal texts, the largest doc_id."""
    return op7_exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links: five-word shingles, similarity of 0.8 or more, the smallest doc_id."""
    return op10_jaccard_join.dedup(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return op3_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian, four bytes each)."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = op2_byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256", "ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("decontamination", decontaminate), ("byte_bpe", tokens)]
#: Likelihoods, near duplicates and merges are no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
