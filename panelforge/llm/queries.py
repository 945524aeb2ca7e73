"""The registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import alignment, decontaminate, kneser_ney, language_id, mixing, quality_rules, simhash, suffix_dedup, token_counts, token_files, toxicity, vector_codes, wrappers
from panelforge.llm.common import table

TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def fold(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo; a null doc_id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the 50-byte strings of smaller documents, with a digest of what is left."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; a null text has size 0 and gives none."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null and empty texts have fingerprint zero."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark item that it contains; null texts contain none."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept; null and empty texts are not."""
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold; a null doc_id is in fold 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    return toxicity.toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and verdict of every document; null texts fail the base rules."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null html gives an empty text."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold; und without a letter."""
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(fold(3) != 1))
    return language_id.identify(docs, net).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of every document stand in the files, read back; null texts hold the end id."""
    path = token_files.new_path(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.token_digests(spark, path)


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between two tokenizers; null texts have none."""
    a, b = public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    return alignment.align(table(spark, sf_dir, "documents"), a, b, digests=True)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding with finite components, and the error of its label."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has over 512 tokens; null texts have none."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline on the whole documents table."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_simhash": op3_simhash,
        "op4_decontaminate": op4_decontaminate,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_wrappers": op8_wrappers,
        "op9_language_id": op9_language_id,
        "op10_token_files": op10_token_files,
        "op11_align_tokenizers": op11_align_tokenizers,
        "op12_vector_codes": op12_vector_codes,
        "op13_token_counts": op13_token_counts,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": decontaminate.oracle(), "op7_quality_rules": quality_rules.oracle(), "op12_vector_codes": vector_codes.oracle()}
