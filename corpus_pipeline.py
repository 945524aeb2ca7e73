"""From raw documents to token files: five stages, each on what the one before it kept.

Toxic documents go; of near-duplicates one stays; documents that contain benchmark items go; sources
are mixed to target weights, so a document may be left out or taken twice; the mix is written as
token ids and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontaminate, mixing, simhash, token_files, toxicity
from panelforge.llm.common import table, written
from panelforge.llm.queries import TOKENIZER, fold

#: No SQL: two stages are trained or hashed in ways that DuckDB lacks; tests use brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier, trained on labelled rows outside the held-out fold, calls clean.

    Null and empty texts get the bias alone and stay; repeated rows go or stay together; an empty table
    or one without labels keeps everything.
    """
    model = toxicity.fit(docs.where(fold(5) != 0), table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the smallest doc_id of each SimHash component.

    Null and empty texts are near-duplicates of each other; of repeated rows one stays; rows with a null
    doc_id all stay.
    """
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that contain no benchmark item; null texts and items contain nothing and stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as often as the mix takes them, at most twice.

    Null sources are a source of their own. Texts without words weigh nothing: they are repeated or left
    out with their source. Columns named like those that mixing adds pass through.
    """
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what the token files hold.

    A null text holds the end id alone; a null doc_id comes first; a row taken twice is stored twice.
    """
    path = token_files.new_path(spark)
    token_files.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return token_files.token_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
