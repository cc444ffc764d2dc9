"""Corpus pipeline: language, near copies, contamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of documents; the last
returns the digests of the encoded texts.  `run` writes each stage as Parquet in the shared folder and reads it back; a stage's table
is removed once the next one is written.

Defined results, for every stage: a null doc_id, lang, source or n_chars is carried along; further columns of documents are left out
before the first stage, so their names can't clash; an empty table gives an empty result; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm import bpe, byte_cnn, decontaminate, jaccard_join, secret_scan
from quillstrata.llm.common import discard, spool, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Language predictions below this probability are rejected, as are texts without a letter.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language and writes the prediction to lang where lang is null.

    Null texts and texts without a letter go; of languages with equal scores the first by name counts; repeated rows go or stay together."""
    return byte_cnn.keep_known(docs, byte_cnn.train(docs), LEAST_LANGUAGE_SCORE).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of least doc_id, null ids last, of each group of similar texts.

    Texts without words belong to no group and stay; of rows that repeat id and text one stays, that whose other columns come first as JSON."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that benchmark passages contaminate, each row by its own text; texts without words stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and keeps all rows, null texts and repeated rows too; a probability of just 0.5 is a secret."""
    return secret_scan.redact(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; digests of the ids and of what they decode to, a row for each row; a null text is an empty one."""
    import public_tokenizers

    return bpe.report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("near_copies", near_copies), ("contamination", contamination), ("secrets", secrets), ("tokens", tokens)]

#: A trained network and a random forest decide in it, which SQL can't express; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, spool(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return docs
