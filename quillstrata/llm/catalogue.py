"""The queries of this package and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from quillstrata.llm import bpe, byte_cnn, chat_template, decontaminate, jaccard_join, knn_quality, quality_rules, secret_scan, substring, warc
from quillstrata.llm.common import table


def op1_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_classifier(spark, sf_dir):
    return knn_quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_format(spark, sf_dir):
    return chat_template.report(table(spark, sf_dir, "conversations"))


def op7_language_id(spark, sf_dir):
    return byte_cnn.report(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark, sf_dir):
    return substring.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard, op3_quality_rules, op4_byte_bpe, op5_quality_classifier, op6_chat_format, op7_language_id, op8_secret_scan, op9_warc, op10_substring_dedup)}
ORACLE_SQL = {"op1_benchmark_decontamination": decontaminate.SQL, "op2_ngram_jaccard": jaccard_join.SQL, "op6_chat_format": chat_template.SQL, "op9_warc": warc.SQL, "op10_substring_dedup": substring.SQL}
