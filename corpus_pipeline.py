"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starling.llm import bpe, decontaminate, near_copies, quality, secret_scan
from starling.llm._common import outlive, steps, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the isolation forests keep, with all their columns.

    Null and empty texts go, as they have no words. Equal texts are judged alike, repeated rows stay repeated, and a null doc_id has
    no label but is judged. Without labels of both kinds the base rules alone decide; an empty table gives an empty table.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

    That with the smallest doc_id stays, with all its columns; of equal rows one. Texts without words, null ones among them, are
    copies of each other; a component without any doc_id keeps one row. An empty table gives an empty table.
    """
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of the benchmark hit less than a twentieth of the words, with all their columns.

    Null texts and those without words stay, and repeated rows stay repeated. Rows of one doc_id are judged by their own texts. An
    empty table of documents gives an empty one, an empty benchmark keeps all.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blotted out and n_chars after the new text; overlapping secrets give one mark.

    Null and empty texts stay as they are, as do all rows, repeated ones too, and all other columns.
    """
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row left; a null text counts as empty, repeated rows stay repeated."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_removal),
    ("bpe", encoding),
]

#: Training a forest and encoding by merges are beyond SQL; tests/llm/test_pipeline.py checks run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again, and the steps it took are deleted.

    Columns beyond those of documents pass through to the last stage, which returns its own four.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with steps():
            docs = outlive(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
