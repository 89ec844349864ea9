"""A corpus pipeline over the training-data operators: each stage takes what its predecessor kept.

Defined results, in every stage: an empty table gives an empty one; columns beside those that a stage works on, whatever their
names, are kept as they are (the last stage has its own columns); rows equal in every column share their fate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faithline.llm import bpe, line_dedup, minhash, mixing, quality
from faithline.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, the limits of gross failure and their host's verdict. A null or blank text has too few
    words; a null source is a host like any other; very long texts are judged whole; null ids are judged by their texts."""
    return quality.filtered(docs, quality.STRICT)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; documents of which nothing is left go. Null and blank texts have no such
    line and stay; a null id comes after all others; of two texts under one id the one with the smaller hash comes first."""
    return line_dedup.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on shingles of five words at a similarity of 0.8. Null and blank texts are nobody's
    copies and stay; with fewer words the whole text is the shingle; null ids are compared as exact copies; rows that share an id
    are one document."""
    return minhash.filtered(docs, minhash.Near(words=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the temperature mixture passes its source; at least once, at most about twice. A null source is a
    source; null and blank texts have no tokens and pass once."""
    return mixing.mixed(docs, mixing.Mixture(repetition=2.0))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of what is to be trained on. A null text is the empty one; null ids stay null;
    every row gives one row."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Line dedup within one edit and byte-level BPE have no SQL form; tests/llm checks the whole run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; each result but the last is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
