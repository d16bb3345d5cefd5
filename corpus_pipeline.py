"""From raw documents to token ids: five stages, each one operator applied to all that its
predecessor kept.

quality rules -> line dedup -> MinHash near-dedup -> benchmark decontamination -> byte-level BPE.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``. Its result is written as Parquet into the shared
folder and read again as the next stage's documents, so a lost executor costs tasks of one stage
only; the tables it no longer needs can be deleted with the folder of the job. All but the last stage return
the columns of ``documents``.

Defined cases are those of the operators: rows without text go in the first stage; rows without doc_id lose no
line and are no one's copy, but may hold an item; of rows repeating a doc_id one stays; an empty table gives an
empty result; very long texts are taken whole; extra columns of documents pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, decontam, lines, near, quality
from sieveline.llm.common import read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above an adaptive cutoff of their language and source go."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, up to a few edits, are cut out of the texts."""
    return lines.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near.filtered(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its error budget, go."""
    return decontam.filtered(docs, read(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids, with a check that they decode to the text."""
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Registers by random processes, edits inside texts and BPE merges have no SQL; tests hold the
#: pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
