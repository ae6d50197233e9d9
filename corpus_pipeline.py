"""A corpus pipeline over ``documents``: quality, near duplicates, contamination, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oriel.llm.common import drop_folders, folder_mark, table, written
from oriel.llm.decontaminate import keep_clean
from oriel.llm.mixing import mixture
from oriel.llm.order_minhash import keep_representatives
from oriel.llm.quality import keep_good
from oriel.llm.tokens import token_output


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the lowest doc_id, of each group of near duplicates."""
    return keep_representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes any of their words: not at all, once or twice.

    A document of which the mix takes over its size in words stands twice; a source's last document
    may be taken in part and then stands whole, as the next stage works on whole texts.
    """
    return mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixture", mixture_stage),
    ("token ids", token_stage),
]

#: Learned vocabularies and hashes decide several stages; they are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result but the last is written, and what a stage wrote on its way is then removed."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        mark = folder_mark()
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage{number}")
            drop_folders(mark, keep=1)
    return docs
