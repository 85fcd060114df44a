"""A training corpus from documents: each stage works on all that the one before it kept."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qualm.llm.common import cut, table
from qualm.llm.line_dedup import dedup_lines
from qualm.llm.minhash import keep_one
from qualm.llm.mixing import mix, placed
from qualm.llm.packing import pack_in_order
from qualm.llm.toxicity import drop_toxic

VOCABULARY = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sources stay in their first document alone."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, size=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, interleaved by source."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, numbered in the mixed order. That order is a function of the rows:
    it is computed again, as a written table does not keep its rows' order."""
    at = placed(docs).select("q_row.doc_id", "q_row.text", "q_slot", "q_rank")
    return pack_in_order(at, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Training, tokenizing and scheduling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
