"""Registered queries of this subpackage: opN_<name> over whole tables, with DuckDB SQL where it can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, collocations, exact_dedup, line_dedup, minhash, mixing, packing, repair, secrets, simhash, token_count, toxicity
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_report(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_windows(turns, public_tokenizers.path(VOCABULARY)))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_nearest_neighbours, op3_simhash_fingerprints, op4_toxicity, op5_packing,
                                   op6_secret_scan, op7_source_mixing, op8_line_dedup, op9_minhash_near_dedup, op10_chat_windows,
                                   op11_conversation_repair, op12_exact_dedup, op13_collocations)}
ORACLE_SQL = {"op8_line_dedup": line_dedup.REPORT_SQL, "op9_minhash_near_dedup": minhash.NEAR_SQL,
              "op12_exact_dedup": exact_dedup.COPIES_SQL, "op13_collocations": collocations.COLLOCATIONS_SQL}
