"""Registered queries of the training-data operators and their DuckDB statements.

Each query applies its operator, with the operator's defaults, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neo.llm import (
    conversation,
    decontaminate,
    exact_dedup,
    license_scan,
    near_dedup,
    packing,
    phrases,
    pieces,
    pii,
    quality,
    substring_dedup,
    token_matrix,
    toxicity,
)
from neo.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    return (pii.find(table(spark, sf_dir, "documents"))
            .select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                    pii.joined("spans").alias("spans")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return (toxicity.score(docs, model)
            .select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_hits"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("row1", "row2")


def op6_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.segments(token_matrix.write(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row1", "row2")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("items", "row1", "row2")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")), gone_col="gone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_license_scan, op3_toxicity, op4_best_fit_packing, op5_prob_min_hash,
             op6_token_matrix, op7_exact_dedup, op8_pii, op9_quality, op10_decontaminate, op11_sentence_pieces,
             op12_phrase_mining, op13_conversation_repair)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.ORACLE, "op10_decontaminate": decontaminate.ORACLE,
            "op12_phrase_mining": phrases.ORACLE}
