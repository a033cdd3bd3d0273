"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage works on all that its predecessor kept.  ``run`` writes every stage to the shared
checkpoint folder and reads it back, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neo.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from neo.llm.common import land, row_keys, table

KEYS = ["_neo_row1", "_neo_row2"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", *[k.alias(name) for k, name in zip(row_keys(F.col("doc_id"), F.col("text")), KEYS)])


def _named(decisions: DataFrame) -> DataFrame:
    return decisions.select(*[F.col(k.removeprefix("_neo_")).alias(k) for k in KEYS]).distinct()


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; nothing is shuffled."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; rows that repeat id and text are one."""
    winners = exact_dedup.exact_dedup(docs).filter("kept")
    return _keyed(docs).join(_named(winners), KEYS, "left_semi").dropDuplicates(KEYS).drop(*KEYS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    winners = near_dedup.near_duplicates(docs).filter("kept")
    return _keyed(docs).join(_named(winners), KEYS, "left_semi").dropDuplicates(KEYS).drop(*KEYS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _keyed(docs).join(_named(found), KEYS, "left_anti").drop(*KEYS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("near_dedup", remove_near_copies),
    ("decontaminate", remove_contaminated),
    ("pack", pack),
]

#: Learned scores and hash signatures have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(spark, stage(spark, docs, sf_dir), name)
    return docs
