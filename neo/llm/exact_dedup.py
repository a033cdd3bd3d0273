"""Exact deduplication with a heavy-hitter split (native DataFrame operations only).

Every text is reduced once to the SHA-256 of its normalised form; only
``(digest, id, length, row keys, row number)`` are written and go on.  A Misra-Gries pass
(``freqItems``: a bounded number of counters per task, merged) proposes the digests that
may hold more than ``support`` of all rows, and an exact count with map-side combine
verifies them.  The verified winners, at most ``1 / support`` rows, are broadcast: rows of
hot groups are decided in the task that reads them and are never shuffled.  All other
groups are smaller than ``support`` of the rows: they are aggregated with map-side combine
and joined back by their digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neo.llm.common import land, row_keys

#: Digests with more than this share of all rows are decided by broadcast.
SUPPORT = 0.002

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row1, row2, n_points, digest, place`` of every row: code points of the original
    text, the SHA-256 of the normalised one, and a number that tells repeated rows apart once
    the table is written."""
    return docs.select(
        F.col(id_col).alias("doc_id"), *row_keys(F.col(id_col), F.col(text_col)),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.sha2(normalise(F.col(text_col)), 256).alias("digest"), F.monotonically_increasing_id().alias("place"))


def winners(rows: DataFrame) -> DataFrame:
    """``digest, group_size, keep_id, best`` (the place of the row that stays) of every digest; a
    null id loses against any other id."""
    best = F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("keep_id"), "place"))
    return (rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("w"))
            .select("digest", "group_size", F.col("w.keep_id").alias("keep_id"), F.col("w.place").alias("best")))


def frequent_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Misra-Gries: every digest that holds more than ``support`` of the rows is in the
    result, which has at most about ``1 / support`` rows; others may be in it too."""
    return rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))


def heavy_winners(seen: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The winners of the digests that are counted to hold more than ``support`` of the rows."""
    total = seen.count()
    maybe = seen.join(F.broadcast(frequent_digests(seen, support)), "digest")
    return land(seen.sparkSession, winners(maybe).filter(F.col("group_size") > support * total), "heavy")


def split(seen: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of heavy digests, already decided, and the other rows; neither is shuffled."""
    return (seen.join(F.broadcast(heavy), "digest"),
            seen.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, row1, row2``.

    Texts are equal when their normalised forms are.  Of equal texts the row with the
    most code points, then the smallest id, is kept.

    Defined results: a null text is empty; empty texts form one group; a null id is a
    document like any other but loses ties; rows that repeat id and text are all
    returned, counted in ``group_size``, and exactly one of them is kept; an empty
    table gives an empty result; further columns of the input are ignored.
    """
    seen = land(docs.sparkSession, digests(docs, id_col, text_col), "digests")
    heavy = heavy_winners(seen, support)
    hot, rest = split(seen, heavy)
    return hot.unionByName(rest.join(winners(rest), "digest")).select(
        "doc_id", "keep_id", "group_size", (F.col("place") == F.col("best")).alias("kept"),
        F.col("digest").alias("text_sha256"), "row1", "row2")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
k AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""
