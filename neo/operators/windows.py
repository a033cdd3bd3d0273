"""Latest-per-key, last-n and top-k.

"Latest row per key" of narrow rows (W1) is a ``groupBy(key).agg(max_by(row, order))``, not a
``row_number`` window: the aggregate combines on the map side, so a key that
holds a third of all rows still reaches the shuffle as one row per map task,
while a window would sort that whole key inside one task.  Wide rows (W3) are
found by their arrival number first and fetched by a semi-join: the aggregate's
state is two fixed-width fields, so it hashes, and no row's payload is sorted.  Top-k / last-n are
``orderBy().limit()``, planned as ``TakeOrderedAndProject`` (each task keeps k
rows, one task merges k x tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo import constants as K
from neo.session import scratch_path

#: The newest (key, number) pairs are broadcast up to so many bytes, else both sides are shuffled.
BROADCAST_BYTES = 64 << 20

#: What a pair needs in a broadcast table beside the bytes of its key.
PAIR_BYTES = 64


def latest_per_key(df: DataFrame, key: str, order_cols) -> DataFrame:
    """The newest row per ``key`` by ``order_cols`` (later columns break ties);
    keeps every column of ``df``."""
    others = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(c) for c in others])
    order = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*")


def latest_per_planet(planets: DataFrame, order_cols=("timestamp", "processed_timestamp")) -> DataFrame:
    """Current row per planet (a later arrival replaces an earlier one)."""
    return latest_per_key(planets, "planet", order_cols)


def latest_by_number(df: DataFrame, key: str, number: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The row with the largest ``number`` per ``key``; keeps every column of ``df``, in order.

    1. ``max(number)`` per key reads two columns and combines on the map side; the pairs are
       written to the shared checkpoint folder, a few bytes a key.
    2. A semi-join with the pairs fetches the rows.  Up to ``broadcast_bytes`` of pairs are broadcast
       and nothing else is shuffled; beyond that both sides are, the pairs being the hashed side, so the
       rows are not sorted and AQE can split the partition of a hot key.
    3. Only if a key has several rows with its largest number (a record delivered twice) are the
       fetched rows, not the input, reduced to one a key: equal rows are one, of others the least hash stays.

    Defined results: rows without a key are a key of their own; a missing number is smaller than any;
    an empty table gives an empty result.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "newest")
    df.groupBy(F.col(key).alias("_key")).agg(F.max(number).alias("_number")).write.parquet(path)
    newest = spark.read.parquet(path)
    width = F.coalesce(F.octet_length(F.col("_key").cast("string")), F.lit(0)) + PAIR_BYTES
    keys, size = newest.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    pairs = F.broadcast(newest) if size <= broadcast_bytes else newest.hint("shuffle_hash")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(number).eqNullSafe(F.col("_number"))
    rows = df.join(pairs, same, "left_semi")
    if rows.count() == keys:
        return rows
    columns = [F.col(f"`{c}`") for c in df.columns]
    return (rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
            .select("_row.*"))


def latest_per_asteroid(df: DataFrame, number: str = "event_id") -> DataFrame:
    """Current state per asteroid id, by arrival number."""
    return latest_by_number(df, "id", number)


def last_n(df: DataFrame, n: int = K.RECENT_ASTEROIDS, order_cols=("event_id",)) -> DataFrame:
    """The ``n`` most recent rows by arrival (bounded recent list)."""
    return df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)


def top_risk(df: DataFrame, k: int = K.TOP_K_TABLE, prob: str = "enhanced_collision_probability",
             tie_breakers=("id",)) -> DataFrame:
    """The ``k`` riskiest rows (missing probability = 0) with the table
    columns: id, size, distance (missing = 0), probability, risk_level (missing = LOW).
    Ties on probability are broken by ``tie_breakers`` ascending."""
    p = F.coalesce(F.col(prob), F.lit(0.0))
    ranked = df.select(
        "*", p.alias("__p")).orderBy(F.col("__p").desc(), *[F.col(c).asc() for c in tie_breakers]).limit(k)
    return ranked.select(
        "id", "size", F.coalesce(F.col("distance_from_earth"), F.lit(0.0)).alias("distance_from_earth"),
        F.col("__p").alias("collision_probability"),
        F.coalesce(F.col("risk_level"), F.lit("LOW")).alias("risk_level"))


def recent_alerts(alerts: DataFrame, n: int = K.RECENT_ALERT_PANEL) -> DataFrame:
    """The ``n`` newest alerts (alert id breaks ties)."""
    return alerts.orderBy(F.col("timestamp").desc(), F.col("alert_id").asc()).limit(n)
