"""Live state (ST3): the newest rows of a stream, kept in its state store.

Each stream holds bounded lists in arrival order, as ``transformWithStateInPandas`` state:
the newest row per planet (W1), the last 1,000 asteroids and the last 100 alerts (W2).  A
list is dealt over ``shards`` by a hash of the arrival, so that neither a busy key nor the one
list of a whole topic is the work of one task; every shard keeps its own newest rows and a
reader merges the shards, at most ``shards * keep`` rows per key.

The state store is the only copy: it is checkpointed with the offsets, so a restart goes on
exactly where it stopped, and readers open its last committed version with the
``statestore`` source.  Nothing is written per batch beside it, no version is
overwritten, and a batch costs what it brings.  With ``ttl_days`` a list that gets no row for so
long is forgotten by the store itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from neo import constants as K
from neo.sources.tables import children
from neo.streaming.landing import _trigger

SHARDS = 8

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 24 * 3600 * 1000
_FORMATS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_FIRST = -(2**63)


class _Newest(StatefulProcessor):
    """The ``keep`` rows of a key that arrived last."""

    def __init__(self, n_order: int, keep: int, ttl_ms: int | None):
        self.order = [f"o{i}" for i in range(n_order)]
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = ", ".join([*(f"{o} long" for o in self.order), "row string"])
        self.rows = handle.getListState("rows", schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()]
        for batch in rows:
            fresh = zip(*(batch[o].tolist() for o in self.order), batch["row"].tolist())
            held = heapq.nlargest(self.keep, [*held, *fresh])
        self.rows.put(held)
        yield pd.DataFrame({"held": [len(held)]})

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State with list variables needs the RocksDB store; it is named while a query starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def live_state(stream: DataFrame, arrival: Sequence[str], keep: int, checkpoint: str, key: str | None = None,
               shards: int = SHARDS, ttl_days: int | None = None, trigger: str = "30 seconds") -> StreamingQuery:
    """ST3: keep the last ``keep`` rows by ``arrival`` (whole numbers such as partition and offset),
    per ``key`` if one is named.  Read them with :func:`read_state`.

    A query with ``ttl_days`` looks for expired lists in batches without rows, one after the other,
    so it never ends by itself: it takes no ``availableNow`` trigger."""
    if ttl_days and trigger in ("availableNow", "once"):
        raise ValueError("lists that expire need a trigger interval")
    order = [F.coalesce(F.col(c).cast("long"), F.lit(_FIRST)).alias(f"o{i}") for i, c in enumerate(arrival)]
    rows = stream.select((F.col(key).cast("string") if key else F.lit("")).alias("key"),
                         F.pmod(F.xxhash64(*arrival), F.lit(shards)).cast("int").alias("shard"), *order,
                         F.to_json(F.struct("*"), _FORMATS).alias("row"))
    ttl_ms = ttl_days * _DAY_MS if ttl_days else None
    held = rows.groupBy("key", "shard").transformWithStateInPandas(
        _Newest(len(order), keep, ttl_ms), "held long", "Update", "ProcessingTime" if ttl_ms else "None")
    w = held.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    with rocksdb(stream.sparkSession):
        return _trigger(w, trigger).start()


def read_state(spark: SparkSession, checkpoint: str, schema: T.StructType, keep: int, keyed: bool = False) -> DataFrame:
    """The rows that :func:`live_state` holds, as of the last committed batch; none before the first."""
    if not any(name.isdigit() for name, _ in children(spark, f"{checkpoint}/commits")):
        return spark.createDataFrame([], schema)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").load()
    item = "list_element"
    if "ttlExpirationMs" in state.schema[item].dataType.names:
        state = state.where(F.col(f"{item}.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
        item += ".value"
    rows = state.select("key.key", f"{item}.*")
    newest = [F.col(c).desc() for c in rows.columns[1:]]
    if keyed:  # a key has at most keep rows in each shard
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(*newest))).where(F.col("place") <= keep)
    else:
        rows = rows.orderBy(*newest).limit(keep)
    return rows.select(F.from_json("row", schema, _FORMATS).alias("r")).select("r.*")


def live_lists(planets: DataFrame, asteroids: DataFrame, alerts: DataFrame, checkpoint_base: str, arrival: Sequence[str],
               trigger: str = "30 seconds") -> list[StreamingQuery]:
    """The dashboard's three lists: the current row per planet, the recent asteroids, the recent alerts."""
    return [live_state(planets, arrival, 1, f"{checkpoint_base}/planets", key="planet", trigger=trigger),
            live_state(asteroids, arrival, K.RECENT_ASTEROIDS, f"{checkpoint_base}/asteroids", trigger=trigger),
            live_state(alerts, arrival, K.RECENT_ALERTS, f"{checkpoint_base}/alerts", trigger=trigger)]
