"""Landing raw messages as parquet (S4, ST1).

The reference buffers rows in memory (100 per topic, 10 for alerts, flush on a
date change or every five minutes) and loses the buffer on a crash.  Here each
topic is one streaming query: the trigger interval replaces the timer and
``maxOffsetsPerTrigger`` on the source replaces the buffer size.  A micro-batch is read
once and goes to two sinks, records and undecodable messages.

* Records lie under ``raw/ingest_date=<day of arrival>/batch=<id>``.  The time of arrival is that of the
  micro-batch, which the offset log keeps, so a batch that is run again replaces exactly its own folders:
  nothing is landed twice, also when the second run is on the next day.
* ``compact`` rewrites the batches of a day, as far as the query has committed them, into files
  of the advisory size.  A manifest file per day, replaced by rename, names the last batch that
  they cover; ``read_landed`` takes those files and the batches after it.  Folders that the version
  before had covered are deleted, so a day holds two versions at most and what has come since.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from neo.functions.timefn import to_ntz
from neo.sources import tables as TB
from neo.sources.messages import parse_messages, quarantine, stamp_processed


def with_ingest_date(df: DataFrame, ts_col: str = "timestamp", out: str = "ingest_date") -> DataFrame:
    """Partition column: the calendar date of the observation."""
    return df.withColumn(out, F.to_date(to_ntz(df, ts_col)))


def _trigger(w, trigger):
    if trigger == "availableNow":
        return w.trigger(availableNow=True)
    if trigger == "once":
        return w.trigger(once=True)
    return w.trigger(processingTime=trigger)


def land_stream(df: DataFrame, path: str, checkpoint: str, trigger: str = "5 minutes",
                partition_by: str | None = "ingest_date", fmt: str = "parquet",
                query_name: str | None = None) -> StreamingQuery:
    """Append a stream to a file table (exactly-once through the checkpoint)."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(partition_by)
    if query_name:
        w = w.queryName(query_name)
    return _trigger(w, trigger).start(path)


@dataclass
class Topic:
    name: str
    schema: T.StructType
    trigger: str = "5 minutes"


def default_topics() -> dict:
    """The three topics with their schemas; alerts land on a shorter trigger
    (the reference flushes alerts every 10 rows, other topics every 100)."""
    from neo import schemas as S

    return {"asteroid-data": Topic("asteroid-data", S.ASTEROID_LANDING, "1 minute"),
            "planet-data": Topic("planet-data", S.PLANET, "5 minutes"),
            "collision-alerts": Topic("collision-alerts", S.ALERT, "10 seconds")}


def _land_batch(batch: DataFrame, batch_id: int, base: str) -> None:
    """Both sinks of one micro-batch, each replacing only this batch's folders."""
    rows = batch.withColumn("batch", F.lit(batch_id)).persist()
    try:
        good, bad = quarantine(rows)
        (good.drop("key", "partition", "offset").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("ingest_date", "batch").parquet(f"{base}/raw"))
        keep = [c for c in ("key", "partition", "offset") if c in rows.columns]
        (bad.select(*keep, "raw", F.lit(batch_id).alias("batch")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(f"{base}/quarantine"))
    finally:
        rows.unpersist()


def land_topic(messages: DataFrame, topic: Topic, base_path: str, checkpoint_base: str,
               trigger: str | None = None, now: Column | None = None) -> StreamingQuery:
    """ST1 for one topic: parse -> stamp -> land good and bad messages from one read.  ``now``
    replaces the time of arrival."""
    now = F.localtimestamp() if now is None else now
    rows = stamp_processed(parse_messages(messages, topic.schema), now).withColumn("ingest_date", F.to_date(now))
    base = f"{base_path}/{topic.name}"
    w = (rows.writeStream.option("checkpointLocation", f"{checkpoint_base}/{topic.name}")
         .foreachBatch(lambda batch, i: _land_batch(batch, i, base)))
    return _trigger(w, trigger or topic.trigger).start()


def continuous_landing(streams: dict, topics: dict | None, base_path: str, checkpoint_base: str,
                       trigger: str | None = None, now: Column | None = None) -> list[StreamingQuery]:
    """ST1: one query per topic.  ``streams`` maps a topic name to its message frame (``key``, ``value``,
    ``offset``), e.g. from :func:`neo.sources.messages.read_topic`; ``topics`` defaults to
    :func:`default_topics`."""
    topics = topics or default_topics()
    return [land_topic(msgs, topics[name], base_path, checkpoint_base, trigger, now) for name, msgs in streams.items()]


def _manifest(spark: SparkSession, raw: str) -> dict[str, int]:
    """The last compacted batch of each compacted day."""
    if not TB.children(spark, f"{raw}-manifest"):
        return {}
    return {r["day"]: r["upto"] for r in spark.read.schema("day string, upto long").json(f"{raw}-manifest").collect()}


def _after(covered: dict[str, int]) -> Column:
    """Whether a batch came after the compacted ones of its day; partition columns only, so folders are pruned."""
    upto = F.lit(-1)
    if covered:
        days = F.create_map(*[F.lit(x) for pair in covered.items() for x in pair])
        upto = F.coalesce(F.element_at(days, F.col("ingest_date").cast("string")), F.lit(-1))
    return F.col("batch") > upto


def read_landed(spark: SparkSession, raw: str, schema: T.StructType) -> DataFrame:
    """Records of a landed topic with ``ingest_date``: compacted files and the batches after them."""
    full = T.StructType(schema.fields + [T.StructField("batch", T.LongType()), T.StructField("ingest_date", T.DateType())])
    covered = _manifest(spark, raw)
    rows = TB.read_table(spark, raw, full).where(_after(covered)).drop("batch")
    if covered:
        paths = [f"{raw}-compacted/ingest_date={day}/upto={upto}" for day, upto in covered.items()]
        full = T.StructType(schema.fields + [T.StructField("ingest_date", T.DateType())])
        rows = rows.unionByName(spark.read.schema(full).option("basePath", f"{raw}-compacted").parquet(*paths).drop("upto"))
    return rows


def compact(spark: SparkSession, base_path: str, topic: Topic, checkpoint_base: str, day: str) -> int | None:
    """Rewrite what a topic landed on ``day`` in files of the advisory size; the last batch they cover, or
    none if there is nothing new.  Safe beside the running query: only committed batches are taken."""
    raw = f"{base_path}/{topic.name}/raw"
    commits = [int(n) for n, _ in TB.children(spark, f"{checkpoint_base}/{topic.name}/commits") if n.isdigit()]
    landed = [int(b) for b in TB.partition_values(spark, f"{raw}/ingest_date={day}", "batch")]
    before = _manifest(spark, raw).get(day, -1)
    new = [b for b in landed if before < b <= max(commits, default=-1)]
    if not new:
        return None
    upto = max(new)
    rows = spark.read.schema(topic.schema).parquet(*[f"{raw}/ingest_date={day}/batch={b}" for b in new])
    done = f"{raw}-compacted/ingest_date={day}"
    if before >= 0:
        rows = rows.unionByName(spark.read.schema(topic.schema).parquet(f"{done}/upto={before}"))
    rows.hint("rebalance").write.mode("overwrite").parquet(f"{done}/upto={upto}")
    TB.replace_text(spark, f"{raw}-manifest/{day}.json", json.dumps({"day": day, "upto": upto}))
    for b in landed:  # readers that found the version before still find all they read
        if b <= before:
            TB.remove(spark, f"{raw}/ingest_date={day}/batch={b}")
    for v in TB.partition_values(spark, done, "upto"):
        if int(v) not in (before, upto):
            TB.remove(spark, f"{done}/upto={v}")
    return upto
