"""Keyed JSON messages.

The broker connectors are thin wrappers around pure ``parse_messages`` /
``encode_messages`` functions, which work on any frame with ``key``/``value``
columns (a file stream in tests; the Kafka connector on a cluster).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neo.functions.timefn import iso_string

CORRUPT = "_corrupt_record"


def read_topic(spark: SparkSession, topic: str, schema: T.StructType, servers: str,
               starting: str = "latest", max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a topic, parsed with ``schema`` (needs the Kafka
    connector on the classpath)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    return parse_messages(r.load(), schema)


def parse_messages(df: DataFrame, schema: T.StructType, value_col: str = "value",
                   keep=("key", "partition", "offset")) -> DataFrame:
    """Decode JSON ``value`` with ``schema`` (PERMISSIVE): the record's fields
    plus ``_corrupt_record`` holding the raw text of undecodable messages.  The
    message coordinates in ``keep`` that the source has (a topic's ``partition``
    and ``offset`` identify a message together) are carried along."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(value_col).cast("string"), full,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    extra = [F.col(c).cast("string") if c == "key" else F.col(c) for c in keep if c in df.columns]
    return df.select(*extra, parsed.alias("__m")).select(*[c for c in keep if c in df.columns], "__m.*")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: split parsed messages into (good records, bad raw messages).  The
    reference stops consuming at the first bad message; here bad ones are set
    aside and the stream goes on."""
    bad = F.col(CORRUPT).isNotNull()
    good = parsed.where(~bad).drop(CORRUPT)
    keep = [c for c in ("key", "partition", "offset") if c in parsed.columns]
    return good, parsed.where(bad).select(*keep, F.col(CORRUPT).alias("raw"))


def stamp_processed(df: DataFrame, now: Column | None = None, col: str = "processed_timestamp") -> DataFrame:
    """Processing time as ISO text (``now`` injectable, default the current time)."""
    now = F.localtimestamp() if now is None else now
    return df.withColumn(col, iso_string(now))


def encode_messages(df: DataFrame, key_col: str | None = None, offset_col: str | None = None,
                    carry=()) -> DataFrame:
    """``key`` (string or null) and ``value`` = the row as JSON text, with
    six-digit ISO timestamps.  ``offset_col`` (e.g. an arrival sequence) is
    carried beside the message as ``offset`` instead of inside it; ``carry``
    columns are kept beside the message as they are."""
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    payload = [F.col(c) for c in df.columns if c != offset_col and c not in carry]
    opts = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    out = [key.alias("key"), F.to_json(F.struct(*payload), opts).alias("value")] + [F.col(c) for c in carry]
    if offset_col:
        out = [F.col(offset_col).alias("offset")] + out
    return df.select(*out)


def publish(df: DataFrame, topic: str, servers: str, checkpoint: str, key_col: str | None = None):
    """S9 sink: keyed JSON to a topic (streaming query, checkpointed)."""
    return (encode_messages(df, key_col).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
