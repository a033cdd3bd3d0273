"""Helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from neo.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything that is not a word character once A-Z are lower-cased (Java and RE2 syntax).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A numpy pass works on about this many bytes of text at a time, so that its
#: temporary arrays stay small whatever the size of an Arrow batch.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared checkpoint folder and read it back: it cuts the
    lineage, and a lost executor costs no earlier stage."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, size: int):
    """Arrow batches of about so many bytes, and a row at least, while a table is written.

    Spark's own limit is 64 MB: a partition of long rows comes as one batch, and every core
    holds it several times over outside the heap and in its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change letters beyond ASCII)."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """Two numbers, 128 bits, that identify a row's id and text; never null."""
    return [F.xxhash64(F.lit(i), doc_id, F.coalesce(text, F.lit(""))).alias(f"row{i}") for i in (1, 2)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of whole rows of about ``size`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (public domain) on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL string."""
    return to_arrow_schema(StructType.fromDDL(ddl))


_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[0x41:0x5B] += 32


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one blank each: the bytes, each row's offsets in them, its words.

    A row begins with a blank and each of its words is followed by one, so that a blank
    stands on both sides of every word and nothing that is searched for crosses rows."""
    n = len(offsets) - 1
    lead = offsets[:-1] + 2 * np.arange(n)
    trail = offsets[1:] + 2 * np.arange(n) + 1
    text = np.ones(len(data) + 2 * n, bool)
    text[lead] = text[trail] = False
    padded = np.full(len(text), 32, np.uint8)
    padded[text] = data
    word = _IS_WORD[padded]
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[lead] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    seen = np.cumsum(begins)
    plain = np.where(word, _TO_LOWER[padded], 32).astype(np.uint8)[keep]
    rows = np.append(np.cumsum(keep)[lead] - 1, len(plain))
    return plain, rows, seen[trail] - seen[lead]
