"""Unreadable files inside a folder (S1, S3): probed in tasks, set aside, the rest is read.

Spark lists the folder; each task opens its files' footers only (the last bytes), so a probe costs a few
requests a file whatever its size.  A file is read as it is, read with its own types and widened, or
set aside with the reason.  The driver sees names of files that are not read as they are, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from neo.session import scratch_path
from neo.sources.tables import _is_missing_path, conform

#: Types that hold every value of another one, narrowest first.
WIDER = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType())

#: What is known of each file: how it is read, its own types of the wanted columns, why it is set aside.
PROBED = "path string, file string, length long, how string, found string, reason string"

AS_IS, WIDEN, ASIDE = "as is", "widen", "aside"

#: Files whose footers one task reads.
FILES_A_TASK = 256


def open_file(path: str):
    """A file of any file system that Arrow knows (local, HDFS, object stores), opened for random reads."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pa_fs.LocalFileSystem().open_input_file(path)
    fs, at = pa_fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")  # Spark's names are not encoded
    return fs.open_input_file(at)


def _widens(have: T.DataType, want: T.DataType) -> bool:
    if isinstance(have, T.FloatType) and isinstance(want, T.DoubleType):
        return True
    return have in WIDER and want in WIDER and WIDER.index(have) < WIDER.index(want)


def misfit(have: T.DataType, want: T.DataType, at: str) -> tuple[bool, str | None]:
    """Whether a column must be widened, and why it cannot be read at all.  Absent fields of a
    record are read as nulls and further ones are not read."""
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        own, widen = {f.name: f.dataType for f in have.fields}, False
        for f in want.fields:
            if f.name in own:
                more, reason = misfit(own[f.name], f.dataType, f"{at}.{f.name}" if at else f.name)
                if reason:
                    return False, reason
                widen |= more
        return widen, None
    if have.simpleString() == want.simpleString():
        return False, None
    if _widens(have, want):
        return True, None
    return False, f"{at}: {have.simpleString()}, not {want.simpleString()}"


def _footer(path: str, schema: T.StructType, opener: Callable) -> tuple[str, str | None, str | None]:
    """``how, found, reason`` of one file."""
    try:
        with opener(path) as source:
            own = pq.ParquetFile(source).schema_arrow
    except (pa.ArrowException, OSError):
        return ASIDE, None, "unreadable"
    wanted, fields = {f.name: f.dataType for f in schema.fields}, []
    for f in own:
        if f.name in wanted:
            try:
                fields.append(T.StructField(f.name, from_arrow_type(f.type, prefer_timestamp_ntz=True)))
            except Exception as e:  # a type that Spark has no name for
                return ASIDE, None, f"{f.name}: {type(e).__name__}"
    widen, reason = misfit(T.StructType(fields), schema, "")
    if reason:
        return ASIDE, None, reason
    return (WIDEN, T.StructType(fields).json(), None) if widen else (AS_IS, None, None)


def probe(spark: SparkSession, path: str, schema: T.StructType, opener: Callable = open_file) -> DataFrame:
    """One row per file under ``path`` (``PROBED``); no file's rows are read.

    ``path`` is Spark's own name of the file, ``file`` the one that ``opener`` gets.  A missing path and
    an empty folder have no files; Spark passes over files of no bytes, here as in any read.  Damage inside a column chunk does not
    show in a footer and still fails the read."""
    try:
        listed = spark.read.format("binaryFile").load(path).select(
            F.col("_metadata.file_path").alias("path"), F.col("path").alias("file"), "length")
    except AnalysisException as e:
        if _is_missing_path(e):
            return spark.createDataFrame([], PROBED)
        raise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = [_footer(p, schema, opener) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([h[i] for h in how], pa.string()) for i in range(3))],
                names=["path", "file", "length", "how", "found", "reason"])

    # the names are written first: opening a file costs far more than its row, so tasks get equal numbers of files
    names = scratch_path(spark, "files")
    listed.write.parquet(names)
    listed = spark.read.parquet(names)
    return listed.repartition(max(1, -(-listed.count() // FILES_A_TASK))).mapInArrow(run, PROBED)


def read_checked(spark: SparkSession, path: str, schema: T.StructType,
                 opener: Callable = open_file) -> tuple[DataFrame, DataFrame]:
    """S1 with S3 for whole files: the rows of the readable files, as ``schema``, and the files set
    aside (``path, length, reason``).

    Files with narrower numbers are read with their own types and widened, one scan for each set of
    types.  A missing path gives two empty tables."""
    found = scratch_path(spark, "probed")
    probe(spark, path, schema, opener).write.parquet(found)
    files = spark.read.schema(PROBED).parquet(found)
    aside = files.where(F.col("how") == ASIDE).select("path", "length", "reason")
    counts = dict(files.groupBy("how").count().collect())
    if not counts.get(AS_IS) and not counts.get(WIDEN):
        return spark.createDataFrame([], schema), aside
    other = files.where(F.col("how") != AS_IS).select("path", "how", "found").collect()
    at = F.col("_metadata.file_path")

    def scan(types: T.StructType) -> DataFrame:
        return spark.read.schema(types).parquet(path)

    parts = []
    if counts.get(AS_IS):
        rows = scan(schema)
        parts.append((rows.where(~at.isin([r["path"] for r in other])) if other else rows).select(*schema.names))
    for types in sorted({r["found"] for r in other if r["how"] == WIDEN}):
        own = [r["path"] for r in other if r["found"] == types]
        parts.append(conform(scan(T.StructType.fromJson(json.loads(types))).where(at.isin(own)), schema))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows, aside
