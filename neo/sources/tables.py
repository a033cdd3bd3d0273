"""Table sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _is_missing_path(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    name = cond() if cond else None
    return name == "PATH_NOT_FOUND" or "PATH_NOT_FOUND" in str(e)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast every present column (structs field
    by field), add absent ones as typed nulls, drop the rest."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def cast(expr, src, dst):
        if isinstance(dst, T.StructType) and isinstance(src, T.StructType):
            names = {f.name: f.dataType for f in src.fields}
            return F.struct(*[
                (cast(expr.getField(f.name), names[f.name], f.dataType) if f.name in names
                 else F.lit(None).cast(f.dataType)).alias(f.name) for f in dst.fields])
        return expr.cast(dst)

    return df.select(*[
        (cast(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in schema.fields])


def read_table(spark: SparkSession, path: str, schema: T.StructType, conform_types: bool = False) -> DataFrame:
    """Parquet with an explicit schema.

    A missing path gives an empty frame of ``schema``; any other error is
    raised (swallowing them hides type mismatches).  ``conform_types=True``
    reads the files' own types and casts to ``schema`` (for writers that stored
    integers in double columns)."""
    try:
        if conform_types:
            return conform(spark.read.parquet(path), schema)
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if _is_missing_path(e):
            return spark.createDataFrame([], schema)
        raise


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Parquet sink (overwrite by default)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON-lines sink (quarantined messages, result files)."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if _is_missing_path(e):
            return spark.createDataFrame([], schema)
        raise


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names in a folder, in order, and whether each is a folder; none if there is no such
    folder.  One listing of one level, whatever lies below."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that lies below it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it under a hidden name, then renamed over it (atomic on
    HDFS and local disks)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex[:12]}")
    out = at.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)
    files.rename(files.makeQualified(beside), files.makeQualified(at), options)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the folders ``column=value`` directly under ``path``, in order."""
    head = f"{column}="
    return [name[len(head):] for name, folder in children(spark, path) if folder and name.startswith(head)]


def _last_file(spark: SparkSession, path: str) -> str | None:
    """The lexicographically last parquet file under ``path``; only the folders on the way are listed."""
    for name, folder in reversed(children(spark, path)):
        if name.startswith(("_", ".")):
            continue
        if folder:
            below = _last_file(spark, f"{path}/{name}")
            if below:
                return below
        elif name.endswith(".parquet"):
            return f"{path}/{name}"
    return None


def read_latest_file(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Only the lexicographically last parquet file under ``path``."""
    path = path.rstrip("/")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    latest = _last_file(spark, path)
    if latest is None:
        return spark.createDataFrame([], schema if schema is not None else reader.parquet(path).schema)
    return reader.option("basePath", path).parquet(latest)


def read_latest_partition(spark: SparkSession, path: str, column: str = "ingest_date",
                          schema: T.StructType | None = None) -> DataFrame:
    """S8, partitioned variant: only the newest ``column=value`` partition.

    The newest value comes from a listing of the partition folders (one level, no
    data read); the returned frame filters on the partition column, so the scan is
    pruned to that one partition."""
    probe = spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)
    values = [v for v in partition_values(spark, path, column) if v != "__HIVE_DEFAULT_PARTITION__"]
    if not values:
        return spark.createDataFrame([], probe.schema)
    return probe.where(F.col(column) == F.lit(values[-1]).cast(probe.schema[column].dataType))
