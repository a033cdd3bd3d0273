"""Folders with unreadable and wrongly typed files."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from neo.sources import files as FI
from pyspark.sql import types as T

SCHEMA = T.StructType().add("id", "string").add("size", "double").add("at", T.StructType().add("x", "double").add("n", "long"))


@pytest.fixture()
def folder(tmp_dir):
    def put(name, sizes, x=pa.float64(), **more):
        n = len(sizes)
        t = pa.table({"id": [f"{name}{i}" for i in range(n)], "size": sizes,
                      "at": pa.array([{"x": i, "n": i} for i in range(n)], pa.struct([("x", x), ("n", pa.int64())])), **more})
        pq.write_table(t, f"{tmp_dir}/{name}.parquet")
    put("good", pa.array([1.5, None], pa.float64()))
    put("more", pa.array([2.5], pa.float64()), extra=["z"])
    put("whole", pa.array([7, 8, 9], pa.int32()), pa.int16())
    put("text", pa.array(["a"], pa.string()))
    put("cut", pa.array([1.0] * 50, pa.float64()))
    with open(f"{tmp_dir}/cut.parquet", "r+b") as f:
        f.truncate(os.path.getsize(f"{tmp_dir}/cut.parquet") - 20)
    # Spark passes over files of no bytes
    open(f"{tmp_dir}/empty.parquet", "w").close()
    pq.write_table(pa.table({"id": ["short one"]}), f"{tmp_dir}/a b%20c.parquet")
    return tmp_dir


def test_good_files_are_read_and_bad_ones_set_aside(spark, folder):
    rows, bad = FI.read_checked(spark, folder, SCHEMA)
    assert rows.schema.simpleString() == SCHEMA.simpleString()
    got = {r["id"]: (r["size"], r["at"] and (r["at"]["x"], r["at"]["n"])) for r in rows.collect()}
    assert got == {"good0": (1.5, (0.0, 0)), "good1": (None, (1.0, 1)), "more0": (2.5, (0.0, 0)), "whole0": (7.0, (0.0, 0)),
                   "whole1": (8.0, (1.0, 1)), "whole2": (9.0, (2.0, 2)), "short one": (None, None)}
    assert {(os.path.basename(r["path"]), r["reason"]) for r in bad.collect()} == {
        ("text.parquet", "size: string, not double"), ("cut.parquet", "unreadable")}


def test_nothing_to_read(spark, tmp_dir):
    rows, bad = FI.read_checked(spark, f"{tmp_dir}/missing", SCHEMA)
    assert rows.schema == SCHEMA and rows.count() == 0 and bad.count() == 0
    with open(f"{tmp_dir}/note.parquet", "w") as f:
        f.write("no table")
    rows, bad = FI.read_checked(spark, tmp_dir, SCHEMA)
    assert rows.count() == 0 and [r["reason"] for r in bad.collect()] == ["unreadable"]


def test_partitioned_folder_and_bad_files_are_pruned(spark, tmp_dir):
    for day in ("2024-01-01", "2024-01-02"):
        os.makedirs(f"{tmp_dir}/day={day}")
        pq.write_table(pa.table({"id": [day], "size": [1.0]}), f"{tmp_dir}/day={day}/p.parquet")
    with open(f"{tmp_dir}/day=2024-01-02/broken.parquet", "w") as f:
        f.write("x" * 100)
    schema = T.StructType().add("id", "string").add("size", "double")
    rows, bad = FI.read_checked(spark, tmp_dir, schema)
    assert sorted(r["id"] for r in rows.collect()) == ["2024-01-01", "2024-01-02"] and bad.count() == 1


@pytest.mark.parametrize("have, want, widen, reason", [
    (T.LongType(), T.LongType(), False, None), (T.IntegerType(), T.LongType(), True, None),
    (T.FloatType(), T.DoubleType(), True, None), (T.LongType(), T.IntegerType(), False, "c: bigint, not int"),
    (T.DoubleType(), T.LongType(), False, "c: double, not bigint"),
    (T.TimestampType(), T.TimestampNTZType(), False, "c: timestamp, not timestamp_ntz")])
def test_types_that_fit(have, want, widen, reason):
    assert FI.misfit(have, want, "c") == (widen, reason)
