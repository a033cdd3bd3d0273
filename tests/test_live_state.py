"""ST3: lists in the state store, restarts, shards, expiry."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from neo.streaming import state as LS

SCHEMA = "part long, off long, key string, at timestamp_ntz, v double, pos struct<x: double, y: double>"


def _write(spark, folder, rows, name):
    df = spark.createDataFrame(rows, "part long, off long, key string, v double")
    at = F.to_timestamp_ntz(F.lit("2024-03-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("v"))
    df.select("part", "off", "key", at.alias("at"), "v", F.struct((F.col("v") / 3).alias("x"), F.lit(None).cast("double").alias("y"))
              .alias("pos")).coalesce(1).write.parquet(f"{folder}/{name}")


def _rows(rng, n, first):
    return [(rng.randrange(3), first + i, f"k{min(rng.randrange(9), 4)}", rng.random() * 1000) for i in range(n)]


def _run(spark, tmp_dir, key, keep, checkpoint="ck"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in/*")
    LS.live_state(stream, ["part", "off"], keep, f"{tmp_dir}/{checkpoint}", key=key, shards=3,
                  trigger="availableNow").awaitTermination()


def _state(spark, tmp_dir, keep, keyed, checkpoint="ck"):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = LS.read_state(spark, f"{tmp_dir}/{checkpoint}", schema, keep, keyed).collect()
    return sorted((r.part, r.off, r.key, r.v, r.pos.x) for r in rows)


def _want(rows, keep, keyed):
    out = []
    for k in {r[2] for r in rows} if keyed else {None}:
        out += sorted([r for r in rows if not keyed or r[2] == k], key=lambda r: r[:2])[-keep:]
    return sorted((*r, r[3] / 3) for r in out)


def test_lists_over_batches_and_a_restart(spark, tmp_dir):
    rng = random.Random(1)
    provider = spark.conf.get(LS._PROVIDER, None)
    assert _state(spark, tmp_dir, 5, False) == []
    batches = [_rows(rng, n, 1000 * i) for i, n in enumerate((30, 4, 50))]
    rng.shuffle(batches)  # later files may hold earlier arrivals
    seen = []
    for i, rows in enumerate(batches):
        _write(spark, f"{tmp_dir}/in", rows, f"b{i}")
        seen += rows
        _run(spark, tmp_dir, None, 20)  # every turn goes on from the checkpoint
        _run(spark, tmp_dir, "key", 2, checkpoint="by_key")
        assert _state(spark, tmp_dir, 20, False) == _want(seen, 20, False)
        assert _state(spark, tmp_dir, 2, True, "by_key") == _want(seen, 2, True)
    assert spark.conf.get(LS._PROVIDER, None) == provider
    _run(spark, tmp_dir, None, 20)  # nothing new
    assert _state(spark, tmp_dir, 20, False) == _want(seen, 20, False)


def test_lists_that_expire(spark, tmp_dir):
    rows = _rows(random.Random(2), 12, 0)
    _write(spark, f"{tmp_dir}/in", rows, "b0")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_dir}/in/*")
    with pytest.raises(ValueError):
        LS.live_state(stream, ["part", "off"], 1, f"{tmp_dir}/ck", ttl_days=1, trigger="availableNow")
    q = LS.live_state(stream, ["part", "off"], 1, f"{tmp_dir}/ck", key="key", shards=3, ttl_days=1, trigger="1 second")
    try:
        until = time.time() + 90
        while not os.path.exists(f"{tmp_dir}/ck/commits/0") and time.time() < until and q.isActive:
            time.sleep(0.5)
    finally:
        q.stop()
    assert _state(spark, tmp_dir, 1, True) == _want(rows, 1, True)
    state = spark.read.format("statestore").option("path", f"{tmp_dir}/ck").option("stateVarName", "rows").load()
    left = state.select((F.col("list_element.ttlExpirationMs") - F.unix_millis(F.current_timestamp())).alias("ms")).collect()
    assert left and all(0 < r.ms <= LS._DAY_MS for r in left)
