"""ST4: partial aggregates over many batches equal a recompute; versions and the pointer."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neo.operators import aggregates as A
from neo.operators import windows as W
from neo.sources import tables as TB
from neo.streaming import readmodel as RM

SCHEMA = ("id string, event_id long, timestamp timestamp_ntz, size double, distance_from_earth double, "
          "enhanced_collision_probability double, risk_level string")


def _rows(rng, n, first, day):
    out = []
    for i in range(n):
        p = rng.choice([None, 0.0, round(rng.random() * 0.001, 5), 0.001])
        out.append((f"a{rng.randrange(9)}", first + i, dt.datetime(2024, 3, 1) + dt.timedelta(days=day + rng.randrange(2), seconds=i),
                    rng.choice([None, rng.random() * 9]), rng.random(), p, rng.choice(["HIGH", "MEDIUM", "LOW", None])))
    return out


def _check(spark, path, rows, days, levels):
    df = spark.createDataFrame(rows, SCHEMA)
    newest = max(r[2].date() for r in rows)
    df = df.where(F.to_date("timestamp") > F.lit(newest - dt.timedelta(days=days)))
    if levels:
        df = df.where(F.coalesce("risk_level", F.lit("LOW")).isin(levels))
    got = RM.read_live_model(spark, path, days=days, levels=levels)
    want = A.panel_stats(df).first().asDict()
    have = got["panel"].first().asDict()
    assert have.pop("avg_size") == pytest.approx(want.pop("avg_size")) and have == want
    top = W.top_risk(df, tie_breakers=("id", "event_id"))
    assert [r[:] for r in got["top"].collect()] == [r[:] for r in top.collect()]
    cell = F.least(F.floor(F.coalesce("enhanced_collision_probability", F.lit(0.0)) / F.lit(0.00005)), F.lit(19))
    bins = {r[0]: r[1] for r in df.groupBy(cell).count().collect()}
    assert {r["bin"]: r["count"] for r in got["histogram"].collect()} == bins
    box = {r.risk_level: r for r in A.size_box_stats(df).collect()}
    sizes = df.select(F.coalesce("risk_level", F.lit("LOW")).alias("k"), "size").where("size is not null").toPandas()
    for r in got["box"].collect():
        assert (r.n, r.min, r.max) == (box[r.risk_level].n, box[r.risk_level].min, box[r.risk_level].max)
        v = sizes[sizes.k == r.risk_level]["size"].to_numpy()
        for p, q in ((0.25, r.q1), (0.5, r.median), (0.75, r.q3)):
            assert np.mean(v < q) <= p + 0.02 + 1 / len(v) and np.mean(v <= q) >= p - 0.02 - 1 / len(v)


def test_fifty_batches_equal_a_recompute(spark, tmp_dir):
    rng = random.Random(4)
    path, seen = f"{tmp_dir}/model", []
    assert RM.read_live_model(spark, path) is None
    for b in range(50):
        rows = _rows(rng, rng.randrange(1, 25), 100 * b, b // 6)
        seen += rows
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        RM.refresh(df, b, path, days=5)
        if b in (17, 33):
            RM.refresh(df, b, path, days=5)  # a batch that runs again changes nothing
            _check(spark, path, seen, 5, None)
    _check(spark, path, seen, 5, None)
    _check(spark, path, seen, 2, ["HIGH", "LOW"])
    assert RM.current_version(spark, path) == 49
    assert TB.partition_values(spark, path, "version") == ["48", "49"]
    parts = spark.read.parquet(f"{path}/version=49/partials")
    assert parts.select("slice").distinct().count() <= 5 and parts.count() <= 5 * 4  # the state does not grow with history


def test_readers_keep_the_old_version_until_the_pointer_moves(spark, tmp_dir, monkeypatch):
    path, rng = f"{tmp_dir}/model", random.Random(5)
    RM.refresh(spark.createDataFrame(_rows(rng, 20, 0, 0), SCHEMA), 0, path, 5)
    before = RM.read_live_model(spark, path)["panel"].first()

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(RM, "_point", fail)
    with pytest.raises(OSError):
        RM.refresh(spark.createDataFrame(_rows(rng, 20, 50, 0), SCHEMA), 1, path, 5)
    assert RM.read_live_model(spark, path)["panel"].first() == before  # the new tables are there, but not current
    monkeypatch.undo()
    RM.refresh(spark.createDataFrame(_rows(rng, 7, 50, 0), SCHEMA), 1, path, 5)
    assert RM.read_live_model(spark, path)["panel"].first()["total"] == 27


def test_empty_batch_and_rows_without_time(spark, tmp_dir):
    path = f"{tmp_dir}/model"
    RM.refresh(spark.createDataFrame([], SCHEMA), 0, path, 5)
    assert RM.read_live_model(spark, path)["panel"].first()["total"] == 0
    RM.refresh(spark.createDataFrame([("a", 1, None, 1.0, 1.0, 0.5, "HIGH")], SCHEMA), 1, path, 5)
    assert RM.read_live_model(spark, path)["panel"].first()["total"] == 0


def test_exact_tables_of_many_batches_equal_a_recompute(spark, tmp_dir):
    """Quartiles, fences, whiskers and the histogram over the range of the data, of all rows in the window."""
    rng = random.Random(6)
    path, seen = f"{tmp_dir}/model", []
    for b in range(4):
        rows = _rows(rng, 30, 100 * b, b)
        seen += rows
        RM.refresh(spark.createDataFrame(rows, SCHEMA).coalesce(1), b, path, days=3)
    newest = max(r[2].date() for r in seen)
    df = spark.createDataFrame(seen, SCHEMA).where(F.to_date("timestamp") > F.lit(newest - dt.timedelta(days=3)))
    got = RM.read_live_model(spark, path)
    for name, want in (("exact_box", A.size_box_stats(df)), ("exact_histogram", A.probability_histogram(df))):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, want.collect()))
    assert len(TB.partition_values(spark, f"{path}/rows", "slice")) <= 4  # days that left the window are gone
