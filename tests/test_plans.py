"""Physical plans: pruning, pushdown, no joins / windows where none are needed."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from neo.operators import features as FE
from neo.sources import tables as TB
from neo import schemas as S
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan(spark):
    df = E.entry(spark)
    plan = _plan(df)
    assert "TakeOrderedAndProject" in plan
    assert "Join" not in plan and "Window" not in plan
    assert df.count() == 20


def test_null_filter_pushed_to_scan(spark, tmp_dir):
    from tests.fixtures import scenarios_df
    scenarios_df(spark).write.parquet(f"{tmp_dir}/a")
    df = FE.drop_incomplete(TB.read_table(spark, f"{tmp_dir}/a", S.ASTEROID_LANDING)).select("id", "size")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(position), IsNotNull(velocity), IsNotNull(size), IsNotNull(mass)]" in plan \
        or "IsNotNull(size)" in plan


def test_column_pruning_nested(spark, tmp_dir):
    from tests.fixtures import scenarios_df
    scenarios_df(spark).write.parquet(f"{tmp_dir}/b")
    df = TB.read_table(spark, f"{tmp_dir}/b", S.ASTEROID_LANDING).select(F.col("position.x"))
    plan = _plan(df)
    assert "ReadSchema: struct<position:struct<x:double>>" in plan


def test_summary_is_one_aggregate(spark):
    from neo.operators import aggregates as A
    from neo.plans import catalog as C
    plan = _plan(A.summary(C.risk_fixed(spark, SF_SMALL)))
    assert plan.count("HashAggregate") + plan.count("ObjectHashAggregate") + plan.count("SortAggregate") <= 2


def test_cluster_conf_scales_partitions():
    from neo.session import cluster_conf
    conf = cluster_conf(1000, 8)
    assert conf["spark.sql.shuffle.partitions"] == "24000"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert "spark.checkpoint.dir" not in conf


def test_iso_string_ignores_session_time_zone(spark):
    from neo.functions.timefn import iso_string
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("2024-03-10 02:30:00.5",)], "t string").select(
            F.col("t").cast("timestamp_ntz").alias("t"))
        assert df.select(iso_string(F.col("t"))).first()[0] == "2024-03-10T02:30:00.500000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
