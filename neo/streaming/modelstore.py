"""Versioned models that a running stream picks up (M9, ST2).

A version is a folder of its own; the file ``CURRENT``, replaced by rename, names the one in use.  The scoring
stream looks at that file before every micro-batch and loads a model only when it names another
version, so a new model needs no restart.  A micro-batch is scored by one version, which its rows
carry, and writes one folder, which a second run of the batch replaces.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from neo.operators import ml as M
from neo.sources import tables as TB
from neo.streaming.landing import _trigger

#: The version of rows that were scored before there was a model (formula F28).
NO_MODEL = "none"


def publish_model(spark: SparkSession, model: PipelineModel, store: str, version: str) -> None:
    """Save a model as ``version`` and make it current; readers see the old model or the whole new one."""
    M.save_model(model, f"{store}/{version}")
    TB.replace_text(spark, f"{store}/CURRENT", version)


def current_version(spark: SparkSession, store: str) -> str:
    if not any(name == "CURRENT" for name, _ in TB.children(spark, store)):
        return NO_MODEL
    return spark.read.text(f"{store}/CURRENT").first()[0]


class CurrentModel:
    """The current model of a store, loaded again only when the version changes."""

    def __init__(self, store: str):
        self.store, self.version, self.model = store, NO_MODEL, None

    def get(self, spark: SparkSession) -> tuple[str, PipelineModel | None]:
        version = current_version(spark, self.store)
        if version != self.version:
            self.model, self.version = M.load_model(f"{self.store}/{version}"), version
        return self.version, self.model


def score_stream(records: DataFrame, store: str, path: str, checkpoint: str, trigger: str = "10 seconds",
                 factor_col: str | None = None) -> StreamingQuery:
    """Score a stream (M8) with the store's current model: rows with ``ml_probability``, ``ml_risk_level`` and
    ``model_version`` under ``path/batch=<id>``."""
    current = CurrentModel(store)

    def write(batch: DataFrame, batch_id: int) -> None:
        version, model = current.get(batch.sparkSession)
        scored = M.score(batch, model, factor_col).withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _trigger(records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write), trigger).start()
