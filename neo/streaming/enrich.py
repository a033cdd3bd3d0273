"""Stream enrichment and alerting (ST2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from neo.functions.timefn import to_ntz
from neo.operators.alerts import make_alerts, publish_enrich


def enrich_and_alert(records: DataFrame, alert_time: Column | None = None, dedupe_watermark: str | None = None,
                     ts_col: str = "timestamp", factor_col: str | None = None,
                     probability: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """ST2: score every record (F37) and derive alerts (F36), statelessly per
    micro-batch, so a body above the threshold alerts each time it is seen (as
    the reference).  ``probability`` replaces the heuristic score (e.g. a model
    score column).  With ``dedupe_watermark`` (e.g. ``"1 hour"``) alerts of one
    body are deduplicated within the watermark (bounded state)."""
    enriched = publish_enrich(records, ts_col=ts_col, factor_col=factor_col, probability=probability)
    alerts = make_alerts(enriched, alert_time=alert_time)
    if dedupe_watermark:
        alerts = (alerts.withColumn("__event_time", to_ntz(alerts, "timestamp").cast("timestamp"))
                  .withWatermark("__event_time", dedupe_watermark)
                  .dropDuplicatesWithinWatermark(["asteroid_id"]).drop("__event_time"))
    return enriched, alerts
