"""Log and metric evidence on one time line, and fused incident documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import carry_last, time_bucket


def align_in_time(errors: DataFrame, anomalies: DataFrame, key: str, ts: str = "ts", unit: str = "minute") -> DataFrame:
    """Nearest metric anomaly at or before each log error: adds metric_ts, delta_s and alignment.

    Both sides are stacked and the last anomaly is carried forward over (key, time bucket), so a busy
    key is spread over its buckets. Alignment words are our definition: strong up to 60 s, moderate
    up to 300 s, else weak.
    """
    extra = [c for c in errors.columns if c not in (key, ts)]
    stacked = errors.withColumn("_side", F.lit(1)).unionByName(
        anomalies.select(key, ts).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    seen = carry_last(
        stacked, [key], [ts, "_side"], time_bucket(ts, unit), F.when(F.col("_side") == 0, F.col(ts)), "metric_ts"
    ).where("_side = 1")
    delta = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("metric_ts").cast("timestamp"))) / 1e6
    return seen.select(key, ts, *extra, "metric_ts", delta.alias("delta_s"), alignment(delta).alias("alignment"))


def alignment(delta: Column) -> Column:
    return F.when(delta.isNull(), "none").when(delta <= 60, "strong").when(delta <= 300, "moderate").otherwise("weak")


def combined_confidence(log: Column, metric: Column, w_log: float = 0.5, w_metric: float = 0.5) -> Column:
    """Weighted mean of the two confidences; a missing side leaves the other alone."""
    weight = F.when(log.isNotNull(), w_log).otherwise(0.0) + F.when(metric.isNotNull(), w_metric).otherwise(0.0)
    total = F.coalesce(log * w_log, F.lit(0.0)) + F.coalesce(metric * w_metric, F.lit(0.0))
    return F.try_divide(total, weight)


def fuse(logs: DataFrame, metrics: DataFrame, timing: DataFrame, remediation: DataFrame, key: str = "incident_id",
         strategy: str = "weighted_evidence_aggregation") -> DataFrame:
    """Nested incident documents.

    ``logs``: classification, confidence, root_cause, error_chain, affected_components. ``metrics``:
    observations, score. ``timing``: log_error_time, metric_anomaly_time, delta_s. ``remediation``:
    severity, actions. All are one row per incident.
    """
    joined = logs.join(metrics, key, "left").join(timing, key, "left").join(remediation, key, "left")
    log_part = F.struct(
        F.lit("system_logs").alias("source"), "classification", "confidence", "root_cause", "error_chain", "affected_components"
    )
    metric_part = F.struct(F.lit("metric_series").alias("source"), "observations", F.col("score").alias("anomaly_score"))
    fusion = F.struct(
        F.lit(strategy).alias("strategy"),
        F.col("root_cause").alias("final_root_cause"),
        combined_confidence(F.col("confidence"), F.col("score")).alias("combined_confidence"),
        F.struct(
            "log_error_time", "metric_anomaly_time",
            F.concat(alignment(F.col("delta_s")), F.lit(" ("), F.round("delta_s").cast("bigint").cast("string"), F.lit("s delta)")).alias("temporal_alignment"),
        ).alias("cross_modal_correlation"),
        F.upper("severity").alias("severity"),
        F.col("actions").alias("remediation"),
    )
    return joined.select(
        key, log_part.alias("log_analysis"), metric_part.alias("metric_analysis"), fusion.alias("multimodal_fusion")
    )
