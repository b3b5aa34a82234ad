"""Readers for a multimodal sample set: manifest, metric files, log files and label documents.

A label document is one small JSON object per file and is read whole; log and metric files are read
by line, however big they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.logs import read_log_lines

# Layouts of the manifest and of the label documents, and the default start index.
MANIFEST_SCHEMA = (
    "sample_id string, layer string, layer_name string, is_anomaly int, scenario_id string, scenario_name string, "
    "root_cause_category string, severity string, log_path string, metrics_path string, dashboard_path string, "
    "label_path string"
)
LABEL_SCHEMA = (
    "sample_id string, layer string, layer_name string, is_anomaly boolean, scenario_id string, scenario_name string, "
    "root_cause string, root_cause_category string, severity string, remediation array<string>, "
    "anomaly_start_idx int, num_log_lines int, num_metric_points int, metrics array<string>, "
    "timestamp_start string, timestamp_end string"
)
DEFAULT_START = 30

_STEM = r"([^/]+)\.[^./]+$"


def sample_id_of(path: str, key: str = "name") -> Column:
    """Sample id of a file: its name without extension, or the whole path where names repeat."""
    return F.col(path) if key == "path" else F.regexp_extract(path, _STEM, 1)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).csv(path, header=True, quote='"', escape='"')


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; commas and doubled quotes inside quotes belong to their cell."""
    outside = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    bare = lambda c: F.when(c.rlike(r'(?s)^".*"$'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(F.contains(line, F.lit('"')), F.transform(F.split(line, outside), bare)).otherwise(F.split(line, ","))


def read_metric_series(spark: SparkSession, path: str | list[str], key: str = "name", **options: str) -> DataFrame:
    """Long form (sample_id, idx, ts, metric, value); the columns may differ from file to file.

    Every line travels with the header of its file, so files of all layers are read in one scan.
    """
    lines = read_log_lines(spark, path, keep_path=True, with_header=True, **options).where("line_no > 1")
    cells = lines.select(
        sample_id_of("path", key).alias("sample_id"), (F.col("line_no") - 2).cast("int").alias("idx"),
        csv_cells(F.col("value")).alias("cells"), csv_cells(F.col("header")).alias("names"),
    )
    long = cells.select(
        "sample_id", "idx", F.col("cells")[0].try_cast("timestamp_ntz").alias("ts"), F.posexplode("names").alias("slot", "metric"), "cells"
    )
    return long.where("slot > 0").select(
        "sample_id", "idx", "ts", "metric", F.get("cells", F.col("slot")).try_cast("double").alias("value")
    )


def read_sample_logs(spark: SparkSession, path: str | list[str], key: str = "name") -> DataFrame:
    """(sample_id, line_no, value), numbered inside each sample's file."""
    lines = read_log_lines(spark, path, keep_path=True)
    return lines.select(sample_id_of("path", key).alias("sample_id"), "line_no", "value")


def read_label_documents(spark: SparkSession, path: str | list[str], per_line: bool = False) -> DataFrame:
    """Typed label documents, one per file (or per line). A missing start index becomes 30, an
    explicit null stays null."""
    docs = spark.read.text(path, wholetext=not per_line).select(
        F.from_json("value", LABEL_SCHEMA).alias("doc"), F.json_object_keys("value").alias("keys")
    )
    start = F.when(F.array_contains("keys", "anomaly_start_idx"), F.col("doc.anomaly_start_idx")).otherwise(
        F.lit(DEFAULT_START)
    )
    return docs.select("doc.*", start.alias("_start")).withColumn("anomaly_start_idx", F.col("_start")).drop("_start")
