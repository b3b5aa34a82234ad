"""Writers. All outputs are plain tables or files written by the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parsed(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Parsed records, one folder per dataset."""
    df.write.mode(mode).partitionBy("dataset").format(fmt).options(header=True, escape='"').save(path)


def write_templates(df: DataFrame, path: str, mode: str = "error") -> None:
    """Template catalogue, most frequent first."""
    df.orderBy(F.desc("count"), "cluster_id").write.mode(mode).csv(path, header=True, escape='"')


def write_features(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_detector_results(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("method", "f1_score").write.mode(mode).csv(path, header=True)


def write_samples(manifest: DataFrame, labels: DataFrame, root: str, mode: str = "error") -> None:
    """Manifest as CSV and label documents as JSON with explicit nulls."""
    manifest.write.mode(mode).csv(f"{root}/metadata", header=True, escape='"')
    labels.write.mode(mode).option("ignoreNullFields", False).json(f"{root}/labels")


def write_incidents(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)
