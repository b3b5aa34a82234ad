"""Metric series (long form: sample_id, idx, ts, metric, value) and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numbers import min_max
from faultline.functions.ordered import attach, number_rows, time_bucket
from faultline.operators.parse import region_flag


def normalize(points: DataFrame, epsilon: float | None = None, keys: tuple[str, ...] = ("sample_id", "metric")) -> DataFrame:
    """Add ``scaled``: min-max per series. Aggregate and join, so no task holds a whole series; points with a NULL key are one."""
    stats = points.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return attach(points, stats, list(keys)).select(
        *points.columns, min_max(F.col("value"), F.col("_lo"), F.col("_hi"), epsilon).alias("scaled")
    )


def last_value(points: DataFrame) -> DataFrame:
    return points.groupBy("sample_id", "metric").agg(F.max_by("value", "idx").alias("last"))


def point_index(points: DataFrame, keys: list[str], ts: str = "ts", bucket: Column | None = None) -> DataFrame:
    """0-based index of each point inside its series."""
    placed = number_rows(points, keys, [ts], bucket if bucket is not None else time_bucket(ts), "idx")
    return placed.withColumn("idx", (F.col("idx") - 1).cast("int"))


def quota_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Spread ``n`` over the strata: n // k each, one more for the first n % k in key order.

    Rows of a stratum are taken in the order of a seeded hash. A first rank inside hash ranges of the
    stratum, limited by the stratum's quota, leaves the second one a bounded number of rows.
    """

    strata = df.select(stratum).distinct()
    ranked = strata.withColumn("_i", F.row_number().over(Window.orderBy(stratum)))
    k = strata.select(F.count("*")).scalar()
    quota = ranked.select(
        stratum, (F.floor(F.lit(n) / k) + F.when(F.col("_i") <= F.lit(n) % k, 1).otherwise(0)).alias("_quota")
    )
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    inside = Window.partitionBy(stratum, F.shiftright("_h", 58)).orderBy("_h", key)
    order = Window.partitionBy(stratum).orderBy("_h", key)
    near = hashed.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= n).join(quota.withColumnRenamed(stratum, "_st"), F.col(stratum).eqNullSafe(F.col("_st")))
    drawn = near.where(F.col("_r") <= F.col("_quota")).withColumn("_r", F.row_number().over(order))
    return drawn.where(F.col("_r") <= F.col("_quota")).drop("_r", "_quota", "_h", "_st")


def log_position(samples: DataFrame, lines: DataFrame, points: int = 60) -> DataFrame:
    """Line at which an anomaly starting at metric index ``anomaly_start_idx`` shows in the log."""
    size = lines.groupBy("sample_id").agg(F.count("*").alias("n_lines"))
    start = F.floor(F.col("anomaly_start_idx") * F.col("n_lines") / points)
    return samples.join(size, "sample_id").withColumn("log_start", start)


def mark_region(points: DataFrame, samples: DataFrame) -> DataFrame:
    """Flag points inside the anomaly region of their sample."""
    size = points.groupBy("sample_id").agg((F.max("idx") + 1).alias("_n"))
    starts = samples.select("sample_id", "anomaly_start_idx").join(size, "sample_id")
    return points.join(starts, "sample_id").select(
        *points.columns, region_flag(F.col("idx"), F.col("anomaly_start_idx"), F.col("_n")).alias("in_region")
    )


def observations(stats: DataFrame, rise: float = 1.5, fall: float = 0.67) -> DataFrame:
    """Evidence per metric: spike, drop, normal or no anomaly window (our thresholds on after/before)."""
    finding = (
        F.when(F.col("after").isNull() | F.col("before").isNull(), "no window")
        .when(F.col("ratio") >= rise, "spike")
        .when(F.col("ratio") <= fall, "drop")
        .otherwise("normal")
    )
    return stats.withColumn("finding", finding)
