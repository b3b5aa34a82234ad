"""Structured Streaming forms of parsing, window counts and session assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.parse import parse_lines
from faultline.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed_stream(lines: DataFrame, fmt: str = "hdfs") -> DataFrame:
    """Records and rejects of a line stream in one frame (``parsed_ok`` tells them apart)."""
    return parse_lines(lines, fmt)


def window_counts(events: DataFrame, ts: str = "ts", event: str = "event_id", minutes: int = 5, lateness: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and event; a window is emitted once the watermark has passed its end."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.window(ts, f"{minutes} minutes"), event)
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), event, "n")
    )


def quiet_sessions(events: DataFrame, session: str = "session_id", ts: str = "ts", gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Event count of each session burst, emitted when it has been quiet for ``gap``."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap), session)
        .agg(F.count("*").alias("n"))
        .select(session, F.col("session_window.start").alias("burst_start"), F.col("session_window.end").alias("burst_end"), "n")
    )


def run_to_table(stream: DataFrame, name: str, mode: str = "append", state: str | None = None) -> DataFrame:
    """Run a stream over everything available into a table of the shared folder and read it back.

    ``state``: the folder of its checkpoint, for readers of its state; a new one if not given.
    """
    spark: SparkSession = stream.sparkSession
    # Keyed Python state needs the RocksDB store; it also keeps big state out of the JVM heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A batch uploads the entries it changed, not a snapshot of all state.
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    out, state = scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_totals(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a counting stream in update mode: every batch appends the changed totals, the latest counts."""
    spark: SparkSession = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = (
        stream.writeStream.outputMode("update").option("checkpointLocation", state)
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    seen = spark.read.option("basePath", out).parquet(out)
    return seen.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])
