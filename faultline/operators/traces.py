"""Call graph and resource tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import ratio, steady_avg
from faultline.operators.parse import slow_call


def flag_slow_calls(calls: DataFrame, threshold: float = 30.0) -> DataFrame:
    return calls.withColumn("slow", slow_call("rt", threshold))


def caller_fan_out(calls: DataFrame) -> DataFrame:
    """Calls, distinct callees and share of slow calls per caller."""
    return calls.groupBy("um").agg(
        F.count("*").alias("calls"),
        F.count_distinct("dm").alias("callees"),
        ratio(F.count_if(slow_call()), F.count("*")).alias("slow_share"),
    )


def calls_with_resources(calls: DataFrame, resources: DataFrame, interval: int = 60_000) -> DataFrame:
    """Call edges with the resource reading of the called instance in the same interval.

    Calls are aggregated per (instance, interval) first, so a busy instance joins as one row per
    interval.
    """
    slot = F.floor(F.col("timestamp") / interval)
    load = calls.groupBy(F.col("dminstanceid").alias("msinstanceid"), slot.alias("slot")).agg(
        F.count("*").alias("calls"), steady_avg(F.col("rt")).alias("avg_rt"), F.max("rt").alias("max_rt")
    )
    use = resources.groupBy("msinstanceid", slot.alias("slot")).agg(
        steady_avg(F.col("cpu_utilization")).alias("cpu"), steady_avg(F.col("memory_utilization")).alias("memory")
    )
    return load.join(use, ["msinstanceid", "slot"])
