"""Readers for call-graph and resource tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns of the trace tables; ``timestamp`` is an offset, not a clock time.
SCHEMAS = {
    "Node": "timestamp bigint, nodeid string, cpu_utilization double, memory_utilization double",
    "MSResource": (
        "timestamp bigint, msname string, msinstanceid string, nodeid string, cpu_utilization double, "
        "memory_utilization double"
    ),
    "MSRTMCR": (
        "timestamp bigint, msname string, msinstanceid string, nodeid string, providerrpc_rt double, "
        "providerrpc_mcr double, consumerrpc_rt double, consumerrpc_mcr double"
    ),
    "MSCallGraph": (
        "timestamp bigint, traceid string, service string, rpc_id string, um string, uminstanceid string, "
        "rpctype string, interface string, dm string, dminstanceid string, rt double"
    ),
}
SCHEMAS["MSRTMCR_WIDE"] = SCHEMAS["MSRTMCR"] + (
    ", writemc_rt double, writemc_mcr double, readmc_rt double, readmc_mcr double, writedb_rt double, "
    "writedb_mcr double, readdb_rt double, readdb_mcr double"
)


def read_trace_table(spark: SparkSession, table: str, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(SCHEMAS[table])
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)
