"""Raw lines to structured records, and row-level predicates on records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import clip_round
from faultline.functions.text import compute_once, strip_ws
from faultline.sources.formats import LineFormat, resolve


def parse_lines(df: DataFrame, fmt: str | LineFormat = "hdfs", value: str = "value", flag: str = "parsed_ok") -> DataFrame:
    """Add the fields of a layout and a flag; unmatched lines stay with NULL fields.

    The pattern runs once per line: a match is rewritten to its fields joined by line ends (which no
    line contains) with one in front, and split again.
    """
    layout = resolve(fmt)
    joined = F.regexp_replace(
        strip_ws(F.col(value)), layout.regex, "".join(f"\n${g}" for g in layout.groups)
    )
    hit = F.startswith(F.col("_joined"), F.lit("\n"))
    parts = F.when(hit, F.split(F.substr(F.col("_joined"), F.lit(2)), "\n", len(layout.fields)))
    kept = [c for c in df.columns if c not in layout.fields]
    return compute_once(df.withColumn("_joined", joined), "_parts", parts).select(
        *kept,
        F.col("_parts").isNotNull().alias(flag),
        *[F.col("_parts")[i].alias(name) for i, name in enumerate(layout.fields)],
    )


def route(df: DataFrame, flag: str = "parsed_ok") -> tuple[DataFrame, DataFrame]:
    """Split into (records, rejects)."""
    return df.where(F.col(flag)).drop(flag), df.where(~F.col(flag)).drop(flag)


def parse_statistics(df: DataFrame, by: list[str] | None = None, flag: str = "parsed_ok") -> DataFrame:
    """Total, parsed, failed and success rate in percent; no input gives 100 %, not an error."""
    total, failed = F.count("*"), F.count_if(~F.col(flag))
    return df.groupBy(*(by or [])).agg(
        total.alias("total_lines"),
        F.count_if(flag).alias("parsed_ok"),
        failed.alias("failures"),
        ((1 - failed / F.greatest(total, F.lit(1))) * 100).alias("success_rate"),
    )


def hdfs_time() -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyMMdd HHmmss"))


def alert_flag(c: str = "label") -> Column:
    return F.col(c) != "-"


def keep_session_events(df: DataFrame, session: str = "block_id", event: str = "event_id") -> DataFrame:
    """Rows with both a session and an event id; the event id becomes an integer."""
    whole = F.expr(f"try_cast(try_cast(`{event}` AS DOUBLE) AS INT)")
    return df.dropna(subset=[session, event]).withColumn(event, whole).where(F.col(event).isNotNull())


def normalize_label(df: DataFrame, c: str) -> Column:
    """0/1 from a label column: words for strings, plain integer for numbers."""
    if df.schema[c].dataType.typeName() == "string":
        return F.when(F.lower(c).isin("anomaly", "abnormal", "1"), 1).otherwise(0)
    return F.col(c).cast("int")


def slow_call(rt: str = "rt", threshold: float = 30.0) -> Column:
    return F.col(rt) > F.lit(threshold)


def pick_samples(
    df: DataFrame, n: int, is_anomaly: int | None = None, layer: str | None = None, order: str = "sample_id"
) -> DataFrame:
    """First ``n`` samples of a class and/or layer in id order."""
    if is_anomaly is not None:
        df = df.where(F.col("is_anomaly") == is_anomaly)
    if layer is not None:
        df = df.where(F.col("layer") == layer)
    return df.orderBy(order).limit(n)


def region_flag(idx: Column, start: Column, length: Column) -> Column:
    """True from the anomaly start on; no start, or one past the end, marks no point."""
    return F.coalesce((start < length) & (idx >= start), F.lit(False))


def clip_to_profile(value: Column, low: Column, high: Column) -> Column:
    return clip_round(value, low, high, 4)
