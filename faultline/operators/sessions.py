"""Sessions: ordered event lists, count matrices, padded sequences, per-session heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordered import id_bucket, number_rows

SEGMENT = 10_000


def event_lists(
    df: DataFrame,
    keys: list[str],
    event: str = "event_id",
    order: str = "line_no",
    bucket: Column | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Ordered event ids of each session as (keys, segment, events).

    Rows with a NULL key are dropped. A session of at most ``segment`` events is one row with segment
    0; a longer one continues in further rows, so no array grows with a hot key.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    rows = df.select(*keys, event, order)
    placed = number_rows(rows, keys, [order], bucket if bucket is not None else id_bucket(order))
    return (
        placed.withColumn("segment", F.floor((F.col("pos") - 1) / F.lit(segment)))
        .groupBy(*keys, "segment")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", event))), lambda x: x[event]).alias("events"))
    )


def with_window(df: DataFrame, ts: str = "event_ts", minutes: int = 5, out: str = "window_id") -> DataFrame:
    """Add the start of the tumbling window as text; rows without a readable time are dropped."""
    dtype = df.schema[ts].dataType.typeName()
    time = F.col(ts) if dtype.startswith("timestamp") else F.try_to_timestamp(F.col(ts))
    start = F.window(time, f"{minutes} minutes")["start"]
    return df.where(time.isNotNull()).withColumn(out, F.date_format(start, "yyyy-MM-dd HH:mm:ss"))


def window_lists(df: DataFrame, minutes: int = 5, ts: str = "event_ts", **kwargs) -> DataFrame:
    """Event lists per tumbling window."""
    return event_lists(with_window(df, ts, minutes), ["window_id"], **kwargs)


def count_events(df: DataFrame, keys: list[str], event: str = "event_id") -> DataFrame:
    """Long count matrix (keys, event, n)."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys, event).agg(F.count("*").alias("n"))


def count_matrix(df: DataFrame, vocab: list[int], session: str = "session_id", event: str = "event_id") -> DataFrame:
    """Wide count matrix: one column ``E<id>`` per vocabulary entry, unknown events ignored, absent 0.

    Conditional counts instead of lists: one shuffle of at most one partial row per session and task.
    """
    cells = [F.count_if(F.col(event) == v).alias(f"E{v}") for v in vocab]
    return df.where(F.col(session).isNotNull()).groupBy(session).agg(*cells)


def numbered_events(df: DataFrame, session: str, order: str = "line_no", bucket: Column | None = None) -> DataFrame:
    """Add position and the code ``E001``, ``E002`` ... inside each session."""
    placed = number_rows(
        df.where(F.col(session).isNotNull()), [session], [order], bucket if bucket is not None else id_bucket(order)
    )
    return placed.withColumn("code", F.format_string("E%03d", "pos"))


def first_events(df: DataFrame, session: str, n: int = 50, order: str = "line_no") -> DataFrame:
    """First ``n`` rows of each session with their position. Tasks keep ``n`` rows per session before
    the shuffle (window group limit), so a hot session costs ``n`` rows per task."""
    head = Window.partitionBy(session).orderBy(order)
    numbered = df.where(F.col(session).isNotNull()).withColumn("pos", F.row_number().over(head))
    return numbered.where(F.col("pos") <= n)


def padded_sequences(
    df: DataFrame, session: str = "session_id", event: str = "event_id", order: str = "line_no", length: int = 50, pad: int = -1
) -> DataFrame:
    """Fixed-length event sequences: cut at ``length``, padded with ``pad``."""
    head = first_events(df.select(session, event, order), session, length, order)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", event))), lambda x: x[event].cast("int"))
    return head.groupBy(session).agg(
        F.slice(F.concat(listed, F.array_repeat(F.lit(pad), length)), 1, length).alias("sequence")
    )


def first_per_class(labels: DataFrame, n: int, order: str, label: str = "label") -> DataFrame:
    """First ``n`` sessions of every class in file order."""
    ranked = labels.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(order)))
    return ranked.where(F.col("rank") <= n)


def ids_by_first_appearance(templates: DataFrame, first: str = "first_line", out: str = "event_id") -> DataFrame:
    """Number templates by the line they first appear on."""
    return number_rows(templates, [], [first], id_bucket(first), out)


def align_labels(features: DataFrame, labels: DataFrame, key: str = "session_id") -> DataFrame:
    """Keep sessions that have both features and a label."""
    return features.join(labels, key, "inner")


def rows_of(df: DataFrame, chosen: DataFrame, key: str = "session_id") -> DataFrame:
    """Log rows of chosen sessions (semi join; Spark broadcasts the ids when they are few)."""
    return df.join(chosen.select(key), key, "left_semi")


def pair_sessions(sessions: DataFrame, by: str, session: str = "session_id", label: str = "label") -> DataFrame:
    """One (normal, anomalous) pair per ``by`` value: the first id of each class."""
    pick = lambda v: F.min(F.when(F.col(label) == v, F.col(session)))
    return sessions.groupBy(by).agg(pick(0).alias("normal_id"), pick(1).alias("anomaly_id")).dropna()
