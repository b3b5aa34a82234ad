"""Counts, histograms, contingency tables, top-k reports and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.numbers import equal_width_bin, ratio
from faultline.functions.ordered import attach, quantiles, smallest_hashes
from faultline.functions.text import compute_once, detect_level, literal_count


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def top_counts(df: DataFrame, k: int, *columns: str) -> DataFrame:
    return value_counts(df, *columns).limit(k)


def level_histogram(df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """Lines per detected level; lines without a level word are left out."""
    found = compute_once(df.select(*by, value), "level", detect_level(F.col(value)))
    return found.where("level IS NOT NULL").groupBy(*by, "level").agg(F.count("*").alias("n"))


def line_length(df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("lines"), F.coalesce(F.avg(F.length(value)), F.lit(0.0)).alias("avg_length")
    )


def dataset_comparison(df: DataFrame, top: int = 5) -> DataFrame:
    """One row per dataset: lines, MB, mean line length and its ``top`` levels as text. Levels are few."""
    counted = (
        df.select("dataset", F.length("value").alias("len"), F.octet_length("value").alias("bytes"),
                  detect_level(F.col("value")).alias("level"))
        .groupBy("dataset", "level")
        .agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.sum("bytes").alias("bytes"))
    )
    ranked = F.slice(
        F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), F.struct((-F.col("n")).alias("k"), "level")))), 1, top
    )
    text = F.array_join(F.transform(ranked, lambda x: F.concat(x["level"], F.lit(":"), (-x["k"]).cast("string"))), ", ")
    return counted.groupBy("dataset").agg(
        F.sum("n").alias("lines"),
        ((F.sum("bytes") + F.sum("n")) / (1024 * 1024)).alias("size_mb"),
        ratio(F.sum("len"), F.sum("n")).alias("avg_length"),
        text.alias("levels"),
    )


def block_statistics(df: DataFrame, block: str = "block_id", approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(block) if approximate else F.count_distinct(block)
    return df.agg(
        F.count("*").alias("rows"),
        F.count(block).alias("with_block"),
        (ratio(F.count(block), F.count("*")) * 100).alias("share_pct"),
        distinct.alias("blocks"),
    )


def session_length_statistics(df: DataFrame, session: str = "session_id") -> DataFrame:
    """Number of sessions and min/max/mean/median length."""
    lengths = df.where(F.col(session).isNotNull()).groupBy(session).agg(F.count("*").alias("len"))
    return lengths.groupBy("len").agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("sessions"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        ratio(F.sum(F.col("len") * F.col("n")), F.sum("n")).alias("mean_len"),
        F.percentile("len", 0.5, F.col("n")).alias("median_len"),
    )


def template_summary(catalogue: DataFrame) -> DataFrame:
    """Messages, templates and messages per template."""
    return catalogue.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("messages"),
        F.count("*").alias("templates"),
        ratio(F.sum("count"), F.greatest(F.count("*"), F.lit(1))).alias("messages_per_template"),
    )


def event_prevalence(df: DataFrame, session: str = "session_id", event: str = "event_id", rare: float = 0.1) -> DataFrame:
    """How many events occur in all sessions, and in fewer than ``rare`` of them."""
    pairs = df.where(F.col(session).isNotNull()).select(session, event).distinct()
    total = pairs.select(F.count_distinct(session).alias("sessions"))
    per_event = attach(pairs.groupBy(event).agg(F.count("*").alias("n")), total, [])
    return per_event.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("n") == F.col("sessions")).alias("in_all"),
        F.count_if(ratio(F.col("n"), F.col("sessions")) < rare).alias("in_few"),
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == 0).alias("normal"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("anomaly"),
        (ratio(F.sum(label), F.count("*")) * 100).alias("anomaly_pct"),
    )


def contingency_with_margins(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Cross table with an ``All`` row and column."""
    cells = [F.count_if(F.col(cols) == v).alias(f"c_{v}") for v in values]
    table = df.rollup(rows).agg(*cells, F.count("*").alias("All"), F.grouping_id().alias("g"))
    return table.select(
        F.when(F.col("g") == 1, "All").otherwise(F.col(rows)).alias(rows), *[f"c_{v}" for v in values], "All"
    )


def contingency(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Cross table without margins; ``values`` fixes the columns so no extra job finds them."""
    return df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).fillna(0)


def layer_breakdown(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("layer")
        .agg(F.count("*").alias("total"), F.sum("is_anomaly").cast("long").alias("anomalies"))
        .orderBy("layer")
    )


def scenario_breakdown(df: DataFrame) -> DataFrame:
    """Anomalous samples per scenario with the scenario's name."""
    return (
        df.where(F.col("scenario_id") != "")
        .groupBy("scenario_id")
        .agg(F.min("scenario_name").alias("name"), F.count("*").alias("n"))
        .orderBy("scenario_id")
    )


def cardinalities(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def sample_level_counts(df: DataFrame, value: str = "value") -> DataFrame:
    """Hits of ``[LEVEL`` per sample."""
    return df.groupBy("sample_id").agg(
        *[F.sum(literal_count(F.col(value), f"[{w}")).alias(w.lower()) for w in ("INFO", "WARN", "ERROR", "CRITICAL")]
    )


def mean_levels_by_class(counts: DataFrame, manifest: DataFrame, n: int = 50) -> DataFrame:
    """Mean level counts over the first ``n`` samples of each class."""
    first = Window.partitionBy("is_anomaly").orderBy("sample_id")
    chosen = manifest.select("sample_id", "is_anomaly", F.row_number().over(first).alias("r")).where(F.col("r") <= n)
    return counts.join(chosen, "sample_id").groupBy("is_anomaly").agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("info", "warn", "error", "critical")]
    )


def caller_counts(calls: DataFrame, caller: str = "um") -> DataFrame:
    return value_counts(calls, caller)


def histogram(df: DataFrame, value: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-width histogram between the minimum and maximum; empty bins are left out."""
    stats = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = attach(df.where(F.col(value).isNotNull()).select(*by, value), stats, list(by))
    return placed.groupBy(
        *by, equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin")
    ).agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def five_numbers(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact minimum, quartiles and maximum."""
    return quantiles(df, by or [], value, {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0})


def quantile_sketches(df: DataFrame, value: str, by: list[str] | None = None, k: int = 400) -> DataFrame:
    """(by, sketch, rows): one mergeable KLL sketch of ``value`` per group, made in each task and merged; NULL and NaN are left out.

    Sketches of files or days can be stored and merged by `merge_sketches` without reading the values again. The rank of an
    estimate is off by at most about 2.3 / k of the rows (99 % confidence, one quantile).
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    made = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))
    return rows.groupBy(*(by or [])).agg(made.alias("sketch"), F.count("*").alias("rows"))


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sketch, rows) of coarser groups."""
    return sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("rows").alias("rows"))


def sketched_five_numbers(sketches: DataFrame) -> DataFrame:
    """Minimum and maximum exactly, quartiles within the sketch's error, in place of the sketch."""
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    told = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(n) for n, p in probs.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *told)


def sample_facts(logs: DataFrame, series: DataFrame) -> DataFrame:
    """Log lines, metric points, metric names in column order, first and last time of each sample."""
    lines = logs.groupBy("sample_id").agg(F.count("*").alias("num_log_lines"))
    names = series.groupBy("sample_id", "metric").agg(
        F.count("*").alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min("slot").alias("slot"),
    )
    points = names.groupBy("sample_id").agg(
        F.max("points").alias("num_metric_points"),
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "metric"))), lambda x: x["metric"]).alias("metrics"),
        F.min("first_ts").alias("timestamp_start"),
        F.max("last_ts").alias("timestamp_end"),
    )
    return points.join(lines, "sample_id", "left").fillna(0, ["num_log_lines"])


def top_and_bottom(df: DataFrame, score: str, name: str, k: int = 20) -> DataFrame:
    """The k/2 highest and k/2 lowest rows by score, NULL scores left out."""
    scored = df.where(F.col(score).isNotNull())
    half = scored.select(F.floor(F.least(F.lit(k), F.count("*")) / 2)).scalar()
    sides = []
    for side, order in (("top", [F.desc(score), F.asc(name)]), ("bottom", [F.asc(score), F.desc(name)])):
        head = scored.orderBy(*order).limit(k // 2).withColumn("side", F.lit(side))
        sides.append(head.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(*order))))
    return sides[0].unionByName(sides[1]).where(F.col("rank") <= half)


def preview(lines: DataFrame, n: int = 5, files: int = 3) -> DataFrame:
    """First ``n`` lines of the first ``files`` files."""
    names = lines.select("file").distinct().orderBy("file").limit(files)
    return lines.where(F.col("line_no") <= n).join(names, "file", "left_semi")


def subsample(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows in the order of a seeded hash: uniform and repeatable."""
    return smallest_hashes(df, key, n, seed)


def shared_ids(left: DataFrame, right: DataFrame, key: str = "session_id") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def vocabulary(df: DataFrame, event: str = "event_id") -> DataFrame:
    return df.select(event).distinct()


def running_totals(stream_or_batch: DataFrame) -> DataFrame:
    """Messages per event so far; on a stream use output mode update or complete."""
    return stream_or_batch.groupBy("event_id").agg(F.count("*").alias("messages"))


def missing_and_extra(normal: Column, anomalous: Column) -> tuple[Column, Column]:
    """Events of the normal session absent from the anomalous one, and the other way round."""
    return F.array_sort(F.array_except(normal, anomalous)), F.array_sort(F.array_except(anomalous, normal))
