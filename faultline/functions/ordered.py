"""Ordered computations (numbering, running sums, carry-forward, exact quantiles) for skewed keys.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. Here the rows of a key are
first cut into buckets that follow the order (``bucket`` grows with the order columns). Only one
aggregate row per (key, bucket) is handled per key; rows meet in tasks of bucket size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

ROWS_PER_BUCKET = 1_000_000
VALUE_BUCKETS = 64


def id_bucket(c: Column | str, width: int = ROWS_PER_BUCKET) -> Column:
    """Bucket for a dense integer order such as a line number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(width))


def time_bucket(c: Column | str, unit: str = "minute") -> Column:
    """Bucket for an order by time. A minute keeps even a key with a third of all rows in small pieces."""
    return F.date_trunc(unit, F.col(c) if isinstance(c, str) else c)


def edges(value: Column) -> Column:
    """Aggregate: approximate quantiles of a column, the edges of buckets of about equal size."""
    return F.percentile_approx(value, [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)], 10 * VALUE_BUCKETS)


def value_bucket(value: Column, cuts: Column) -> Column:
    """Bucket for an order by value: how many edges lie below it. Far outliers cannot empty the other buckets."""
    return F.size(F.filter(cuts, lambda c: c < value))


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _beside(local: DataFrame, per_bucket: DataFrame, part: list[str]) -> DataFrame:
    """Rows with what is known of their bucket; NULL keys are keys like others."""
    theirs = per_bucket.withColumnsRenamed({k: f"_of_{k}" for k in part})
    return local.join(theirs, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in part], "left")


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums; ``order`` must be unique inside a key. Rows with a NULL key form a group of their own."""
    rows = df.withColumn("_b", bucket)
    for i, value in enumerate(sums.values()):
        rows = rows.withColumn(f"_v{i}", value)
    part = [*keys, "_b"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*part).agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    offsets = totals.select(*part, *[F.sum(f"_t{i}").over(_before(keys)).alias(f"_o{i}") for i in range(len(sums))])
    local = rows.select("*", *[F.sum(f"_v{i}").over(inside).alias(f"_s{i}") for i in range(len(sums))])
    return _beside(local, offsets, part).select(
        *df.columns,
        *[(F.col(f"_s{i}") + F.coalesce(F.col(f"_o{i}"), F.lit(0))).alias(name) for i, name in enumerate(sums)],
    )


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """Add the 1-based position of each row inside its key."""
    return running_sum(df, keys, order, bucket, {out: F.lit(1).cast("long")})


def carry_last(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, out: str, before: bool = False
) -> DataFrame:
    """Add the last non-NULL ``value`` at or before each row (strictly before with ``before=True``)."""
    rows = df.withColumn("_b", bucket).withColumn("_v", value)
    part = [*keys, "_b"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    newest = rows.groupBy(*part).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_l"))
    carried = newest.select(*part, F.last("_l", ignorenulls=True).over(_before(keys)).alias("_c"))
    local = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
    return _beside(local, carried, part).select(*df.columns, F.coalesce("_in", "_c").alias(out))


def attach(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Bring per-key aggregates to the rows; without keys the one-row aggregate enters as a scalar subquery."""
    if keys:
        theirs = stats.withColumnsRenamed({k: f"_of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        return df.join(theirs, same).drop(*[f"_of_{k}" for k in keys])
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_st", one).select(*df.columns, *[F.col(f"_st.{c}").alias(c) for c in stats.columns])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float | Column]) -> DataFrame:
    """Exact interpolated quantiles per key from distinct values with counts, spread over value buckets."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # A table: edges depend on the order in which partial results meet, and sums per bucket and rows must see the same ones.
    stats = materialize(counts.groupBy(*keys).agg(edges(F.col(value)).alias("_cuts"), F.sum("_n").alias("_all")), "edges")
    placed = attach(counts, stats, keys)
    spot = value_bucket(F.col(value), F.col("_cuts"))
    ranked = running_sum(placed, keys, [value], spot, {"_cum": F.col("_n")})
    aggs = []
    for i, p in enumerate(probs.values()):
        rank = (p if isinstance(p, Column) else F.lit(float(p))) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_cum") > F.floor(rank), F.col(value)))
        high = F.min(F.when(F.col("_cum") > F.ceil(rank), F.col(value)))
        aggs += [low.alias(f"_l{i}"), high.alias(f"_h{i}"), F.max(rank - F.floor(rank)).alias(f"_f{i}")]
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(n) for i, n in enumerate(probs)],
    )


def smallest_hashes(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows with the smallest seeded hash of ``key`` (all if there are fewer): a uniform, repeatable sample.

    Rows with one key have one hash; of those at the limit any may be taken. ``df`` is read once more for each count of hashes.
    """
    hashed = df.withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    return smallest_rows(hashed, "_hash", n, [key], (-(1 << 63), (1 << 63) - 1)).drop("_hash")


SPANS = 4096


def _long(value: int) -> str:
    return f"cast('{value}' as bigint)"


def smallest_rows(df: DataFrame, rank: str, n: int, order: list[str] | None = None, limits: tuple[int, int] | None = None) -> DataFrame:
    """The ``n`` rows with the smallest integer ``rank`` (all with one, if there are fewer), ties by ``order``.

    A histogram of at most about ``SPANS`` equal spans of the rank's range names the span that holds the n-th row; spans are cut
    further until no more than twice n rows lie up to it, or one value fills it. Only those rows are sorted, whatever
    the number of tasks. Each cut is one scan of ``rank``, and so is finding its ``limits`` if they are not known; rows
    without a rank are left out.
    """
    rows = df.where(F.col(rank).isNotNull())
    if limits:
        (low, high), total = limits, 2 * n + 1
    else:
        low, high, total = rows.agg(F.min(rank), F.max(rank), F.count("*")).first()
    before, bound = 0, high
    while total > 2 * n and low < high:
        step = (high - low) // SPANS + 1
        inside = rows.where(F.expr(f"`{rank}` BETWEEN {_long(low)} AND {_long(high)}"))
        spans = inside.groupBy(F.expr(f"cast(`{rank}` as bigint) div {step}L").alias("_span")).agg(
            F.count("*").alias("_n"), F.min(rank).alias("_low"), F.max(rank).alias("_high")
        )
        span = None
        for span in sorted(spans.collect(), key=lambda s: s["_low"]):
            if before + span["_n"] >= n:
                break
            before += span["_n"]
        if span is None:
            return rows.limit(0)
        low, high, total = span["_low"], span["_high"], before + span["_n"]
        bound = high
    if bound is None:
        return rows.limit(0)
    kept = rows.where(F.expr(f"`{rank}` <= {_long(bound)}"))
    return kept.orderBy(rank, *(order or [])).limit(n)
