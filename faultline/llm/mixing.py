"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a hash, so a block is a random set of about ``block_words`` words. A
source that is wanted more than once runs through all its blocks once per epoch, each time from another start, and
the rest of its target is the longest run of whole blocks that fits; from the next block single documents fill what
is left, the first that fits each time. The quotas of blocks are exact integers per source. A tree splits them among
the output shards: each node deals its quotas to its two halves with a multivariate hypergeometric draw seeded by
the node, so every shard finds its own quotas from the root without seeing the others. Shards then take disjoint
ranges of each source's permuted blocks and order their documents by a hash.

A source holds any share of the rows: sums are taken per (source, block) and only those are put in order, in pieces.
The number of sources must fit in a list on the driver, as the weights do. NULL is a source of its own, after all
others. NULL or blank texts have no words: they take part with size 0 and are never missed or repeated by words.
Rows that are equal in key, source and size are kept or left together. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

BLOCK_WORDS = 65_536
SHARD_WORDS = 1_000_000
RUN_BLOCKS = 1024
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its own size; the excess goes to the others by weight."""
    total, found, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        left = total - sum(found[i] for i in range(len(sizes)) if i not in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]}
        for i in over or open_:
            found[i] = most * sizes[i] if i in over else left * weights[i] / weight
        open_ = open_ - over if over else set()
    return found


def split_quotas(quotas: np.ndarray, shard: int, shards: int, seed: int) -> np.ndarray:
    """The quotas that the tree gives to one shard; over all shards they add up to ``quotas``, each within one of its fair size."""
    low, high, node = 0, shards, 1
    total = int(quotas.sum())
    edge = lambda k: total * k // shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, node])
        left = rng.multivariate_hypergeometric(quotas, edge(middle) - edge(low), method="marginals")
        quotas, low, high, node = (left, low, middle, 2 * node) if shard < middle else (quotas - left, middle, high, 2 * node + 1)
    return quotas


@dataclass(frozen=True)
class Plan:
    """What the whole table decides: one line per source, and the documents taken from the block at its edge."""

    sources: list[tuple]  # source, index, words, target, epochs, blocks, last whole block of the rest, quota of blocks
    edge: DataFrame
    seed: int


#: Columns that `draw` and `deal` add beside those of the source lines; columns of the input with such names are replaced.
ADDED = ("_order", "_block", "draws", "epoch", "shard", "place", "_slot", "_cs", "_co", "_ck", "_cz", "_ps", "_pslot")


def _place(df: DataFrame, sources: list[tuple], seed: int) -> DataFrame:
    """Each row's source line, permuted order and block. The source lines are one short row per source, made from a driver list."""
    schema = "_name string, _s int, source_size long, target double, _epochs int, _blocks long, _last long, _quota long"
    lines = df.sparkSession.createDataFrame(sources, schema)
    return (
        df.drop(*lines.columns, *ADDED).join(F.broadcast(lines), F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")
        .withColumn("_order", F.xxhash64(F.lit(seed), "key", "size"))
        .withColumn("_block", F.pmod(F.xxhash64("_order"), F.col("_blocks")))
    )


def plan(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 7, block_words: int = BLOCK_WORDS) -> Plan:
    """Targets, epochs and block quotas for rows (key, source, size); ``weights`` repeat over the sources by code point."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("words")).collect()
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    aims = targets([r.words for r in per], [weights[i % len(weights)] for i in range(len(per))], most)
    lines, rests = [], []
    for i, (row, aim) in enumerate(zip(per, aims, strict=True)):
        epochs = min(int(aim // row.words), int(most)) if row.words else 0
        rests.append((i, max(0, round(aim) - epochs * row.words) if epochs < most else 0))
        lines.append((row.source, i, row.words, aim, epochs, max(1, math.ceil(row.words / block_words)), -1, 0))
    placed = _place(sizes, lines, seed)
    blocks = placed.groupBy("_s", "_block").agg(F.sum("size").alias("_words"))
    run = F.floor(F.col("_block") / RUN_BLOCKS)
    blocks = materialize(blocks.withColumn("_run", run), "mix-blocks")
    before = Window.partitionBy("_s").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = blocks.groupBy("_s", "_run").agg(F.sum("_words").alias("_t"))
    starts = runs.select("_s", "_run", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sums = blocks.withColumn("_in", F.sum("_words").over(inside)).join(starts, ["_s", "_run"])
    sums = sums.withColumn("_cum", F.col("_base") + F.col("_in"))
    rest = sizes.sparkSession.createDataFrame(rests, "_s int, _rest long")
    whole = F.col("_cum") <= F.col("_rest")
    ends = sums.join(F.broadcast(rest), "_s").groupBy("_s").agg(
        F.max(F.when(whole, F.col("_block"))).alias("last"), F.max(F.when(whole, F.col("_cum"))).alias("cum"),
        F.min(F.when(~whole, F.col("_block"))).alias("edge"), F.first("_rest").alias("rest"),
    )
    edges = []
    for row in ends.collect():  # one row per source
        room, last = row.rest - (row.cum or 0), -1 if row.last is None or not row.rest else row.last
        if row.rest and room > 0 and row.edge is not None:
            edges.append((row._s, row.edge, room))
        line = lines[row._s]
        top = row.edge if edges and edges[-1][0] == row._s else last
        lines[row._s] = (*line[:6], last, line[4] * line[5] + top + 1)
    marks = sizes.sparkSession.createDataFrame(edges, "_s int, _edge long, _room long")
    border = placed.join(F.broadcast(marks), "_s").where(F.col("_block") == F.col("_edge"))
    groups = border.groupBy("_s", "_room", "_order", "key", "size").agg(F.count("*").alias("_n"))
    kind = sizes.schema["key"].dataType.simpleString()
    fits = groups.groupBy("_s").applyInPandas(_fill, f"_cs int, _co long, _ck {kind}, _cz long")
    return Plan(lines, materialize(fits, "mix-edge"), seed)


def _fill(docs: pd.DataFrame) -> pd.DataFrame:
    """Documents of the block at the edge that still fit, in permuted order; a block has a bounded number of words."""
    docs = docs.sort_values(["_order", "key", "size"])
    room, fits = int(docs["_room"].iloc[0]), []
    for size, copies in zip(docs["size"], docs["_n"], strict=True):
        fits.append(0 < size * copies <= room)
        room -= size * copies if fits[-1] else 0
    docs = docs.loc[fits, ["_s", "_order", "key", "size"]]
    return docs.set_axis(["_cs", "_co", "_ck", "_cz"], axis=1)


def draw(df: DataFrame, made: Plan) -> DataFrame:
    """Add ``source_size``, ``target`` and ``draws`` (how often the mix takes the row) to rows with key, source and size."""
    same = (F.col("_s") == F.col("_cs")) & (F.col("_order") == F.col("_co")) & F.col("key").eqNullSafe(F.col("_ck")) & (F.col("size") == F.col("_cz"))
    drawn = _place(df, made.sources, made.seed).join(made.edge, same, "left")
    extra = (F.col("_block") <= F.col("_last")) | F.col("_cs").isNotNull()
    return drawn.withColumn("draws", F.coalesce(F.col("_epochs") + extra.cast("int"), F.lit(0))).drop("_cs", "_co", "_ck", "_cz")


def deal(drawn: DataFrame, made: Plan, count: int) -> DataFrame:
    """One row per draw with its ``shard``, ``epoch`` and local order ``place``."""
    quotas, seed = np.array([line[7] for line in made.sources], np.int64), made.seed

    def own(batches):
        for batch in batches:
            for shard in batch["id"]:
                mine = split_quotas(quotas, int(shard), count, seed)
                yield pd.DataFrame({"_ps": np.arange(len(mine), dtype=np.int32), "shard": int(shard), "_n": mine})

    dealt = drawn.sparkSession.range(count).mapInPandas(own, "_ps int, shard long, _n long").where("_n > 0")
    order = Window.partitionBy("_ps").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.withColumn("_from", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    slots = ranges.select("_ps", "shard", F.explode(F.sequence("_from", F.col("_from") + F.col("_n") - 1)).alias("_pslot"))
    slots = materialize(slots, "mix-slots")
    times = drawn.where("draws > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed), "_s", "epoch"), F.col("_blocks"))
    turned = F.when(F.col("epoch") < F.col("_epochs"), F.pmod(F.col("_block") + start, F.col("_blocks"))).otherwise(F.col("_block"))
    times = times.withColumn("_slot", F.col("epoch") * F.col("_blocks") + turned)
    placed = times.join(slots, (F.col("_s") == F.col("_ps")) & (F.col("_slot") == F.col("_pslot")))
    return placed.withColumn("place", F.xxhash64(F.lit(seed), "shard", "_order", "epoch")).drop("_ps", "_pslot", "_slot")


def clean(mix: DataFrame) -> DataFrame:
    """The mix without working columns."""
    return mix.drop("_s", "_epochs", "_blocks", "_last", "_quota", "_order", "_block")


def shard_count(sizes: DataFrame) -> int:
    """Output shards of about ``SHARD_WORDS`` words."""
    return max(1, -(-int(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // SHARD_WORDS))
