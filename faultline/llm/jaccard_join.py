"""Jaccard join of word shingles: a size-aware heavy-light join.

Small sets are joined by fixed-size subsets: two sets of sizes n and m link exactly if they share a subset of
``overlap(n, m)`` shingles, so a small set emits its subsets of every size it can need and equal ones meet. Large sets
(and small ones next to the boundary) scan inverted lists: of the shingles that occur in more than one document, rarest
first, a set must share one of its first ``prefix(n)`` with every set it links to. The boundary is the size at which
the subsets of all sets below and the list entries of all sets above cost least, by counts over the whole table.

How it stays small:

* Shingles travel as packed 64-bit integers (48 bits of hash, 16 bits of place in a slice), one binary per slice and
  hash range, so that a shuffle moves few large rows. Equal shingles meet in a range; those that occur once end there.
* Only the others return to their slice, where each set finds how many of its shingles are unique. A set with more
  unique shingles than its prefix cannot link to anything and ends there. Others keep only their shared shingles, which
  is enough for exact intersections, as unique ones are in no other set.
* Equal sets are one class. Pairs are proposed from each list to its leader first and verified; once these links have
  made components, only members outside a list's largest component are compared with the list, as pairs inside one
  component need no proof. So a group of thousands of near copies costs a multiple of its size.

Sets are compared by hashes: 48 bits per shingle (in 10^9 compared pairs of 500 shingles about one false match of one
shingle is expected) and 64 bits plus the size per class. NULL and blank texts have empty sets and link with nothing,
not even with each other. Texts are used whole. Repeated rows are members of their class; a NULL key is kept in the
result with its class's component. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultline.llm.components import components
from faultline.llm.textbytes import IS_WHITE, LOWER, hash_spans, mix, repeat_ranges, segment_sums, small_batches, spans, text_slices
from faultline.session import materialize

WORDS = 5
LARGEST_SMALL = 12
RANGE_TOKENS = 1_000_000
SLICE = 1 << 20
_KEEP = np.uint64((1 << 48) - 1)
_PLACE = np.uint64(0xFFFF)
_FACTORS = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_SHORT = mix(np.arange(301, 301 + WORDS, dtype=np.uint64))


def overlap(n, m):
    """Least intersection of linked sets of these sizes: 100 i >= 75 (n + m - i)."""
    return -((-3 * (n + m)) // 7)


def prefix(n):
    """How many of a set's shingles, in any common order, must hold one of every linked set."""
    return n - (-((-3 * n) // 4)) + 1


def _overlap_column(n: Column, m: Column) -> Column:
    return F.floor((F.lit(3) * (n + m) + 6) / 7)


def shingle_sets(data: np.ndarray, docs: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a slice as sorted (document << 48 | hash), and the set sizes."""
    low = LOWER[data]
    starts, ends, offsets = spans(~IS_WHITE[data], docs)
    count = np.diff(offsets)
    words = hash_spans(low, starts, ends)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):  # a slice may have fewer words than a shingle
        rolled[: len(words) - k] += words[k:] * _FACTORS[k]
    full = np.where(count >= width, count - width + 1, 0)
    hashes = [mix(rolled[repeat_ranges(offsets[:-1], full)])]
    owner = [np.repeat(np.arange(len(count)), full)]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        total = _SHORT[count[short]].copy()
        for k in range(width - 1):
            has = count[short] > k
            total[has] += words[offsets[short[has]] + k] * _FACTORS[k]
        hashes.append(mix(total))
        owner.append(short)
    packed = np.concatenate(owner).astype(np.uint64) << np.uint64(48) | (np.concatenate(hashes) & _KEEP)
    packed = np.unique(packed)
    return packed, np.bincount((packed >> np.uint64(48)).astype(np.int64), minlength=len(count))


def class_ids(packed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name per set; equal sets have equal names."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return mix(segment_sums(mix(packed & _KEEP), ends) ^ mix(sizes.astype(np.uint64))).view(np.int64)


def describe(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS) -> DataFrame:
    """(key, n_shingles, set_id) per row; ``set_id`` is NULL for empty sets."""

    def run(batches):
        for part, data, docs in text_slices(batches, text, SLICE):
            packed, sizes = shingle_sets(data, docs, width)
            names = pa.array(class_ids(packed, sizes), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(sizes.astype(np.int64)), names], names=[key, "n_shingles", "set_id"])

    kind = df.schema[key].dataType.simpleString()
    return small_batches(df.select(key, text)).mapInArrow(run, f"{key} {kind}, n_shingles long, set_id long")


def with_set_ids(df: DataFrame, name: str, text: str = "text", width: int = WORDS) -> DataFrame:
    """All rows and columns, and the ``set_id`` of the row's text under ``name``."""

    def run(batches):
        for part, data, docs in text_slices(batches, text, SLICE):
            packed, sizes = shingle_sets(data, docs, width)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(class_ids(packed, sizes), mask=sizes == 0)], names=[*part.schema.names, name])

    return small_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))


def _bytes(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind, copy=False).tobytes()


def _spread(df: DataFrame, text: str, width: int, bits: int) -> DataFrame:
    """Per slice: one row that names its sets, and one row per hash range with the slice's shingles in it."""

    def run(batches):
        slice_id = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        for part, data, docs in text_slices(batches, text, SLICE):
            packed, sizes = shingle_sets(data, docs, width)
            names = class_ids(packed, sizes)
            fresh = sizes > 0
            for i, name in enumerate(names.tolist()):  # copies inside a task need no second look
                fresh[i] &= name not in seen
                seen.add(name)
            if len(seen) > 1_000_000:
                seen.clear()
            owner = packed >> np.uint64(48)
            packed = packed[fresh[owner.astype(np.int64)]]
            slice_id += 1
            turned = np.sort((packed & _KEEP) << np.uint64(16) | packed >> np.uint64(48))
            cuts = np.searchsorted(turned, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            cuts = np.append(cuts, len(turned))
            used = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([slice_id % (1 << bits), *used.tolist()], pa.int64()),
                "slice": pa.array([slice_id] * (len(used) + 1), pa.int64()),
                "names": pa.array([_bytes(np.where(fresh, names, 0), "<i8"), *[None] * len(used)], pa.binary()),
                "sizes": pa.array([_bytes(np.where(fresh, sizes, 0), "<i4"), *[None] * len(used)], pa.binary()),
                "shingles": pa.array([None, *[_bytes(turned[cuts[u] : cuts[u + 1]], "<u8") for u in used]], pa.binary()),
            })

    return small_batches(df.select(text)).mapInArrow(run, "part long, slice long, names binary, sizes binary, shingles binary")


_RETURNED = "slice long, names binary, sizes binary, shingles binary, often binary"


def _shared(group: pa.Table) -> pa.Table:
    """Shingles of one hash range that more than one set has, back to their slices with their frequency in eighths of a power of two."""
    named = pc.is_valid(group.column("names"))
    heads = group.filter(named).select(["slice", "names", "sizes", "shingles"])
    heads = heads.append_column("often", pa.nulls(len(heads), pa.binary()))
    group = group.filter(pc.invert(named))
    if not len(group):
        return heads
    slices = group.column("slice").to_numpy()
    raw = [np.frombuffer(x.as_py(), "<u8") for x in group.column("shingles")]
    values = np.concatenate(raw)
    source = np.repeat(np.arange(len(raw), dtype=np.int32), [len(x) for x in raw])
    order = np.argsort(values, kind="stable")
    tokens = values[order] >> np.uint64(16)
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    counts = np.diff(np.append(np.flatnonzero(new), len(tokens)))
    keep = np.repeat(counts > 1, counts)
    often = np.repeat(np.minimum(255, np.log2(counts) * 8).astype(np.uint8), counts)[keep]
    values, source = values[order][keep], source[order][keep]
    back = np.argsort(source, kind="stable")
    values, often = values[back], often[back]
    ends = np.searchsorted(source[back], np.arange(len(raw) + 1))
    used = np.flatnonzero(np.diff(ends))
    empty = pa.nulls(len(used), pa.binary())
    found = pa.table({
        "slice": pa.array(slices[used], pa.int64()), "names": empty, "sizes": empty,
        "shingles": pa.array([_bytes(values[ends[u] : ends[u + 1]], "<u8") for u in used], pa.binary()),
        "often": pa.array([often[ends[u] : ends[u + 1]].tobytes() for u in used], pa.binary()),
    })
    return pa.concat_tables([heads, found])


_CLASSES = "set_id long, n int, alone int, shingles array<long>, work long"


def _candidates(group: pa.Table) -> pa.Table:
    """Sets of one slice that can link to others: their shared shingles in the common order, rarest first."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["names"] is not None)
    names, sizes = np.frombuffer(head["names"], "<i8"), np.frombuffer(head["sizes"], "<i4").astype(np.int64)
    rest = [r for r in rows if r["names"] is None]
    values = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["shingles"], "<u8") for r in rest]])
    often = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r["often"], np.uint8) for r in rest]])
    place = (values & _PLACE).astype(np.int64)
    shared = np.bincount(place, minlength=len(names))
    able = (sizes > 0) & (sizes - shared < prefix(sizes)) & (shared >= overlap(sizes, -(-3 * sizes // 4)))
    keep = able[place]
    values, often, place = values[keep] >> np.uint64(16), often[keep], place[keep]
    order = np.lexsort((mix(values), often, place))
    values, often = values[order].astype(np.int64), often[order]
    chosen = np.flatnonzero(able)
    ends = np.concatenate([[0], np.cumsum(shared[chosen])])
    first = np.clip(prefix(sizes[chosen]) - (sizes[chosen] - shared[chosen]), 0, shared[chosen])
    cost = np.concatenate([[0], np.cumsum(2.0 ** (often / 8.0))])
    return pa.table({
        "set_id": pa.array(names[chosen], pa.int64()), "n": pa.array(sizes[chosen].astype(np.int32)),
        "alone": pa.array((sizes - shared)[chosen].astype(np.int32)),
        "shingles": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
        "work": pa.array((cost[ends[:-1] + first] - cost[ends[:-1]]).astype(np.int64)),
    })


def partner_sizes(n: int) -> range:
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def subset_sizes(n: int, largest: int) -> list[int]:
    """Sizes of the subsets that a set of ``n`` shingles needs to meet all partners up to ``largest``."""
    return sorted({overlap(n, m) for m in partner_sizes(n) if 0 < m <= largest})


def boundary(sizes: dict[int, tuple[int, int]], largest: int = LARGEST_SMALL) -> int:
    """The size up to which sets are small, from (sets, list entries to scan) per size: the cheapest split of the work."""
    best, chosen = None, 0
    for x in range(largest + 1):
        light = sum(sets * sum(comb(n, c) for c in subset_sizes(n, x)) for n, (sets, _) in sizes.items() if n <= x)
        heavy = sum(work for n, (_, work) in sizes.items() if 4 * n // 3 > x)
        if best is None or light + heavy < best:
            best, chosen = light + heavy, x
    return chosen


def _subsets(classes: DataFrame, largest: int) -> DataFrame:
    """(list, set_id, n, alone, pos) with one list per subset of shared shingles; the size of the subset is part of its name."""

    def run(batches):
        for batch in batches:
            keys, owners = [], []
            for i, (n, shingles) in enumerate(zip(batch.column("n").to_pylist(), batch.column("shingles").to_pylist(), strict=True)):
                names = mix(np.sort(np.array(shingles, np.int64)).view(np.uint64)).tolist()
                for c in subset_sizes(n, largest):
                    made = [(sum(part) + c * 0x9E3779B97F4A7C15) % 2**64 for part in combinations(names, c)]
                    keys += made
                    owners += [i] * len(made)
            names = mix(np.array(keys, np.uint64)).view(np.int64)
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), *[batch.column(c).take(at) for c in ("set_id", "n", "alone")], pa.array(np.full(len(owners), -1, np.int32))],
                names=["list", "set_id", "n", "alone", "pos"],
            )

    small = classes.where(F.col("n") <= largest).select("set_id", "n", "alone", "shingles")
    return small.mapInArrow(run, "list long, set_id long, n int, alone int, pos int")


def _entries(classes: DataFrame, largest: int) -> DataFrame:
    """Entries of the inverted lists: the first shared shingles of every set that is large or can link to a large one."""
    first = F.slice("shingles", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - F.col("alone")).cast("int"))
    rows = classes.where(F.floor(F.col("n") * 4 / 3) > largest)
    rows = rows.select("set_id", "n", "alone", F.posexplode(first).alias("rank", "list"))
    return rows.select("list", "set_id", "n", "alone", (F.col("alone") + F.col("rank")).alias("pos"))


def _may_link(n: Column, pos: Column, m: Column, qos: Column) -> Column:
    """Size filter, and what is left behind the meeting place in both sets is enough."""
    need = _overlap_column(n, m)
    return (need <= F.least(n, m)) & ((pos < 0) | (1 + F.least(n - pos, m - qos) - 1 >= need))


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that link, by exact intersection of their shared shingles."""
    left = classes.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = classes.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(F.size(F.array_intersect("sa", "sb")) >= _overlap_column(F.col("na"), F.col("nb"))).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_classes(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, component) of classes that link, from candidate classes and their lists (list, set_id, n, alone, pos).

    The leader of a list is the set with the fewest shingles of its own: among near copies, the one they were made from.
    """
    leader = lists.groupBy("list").agg(F.count("*").alias("members"), F.min(F.struct("alone", F.xxhash64("set_id"), "set_id", "n", "pos")).alias("lead"))
    leader = leader.where("members > 1").select(F.col("list").alias("of"), F.col("lead.set_id").alias("l"), F.col("lead.n").alias("ln"), F.col("lead.pos").alias("lp"))
    kept = lists.join(materialize(leader, "leaders"), F.col("list") == F.col("of")).drop("of")
    kept = materialize(kept, "lists")
    likely = _may_link(F.col("n"), F.col("pos"), F.col("ln"), F.col("lp"))
    stars = kept.where((F.col("set_id") != F.col("l")) & likely).select(*_ordered(F.col("set_id"), F.col("l"))).distinct()
    first = materialize(_verified(stars, classes), "star-links")
    parts = materialize(components(first), "star-parts")
    member = kept.select("list", "set_id", "n", "pos").join(parts, F.col("set_id") == F.col("node"), "left")
    member = materialize(member.withColumn("part", F.coalesce("component", "set_id")).drop("node", "component"), "members")
    sizes = member.groupBy("list", "part").agg(F.count("*").alias("c"))
    main = sizes.groupBy("list").agg(F.max(F.struct("c", "part")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select(F.col("list").alias("of"), F.col("top.part").alias("main"))
    open_ = materialize(member.join(materialize(main, "main-parts"), F.col("list") == F.col("of")).drop("of"), "open-lists")
    other = open_.where("part <> main").select("list", F.col("set_id").alias("o"), F.col("n").alias("on"), F.col("pos").alias("op"), F.col("part").alias("opart"))
    crossing = (F.col("part") != F.col("opart")) & ((F.col("part") == F.col("main")) | (F.col("set_id") < F.col("o")))
    meet = open_.join(other, "list").where(crossing & _may_link(F.col("n"), F.col("pos"), F.col("on"), F.col("op")))
    pairs = meet.select(*_ordered(F.col("set_id"), F.col("o"))).distinct()
    second = _verified(pairs, classes)
    return components(first.unionByName(second))


def _bits(tokens: int) -> int:
    return max(6, min(40, int(np.ceil(np.log2(max(1, tokens / RANGE_TOKENS))))))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WORDS) -> DataFrame:
    """(key, n_shingles, component_id, set_id, part) per row: the smallest key that links of Jaccard 0.75 or more reach.

    ``part`` names the component itself, as components that share a key can share their smallest one; NULL for empty sets.
    """
    described = materialize(describe(df, key, text, width), "sets")
    names = described.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(key).alias("rep"))
    total = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    returned = _spread(df, text, width, _bits(total)).groupBy("part").applyInArrow(_shared, _RETURNED)
    found = returned.groupBy("slice").applyInArrow(_candidates, _CLASSES)
    classes = materialize(found, "classes").groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "alone", "shingles", "work")])
    classes = materialize(classes, "distinct-classes")
    by_size = classes.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").agg(F.count("*").alias("sets"), F.sum("work").alias("work")).collect()
    largest = boundary({r.n: (r.sets, r.work) for r in by_size})
    lists = _entries(classes, largest)
    if largest:
        lists = lists.unionByName(_subsets(classes, largest))
    parts = materialize(link_classes(classes, materialize(lists, "entries")), "parts")
    named = names.join(parts, F.col("set_id") == F.col("node"), "left")
    named = named.withColumn("part", F.coalesce("component", "set_id"))
    named = materialize(named, "named-sets")
    lowest = materialize(named.groupBy("part").agg(F.min("rep").alias("component_id")), "lowest")
    by_set = materialize(named.select(F.col("set_id").alias("sid"), "part").join(lowest, "part").select("sid", "component_id", "part"), "set-components")
    out = described.join(by_set, F.col("set_id") == F.col("sid"), "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"), "set_id", "part")
