"""Best-fit packing of token sequences by linear grouping.

Documents become token ids, longer ones are cut, and the pieces are packed into as few sequences of ``capacity`` tokens as
possible. What is planned is the histogram of piece lengths, which has at most ``capacity`` entries whatever the number of
documents: lengths above ``capacity / SMALL`` are rounded up within groups of equal cardinality (the linear grouping of
Fernandez de la Vega and Lueker), a linear programme over configurations of the few rounded lengths says how often each
configuration is used, actual lengths take the places of rounded ones, and all that is left, small lengths above all, is
put where it fits best, longest first. The plan says which places of which sequences the pieces of each length get.
Pieces are numbered within their length in buckets, so a length of a third of all rows gathers in no task.

Defined results: a NULL text is empty; an empty text is its end token alone. Rows that are alike in all their
columns are interchangeable; any of them takes any of their places. A NULL id is an id like others. Columns of ``docs``
named like those added are replaced. An empty table gives no sequences.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import number_rows
from faultline.llm.textbytes import hash_spans, repeat_ranges, small_batches, text_slices

SMALL = 4
GROUPS = 128
STEPS = 2000
ROWS_PER_BUCKET = 1 << 20
CACHED = 1_000_000
@dataclass(frozen=True)
class Places:
    """Consecutive pieces of one length: ``per`` in each sequence, from ``first`` on, beginning at ``offset``."""

    size: int
    number: int
    count: int
    per: int
    first: int
    offset: int


@dataclass
class Kind:
    """Sequences of equal content: how many, what they hold as (length, times), and their free tokens."""

    many: int
    holds: list[tuple[int, int]]
    free: int


def _table(*characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list("".join(characters).encode())] = True
    return table


_PRINTED = _table("".join(map(chr, range(0x21, 0x7F))))
_LETTER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_MARK = _table(",.;:!?)")


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of stretches of UTF-8 texts that a byte-level tokenizer reads apart, whatever stands around.

    They begin at each text, at a single space between two printable characters up to U+027F, and at a mark after a letter.
    """
    lead = (data >= 0xC3) & (data <= 0xC9)
    tail = (data & 0xC0) == 0x80
    tail[1:] &= lead[:-1]
    tail[:1] = False
    signs = np.isin(data, (0x97, 0xB7))
    signs[1:] &= data[:-1] == 0xC3
    begins = np.zeros(len(data), bool)
    before, after = _PRINTED[data] | tail, _PRINTED[data] | lead
    begins[1:] = _MARK[data[1:]] & (_LETTER[data] | (tail & ~signs))[:-1]
    begins[1:-1] |= (data[1:-1] == 0x20) & before[:-2] & after[2:]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Ids of whole texts by a byte-level tokenizer, which reads each distinct stretch once.

    About ``CACHED`` stretches are remembered: when there are more, those not met since the last time are forgotten.
    """

    def __init__(self, coder):
        self.coder, self.known, self.older = coder, {}, {}
        coder.encode_special_tokens = True

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data`` one after the other, and the offsets of texts in them."""
        starts = stretches(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, first, member = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        sizes = ends - starts
        same = (sizes == sizes[first][member]).all()
        if not same or (data != data[repeat_ranges(starts[first][member], sizes)]).any():
            first = member = np.arange(len(starts))
        raw = data.tobytes()
        ids = self._ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        counts = np.array([len(i) // 4 for i in ids], np.int64)
        places = np.cumsum(counts) - counts
        flat = np.frombuffer(b"".join(ids), np.uint32)
        out = flat[repeat_ranges(places[member], counts[member])]
        total = np.append(0, np.cumsum(counts[member]))
        return out, total[np.searchsorted(starts, offsets)]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for part in parts:
            if part not in known:
                if part in older:
                    known[part] = older[part]
                else:
                    new.append(part)
        for part, made in zip(new, self.coder.encode_batch_fast([n.decode() for n in new], add_special_tokens=False), strict=True):
            known[part] = array("I", made.ids).tobytes()
        return [known[part] for part in parts]


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    """The encoder of this worker; tasks that follow each other share what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Encoder(Tokenizer.from_file(tokenizer))


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = 1024, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit).

    Whole texts are encoded, then ``end`` is added. Only what is longer than ``capacity`` is cut, from the end on, so the
    first piece may be shorter. ``tokenizer`` is a file that every worker can read; strings of special tokens are text.
    """
    added = {"piece": "int", "start": "bigint", "length": "bigint", "ids": "binary"}
    names = [c for c in docs.columns if c != text and c not in added]
    types = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{c} {t}" for c, t in added.items()])

    def run(batches):
        coder = _encoder(tokenizer)
        for rows, data, offsets in text_slices(batches, text):
            ids, bounds = coder.encode(data, offsets)
            ids = np.insert(ids, bounds[1:], end).astype("<u4", copy=False)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = repeat_ranges(np.zeros(len(sizes), np.int64), count)
            start = np.where(piece > 0, (sizes[row] - 1) % capacity + 1 + (piece - 1) * capacity, 0)
            cuts = np.append(bounds[row] + start, len(ids))
            held = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(ids)])
            kept = rows.select(names).take(pa.array(row)).columns if names else []
            made = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(np.diff(cuts)), held]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names, *added])

    return small_batches(docs).select(*names, text).mapInArrow(run, types)


def rounded(histogram: dict[int, int], groups: int = GROUPS) -> list[list[tuple[int, int]]]:
    """Lengths with counts, longest first, cut into groups of equal cardinality; each stands for its longest length.

    A length may fall into two groups; groups that begin with the same length are one.
    """
    total = sum(histogram.values())
    out: list[list[tuple[int, int]]] = []
    left, quota = 0, -(-total // groups) if total else 0
    for size in sorted(histogram, reverse=True):
        count = histogram[size]
        while count:
            if not left:
                left = quota
                if not out or out[-1][0][0] != size:
                    out.append([])
            taken = min(left, count)
            out[-1].append((size, taken))
            count, left = count - taken, left - taken
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[np.ndarray, float]]:
    """How often to use which configuration (pieces of each size in one sequence) so that the fewest sequences hold ``demand``.

    The linear programme is solved by generating columns: a knapsack over the present prices finds the configuration that
    improves the basis most, until none does.
    """
    count = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    used = demand / np.diag(columns)
    for _ in range(steps):
        prices = np.linalg.solve(columns.T, np.ones(count))
        worth, config = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(columns, config.astype(float))
        ratio = np.where(change > 1e-9, used / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * change, 0)
        used[out] = ratio[out]
        columns[:, out] = config
    return [(columns[:, j].astype(np.int64), float(used[j])) for j in range(count)]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ascending = np.argsort(sizes, kind="stable")
    ordered, value = sizes[ascending], prices[ascending]
    for room in range(int(ordered[0]), capacity + 1):
        best[room] = best[room - 1]
        fits = int(np.searchsorted(ordered, room, side="right"))
        gain = best[room - ordered[:fits]] + value[:fits]
        top = int(gain.argmax())
        if gain[top] > best[room] + 1e-12:
            best[room], choice[room] = gain[top], ascending[top]
    config, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            config[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), config


def _substituted(configs: list[tuple[np.ndarray, int]], sizes: np.ndarray, stock: np.ndarray, capacity: int) -> list[Kind]:
    """Sequences of each configuration with actual lengths in the places of the rounded ones; ``stock`` (pieces by length) shrinks.

    A place takes the longest piece left of at most its rounded length, the last place of a sequence the longest that
    fits the room which shorter actual pieces have left. Fuller configurations go first.
    """
    kinds = []
    for config, many in sorted(configs, key=lambda c: -int(c[0] @ sizes)):
        slots = [int(sizes[g]) for g in np.argsort(-sizes, kind="stable") for _ in range(int(config[g]))]
        made = [Kind(many, [], capacity)]
        for place, slot in enumerate(slots):
            last = place > 0 and place == len(slots) - 1
            waiting, made = made, []
            for kind in waiting:
                left = kind.many
                while left:
                    there = np.flatnonzero(stock[: (kind.free if last else slot) + 1])
                    if not len(there):
                        made.append(Kind(left, kind.holds, kind.free))
                        break
                    size = int(there[-1])
                    now = min(left, int(stock[size]))
                    stock[size] -= now
                    made.append(Kind(now, [*kind.holds, (size, 1)], kind.free - size))
                    left -= now
        kinds += [k for k in made if k.holds]
    return kinds


def _best_fit(kinds: list[Kind], rest: dict[int, int], capacity: int) -> list[Kind]:
    """Put the ``rest``, longest first, where the least room is left that holds it; new sequences where none does."""
    by_free: dict[int, list[Kind]] = {}
    for kind in kinds:
        by_free.setdefault(kind.free, []).append(kind)

    def put(kind: Kind, many: int, size: int, times: int) -> None:
        made = Kind(many, [*kind.holds, (size, times)], kind.free - size * times)
        by_free.setdefault(made.free, []).append(made)

    for size in sorted(rest, reverse=True):
        count = rest[size]
        for free in sorted(f for f in by_free if f >= size and by_free[f]):
            times = free // size
            waiting, by_free[free] = by_free[free], []
            for kind in waiting:
                full = min(kind.many, count // times)
                if full:
                    put(kind, full, size, times)
                count -= full * times
                part = 1 if full < kind.many and count else 0
                if part:
                    put(kind, 1, size, count)
                    count = 0
                if kind.many > full + part:
                    by_free[free].append(Kind(kind.many - full - part, kind.holds, free))
            if not count:
                break
        empty, times = Kind(0, [], capacity), capacity // size
        if count >= times:
            put(empty, count // times, size, times)
        if count % times:
            put(empty, 1, size, count % times)
    return [kind for free in sorted(by_free) for kind in by_free[free]]


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = GROUPS) -> list[Places]:
    """Places for all pieces of a histogram of lengths."""
    full = histogram.get(capacity, 0)
    large = {s: n for s, n in histogram.items() if capacity // SMALL < s < capacity}
    rest = {s: n for s, n in histogram.items() if s <= capacity // SMALL}
    kinds = []
    if large:
        stocks = rounded(large, groups)
        sizes = np.array([stock[0][0] for stock in stocks])
        demand = np.array([sum(n for _, n in stock) for stock in stocks], float)
        whole = [(config, int(used + 1e-9)) for config, used in configurations(sizes, demand, capacity)]
        stock = np.zeros(capacity + 1, np.int64)
        stock[list(large)] = list(large.values())
        kinds = _substituted([w for w in whole if w[1]], sizes, stock, capacity)
        for size in np.flatnonzero(stock).tolist():
            rest[size] = rest.get(size, 0) + int(stock[size])
    kinds = _best_fit(kinds, rest, capacity)
    if full:
        kinds.append(Kind(full, [(capacity, 1)], 0))
    out, first, numbers = [], 0, {}
    for kind in kinds:
        offset, held = 0, {}
        for size, times in kind.holds:
            held[size] = held.get(size, 0) + times
        for size, times in held.items():
            number = numbers.get(size, 0)
            out.append(Places(size, number, kind.many * times, times, first, offset))
            numbers[size] = number + kind.many * times
            offset += size * times
        first += kind.many
    return out


def pack(rows: DataFrame, order: list[str], capacity: int = 1024, length: str = "length", groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces. ``rows`` is read three times, so it should be a written table.

    The driver sees one count per length (at most ``capacity``) and the plan made of it; ``order`` (all columns that tell
    pieces apart) numbers those of one length.
    """
    counts = {r[length]: r["n"] for r in rows.groupBy(length).agg(F.count("*").alias("n")).collect()}
    places = plan(counts, capacity, groups)
    told = [(p.size, p.number, p.count, p.per, p.first, p.offset) for p in places]
    names = ["_size", "number", "count", "per", "first", "at"]
    known = rows.sparkSession.createDataFrame(told, ", ".join(f"{n} bigint" for n in names))
    known = known.groupBy("_size").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("_places"))
    buckets = sum(counts.values()) // ROWS_PER_BUCKET + 1
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    numbered = number_rows(rows.select(kept), [length], order, F.pmod(F.xxhash64(*order), F.lit(buckets)), "_number")
    placed = numbered.withColumn("_number", F.col("_number") - 1).join(F.broadcast(known), F.col(length) == F.col("_size"))
    mine = F.element_at(F.filter("_places", lambda p: p["number"] <= F.col("_number")), -1)
    within = F.col("_number") - F.col("_mine.number")
    spot = F.col("_mine.at") + within % F.col("_mine.per") * F.col(length)
    sequence = F.col("_mine.first") + (within - within % F.col("_mine.per")) / F.col("_mine.per")
    return placed.withColumn("_mine", mine).select(*kept, sequence.cast("long").alias("sequence_id"), spot.alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the token ids of each sequence, whose size the capacity bounds."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("_parts", F.lit(b""), lambda made, part: F.concat(made, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select("sequence_id", "length", joined.alias("ids"))
