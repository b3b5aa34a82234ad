"""Vector code compression: a vector becomes one small code per part, the nearest entry of that part's codebook.

Nearest entries are found by Orchard's search: every entry has a list of all entries of its codebook by distance. From the
best entry so far its list is read in order; an entry that improves the distance makes the search go on in its own list,
entries already seen are marked and not computed again, and the search ends where the list goes beyond twice the present
distance, since by the triangle inequality no later entry can be nearer. All of it in exact integers, for all parts of a block
of vectors at once. Codebooks are refined by rounds of assignment and floored means; a task sends one row of sums per entry.

Defined results: vectors that are NULL or hold NULL or non-finite components are dropped. Vectors of another width than the
most frequent one (ties: the larger), of a width that ``parts`` does not divide, or with a component of 2**62 or more
after scaling stay, with NULL code and error. An error beyond 64 bits is NULL. Rows without an id take part but start no
entry; rows that share an id are ordered by their components. Further columns pass through; their names do not matter, but
columns named like those added (``code``, ``error``) are replaced. Empty tables give empty results and codebooks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import smallest_rows

BLOCK = 4096
LARGEST = 1 << 62
_NUMBER = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` lists integer components; ``width`` is that of the whole vectors, ``scale`` their factor."""

    entries: list[list[list[int]]]
    width: int
    scale: int

    def sha256(self) -> str:
        """Digest of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


class Orchard:
    """Nearest entries in several codebooks of one size, by distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.size, width = entries.shape
        self.rows = entries.reshape(self.parts * self.size, width)
        gaps = ((entries[:, :, None] - entries[:, None]) ** 2).sum(axis=3)
        order = np.argsort(gaps, axis=2, kind="stable")
        self.lists = order.reshape(self.parts * self.size, self.size)
        self.gaps = np.take_along_axis(gaps, order, axis=2).reshape(self.parts * self.size, self.size)
        self.by_first = np.argsort(entries[:, :, 0], axis=1, kind="stable") if width else None
        self.computed = 0

    def _starts(self, points: np.ndarray) -> np.ndarray:
        """An entry near each part in its first component, from which the search begins."""
        out = np.zeros(points.shape[:2], np.int64)
        for part in range(self.parts if self.by_first is not None else 0):
            order = self.by_first[part]
            firsts = self.rows[part * self.size + order, 0]
            out[:, part] = order[np.minimum(np.searchsorted(firsts, points[:, part, 0]), self.size - 1)]
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of ``points`` (vectors x parts x width); ties go to the lower entry."""
        count = len(points)
        flat = points.reshape(count * self.parts, points.shape[2])
        base = np.tile(np.arange(self.parts) * self.size, count)
        best = base + self._starts(points).reshape(-1)
        distance = ((flat - self.rows[best]) ** 2).sum(axis=1)
        self.computed += len(flat)
        marked = np.zeros((len(flat), self.size), bool)
        live = np.arange(len(flat))
        marked[live, best - base] = True
        place = np.zeros(len(flat), np.int64)
        while len(live):
            entry, spot = best[live], place[live]
            within = (self.gaps[entry, spot] <= 4 * distance[live]).astype(bool)
            live, entry, spot = live[within], entry[within], spot[within]
            near = self.lists[entry, spot]
            place[live] = spot + 1
            fresh = ~marked[live, near]
            looked, near = live[fresh], near[fresh]
            marked[looked, near] = True
            other = base[looked] + near
            there = ((flat[looked] - self.rows[other]) ** 2).sum(axis=1)
            self.computed += len(looked)
            nearer = (there < distance[looked]) | ((there == distance[looked]) & (other < best[looked]))
            nearer = nearer.astype(bool)
            moved = looked[nearer]
            best[moved], distance[moved], place[moved] = other[nearer], there[nearer], 0
            live = live[place[live] < self.size]
        return (best - base).reshape(count, self.parts), distance.reshape(count, self.parts)


def _fits(reach: int, width: int) -> bool:
    """Whether four times a squared distance of parts of ``width`` components up to ``reach`` stays within 64 bits."""
    return 16 * width * reach * reach < 1 << 63


class _Searcher:
    """Blocks of vectors to nearest entries: 64-bit integers where they are exact, Python's integers elsewhere."""

    def __init__(self, books: Codebooks):
        self.books, self.parts = books, len(books.entries)
        self.inner = books.width // self.parts
        self.exact = np.array(books.entries, dtype=object).reshape(self.parts, len(books.entries[0]), self.inner)
        self.reach = max((abs(x) for x in self.exact.reshape(-1)), default=0)
        self.made: dict[bool, Orchard] = {}

    def blocks(self, batch: pa.RecordBatch, column: str):
        """(first row, integer parts, nearest entries, squared distances) of a batch's usable vectors."""
        vectors = batch.column(column)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), self.books.width)
        for at in range(0, len(flat), BLOCK):
            whole = np.floor(flat[at : at + BLOCK] * self.books.scale)
            reach = max(self.reach, int(np.abs(whole).max(initial=0)))
            small = _fits(reach, max(self.inner, 1))
            if small not in self.made:
                self.made[small] = Orchard(self.exact.astype(np.int64) if small else self.exact)
            points = whole.astype(np.int64)
            points = (points if small else points.astype(object)).reshape(len(whole), self.parts, self.inner)
            yield at, points, *self.made[small].nearest(points)


def usable(column: Column | str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    column = F.col(column) if isinstance(column, str) else column
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def _codable(column: str, width: int, parts: int, scale: int) -> Column:
    if width % parts:
        return F.lit(False)
    small = F.forall(column, lambda x: F.abs(x.cast("double") * scale) < float(LARGEST))
    return F.coalesce((F.size(column) == width) & small, F.lit(False))


def _sums(rows: DataFrame, books: Codebooks, column: str) -> DataFrame:
    """(part, entry, rows, one sum per position): what each task's vectors add to the entries nearest to them."""
    parts, size, inner = len(books.entries), len(books.entries[0]), books.width // len(books.entries)

    def run(batches):
        searcher = _Searcher(books)
        counts = np.zeros(parts * size, np.int64)
        totals = [[0] * inner for _ in range(parts * size)]
        for batch in batches:
            for _, points, entry, _ in searcher.blocks(batch, column):
                where = (entry + np.arange(parts) * size).reshape(-1)
                flat = points.reshape(len(where), inner)
                order = np.argsort(where, kind="stable")
                found, starts = np.unique(where[order], return_index=True)
                sums = np.add.reduceat(flat[order].astype(object), starts, axis=0) if inner else np.zeros((len(found), 0), object)
                counts[found] += np.diff([*starts, len(where)])
                for spot, added in zip(found.tolist(), sums.tolist(), strict=True):
                    totals[spot] = [a + int(b) for a, b in zip(totals[spot], added, strict=True)]
        used = np.flatnonzero(counts).tolist()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([u // size for u in used], pa.int32()), "entry": pa.array([u % size for u in used], pa.int32()),
            "rows": pa.array(counts[used], pa.int64()),
            "sums": pa.array([[Decimal(x) for x in totals[u]] for u in used], pa.list_(_NUMBER)),
        })

    each = rows.select(column).mapInArrow(run, "part int, entry int, rows bigint, sums array<decimal(38,0)>")
    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(inner)]
    return each.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *added)


def train(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", column: str = "embedding"
) -> Codebooks:
    """Codebooks that start as the parts of the ``entries`` vectors with the smallest ids, refined by ``rounds`` of floored means.

    What reaches the driver is one row per entry and round, and a histogram of ids of bounded size.
    """
    kept = vectors.where(usable(column)).select(key, column)
    widths = kept.groupBy(F.size(column).alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    if widths is None or widths["w"] % parts:
        return Codebooks([[] for _ in range(parts)], widths["w"] if widths else 0, scale)
    width, inner = widths["w"], widths["w"] // parts
    kept = kept.where(_codable(column, width, parts, scale))
    first = smallest_rows(kept, key, entries, [column]).collect()
    grid = [[math.floor(float(x) * scale) for x in row[column]] for row in first]
    books = Codebooks([[v[p * inner : (p + 1) * inner] for v in grid] for p in range(parts)], width, scale)
    for _ in range(rounds if grid else 0):
        means = [list(part) for part in books.entries]
        for row in _sums(kept, books, column).collect():
            means[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["rows"] for i in range(inner)]
        books = Codebooks(means, width, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """Usable vectors with ``code`` (two hexadecimal digits per part) and ``error``, the squared distances summed over parts."""
    parts, schema = len(books.entries), vectors.schema
    names = [f.name for f in schema if f.name not in ("code", "error", "_codable")]
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in names] + ["code string", "error bigint"])

    def run(batches):
        searcher = _Searcher(books)
        for batch in batches:
            codable = batch.column("_codable").to_numpy(zero_copy_only=False).astype(bool)
            codes: list[str | None] = [None] * len(codable)
            errors: list[int | None] = [None] * len(codable)
            rows = np.flatnonzero(codable)
            for at, _, entry, distance in searcher.blocks(batch.filter(pa.array(codable)), column):
                told = entry.astype(np.uint8).tobytes().hex()
                for i, error in enumerate(distance.sum(axis=1).tolist() if distance.dtype == object else _totals(distance)):
                    codes[rows[at + i]] = told[2 * parts * i : 2 * parts * (i + 1)]
                    errors[rows[at + i]] = error if error < 1 << 63 else None
            made = [batch.column(n) for n in names] + [pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[*names, "code", "error"])

    known = _codable(column, books.width, parts, books.scale) if books.entries[0] else F.lit(False)
    return vectors.where(usable(column)).select(*names, known.alias("_codable")).mapInArrow(run, types)


def _totals(distance: np.ndarray) -> list[int]:
    """Sums over parts; in Python's integers where 64 bits might not hold them."""
    if int(distance.max(initial=0)) * distance.shape[1] < 1 << 63:
        return distance.sum(axis=1).tolist()
    return distance.astype(object).sum(axis=1).tolist()


def with_label_errors(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """Add the sum of errors of all rows with the same label, NULL labels together.

    Sums are combined in each task, and only one row per label meets the rows, so a frequent label gathers nowhere; a
    sum beyond 64 bits is NULL.
    """
    total = F.sum(F.col(error).cast("decimal(38,0)")).try_cast("bigint").alias("_sum")
    sums = coded.groupBy(F.col(label).alias("_label")).agg(total)
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").select(*[c for c in coded.columns if c != out], F.col("_sum").alias(out))
