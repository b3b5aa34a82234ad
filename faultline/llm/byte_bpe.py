"""Byte-level BPE encoding and decoding with numpy.

Texts are split by the tokenizer's pattern. Every piece that is not in the vocabulary becomes a row of a padded
matrix of byte ranks; rows of similar length share a matrix. In each round every row looks up the ranks of all its
neighbouring pairs in a hashed table and merges its leftmost pair of the lowest rank; finished rows leave. A row of more
than ``LONG`` bytes would pay for its whole length in every round: it keeps its places by rank and takes all places of
the lowest rank in one round, leftmost first, as long as no pair with the new id has a lower rank; the ids are the same
and the work grows with the merges. Pieces are encoded once per slice and remembered per worker in a cache that is emptied when full.

NULL text counts as empty and gives no ids. Repeated rows are encoded one by one. No row is cut, so a text of any
length is encoded whole. Other columns pass through; columns that have the names of results are replaced.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from faultline.llm.textbytes import repeat_ranges, small_batches, text_slices

CACHE_PIECES = 100_000
SLICE = 1 << 19
LONG = 512
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a tiktoken file, with a hashed table from a pair of ids to the id it merges into."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern).findall
        self.forget()
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        top = max(self.ranks.values()) + 1
        words = [b""] * top
        for word, rank in self.ranks.items():
            words[rank] = word
        lengths = np.array([len(w) for w in words])
        self.starts = np.cumsum(lengths) - lengths
        self.lengths = lengths
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        pairs = [
            (self.ranks[w[:i]], self.ranks[w[i:]], r)
            for w, r in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks
        ]
        pairs = np.array(pairs, np.int64).reshape(-1, 3)
        self.least = np.full(top, NONE)  # the lowest rank of the pairs that an id is part of
        for side in (0, 1):
            np.minimum.at(self.least, pairs[:, side], pairs[:, 2].astype(np.int32))
        self._build_table(pairs)

    def _build_table(self, pairs: np.ndarray) -> None:
        keys = (pairs[:, 0].astype(np.uint64) << np.uint64(32)) | pairs[:, 1].astype(np.uint64)
        self.bits = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.table_keys = np.full(size, np.uint64(2**64 - 1))
        self.table_ranks = np.full(size, NONE)
        slots, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):  # all keys advance together; the first of each free slot stays
            self.probes += 1
            free = self.table_keys[slots[left]] == np.uint64(2**64 - 1)
            _, first = np.unique(slots[left], return_index=True)
            takes = np.zeros(len(left), bool)
            takes[first] = True
            takes &= free
            self.table_keys[slots[left[takes]]] = keys[left[takes]]
            self.table_ranks[slots[left[takes]]] = pairs[left[takes], 2]
            left = left[~takes]
            slots[left] = (slots[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, ``NONE`` where a pair does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slot(keys)
        out = np.where(self.table_keys[slots] == keys, self.table_ranks[slots], NONE)
        size, open_ = len(self.table_keys), np.flatnonzero((self.table_keys[slots] != keys) & (self.table_ranks[slots] != NONE))
        for step in range(1, self.probes + 1):
            if not len(open_):
                break
            at = (slots[open_] + step) % size
            hit = self.table_keys[at] == keys[open_]
            out[open_[hit]] = self.table_ranks[at[hit]]
            open_ = open_[~hit & (self.table_ranks[at] != NONE)]
        return out

    def merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a padded matrix until nothing merges: all ids in row order, and the length of each row."""
        done, done_lengths = ids.copy(), lengths.copy()
        rows = np.arange(len(ids))
        ranks = np.full((len(ids), max(ids.shape[1] - 1, 1)), NONE)
        if ids.shape[1] > 1:
            ranks[:, :] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(ranks.shape)
        ranks[np.arange(ranks.shape[1])[None, :] >= lengths[:, None] - 1] = NONE
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == NONE
            if over.any():
                done[rows[over], : ids.shape[1]] = ids[over]
                done_lengths[rows[over]] = lengths[over]
                keep = ~over
                rows, ids, lengths, ranks, at, best = rows[keep], ids[keep], lengths[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
                width = int(lengths.max())
                ids, ranks = ids[:, :width], ranks[:, : max(width - 1, 1)]
            n, width = ids.shape
            here = np.arange(n)
            later = np.arange(width)[None, :] > at[:, None]
            source = np.minimum(np.arange(width)[None, :] + later, width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[here, at] = best
            lengths = lengths - 1
            later = np.arange(ranks.shape[1])[None, :] > at[:, None]
            source = np.minimum(np.arange(ranks.shape[1])[None, :] + later, ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            ranks[np.arange(ranks.shape[1])[None, :] >= lengths[:, None] - 1] = NONE
            right = at < lengths - 1
            ranks[here[right], at[right]] = self.pair_ranks(ids[here[right], at[right]], ids[here[right], at[right] + 1])
            left = at > 0
            ranks[here[left], at[left] - 1] = self.pair_ranks(ids[here[left], at[left] - 1], ids[here[left], at[left]])
        return done[np.arange(done.shape[1])[None, :] < done_lengths[:, None]], done_lengths

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The ids of one long row, whose places are linked in a list and grouped by the rank of the pair that starts there."""
        n = len(ids)
        ids, after, before = ids.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.append(self.pair_ranks(ids[:-1], ids[1:]), NONE)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[ranks[at] != NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(ranks[at])) + 1
            for part in np.split(at, cuts) if len(at) else []:
                rank = int(ranks[part[0]])
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(part)

        add(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            if not len(at):
                continue
            if self.least[rank] <= rank:
                at, rest = at[:1], at[1:]
                if len(rest):
                    places[rank] = [rest]
                    heapq.heappush(heap, rank)
            else:  # of places that overlap in a chain, every other one
                heads = np.append(True, at[1:] != after[at[:-1]])
                turn = np.arange(len(at)) - np.maximum.accumulate(np.where(heads, np.arange(len(at)), 0))
                at = at[turn % 2 == 0]
            gone = after[at]
            alive[gone], ranks[gone], ids[at] = False, NONE, rank
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            ranks[at] = NONE
            new = np.concatenate([at[inside], before[at][before[at] >= 0]])
            new = np.unique(new)
            ranks[new] = self.pair_ranks(ids[new], ids[after[new]])
            add(new)
        return ids[alive]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, with the start and length of each: whole words of the vocabulary directly, the rest in length buckets."""
        raw = [p.encode("utf-8") for p in pieces]
        known = np.fromiter((self.ranks.get(w, -1) for w in raw), np.int32, len(raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.flatnonzero(known >= 0)
        starts, lengths = np.zeros(len(raw), np.int64), np.ones(len(raw), np.int64)
        starts[whole] = np.arange(len(whole))
        flat, end = [known[whole]], len(whole)
        bucket = np.where(sizes <= 16, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        bucket[whole] = 0
        for width in np.unique(bucket[bucket > 0]):
            members, step = np.flatnonzero(bucket == width), max(1, (1 << 20) // int(width))
            for begin in range(0, len(members), step):
                part = members[begin : begin + step]
                if width > LONG:
                    rows = [self.merge_long(self.byte_ids[np.frombuffer(raw[i], np.uint8)]) for i in part]
                    merged, counts = np.concatenate(rows), np.array([len(x) for x in rows])
                    starts[part], lengths[part] = end + np.cumsum(counts) - counts, counts
                    flat.append(merged)
                    end += len(merged)
                    continue
                ids = np.zeros((len(part), int(width)), np.int32)
                ids[np.arange(width)[None, :] < sizes[part][:, None]] = self.byte_ids[np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)]
                merged, counts = self.merge_rows(ids, sizes[part])
                starts[part] = end + np.cumsum(counts) - counts
                lengths[part] = counts
                flat.append(merged)
                end += len(merged)
        return np.concatenate(flat), starts, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the offsets of each text in them."""
        if len(self.cache) > CACHE_PIECES:
            self.forget()
        split = [self.split(t) for t in texts]
        pieces = list(chain.from_iterable(split))
        new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        ids, starts, lengths = self.encode_pieces(new)
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
        self.pool_starts = np.concatenate([self.pool_starts, starts + len(self.pool)])
        self.pool_lengths = np.concatenate([self.pool_lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])
        slots = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        counts = self.pool_lengths[slots]
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = ends[np.concatenate([[0], np.cumsum([len(x) for x in split], dtype=np.int64)])]
        return self.pool[repeat_ranges(self.pool_starts[slots], counts)], offsets

    def forget(self) -> None:
        """Empty the cache of pieces."""
        self.cache: dict[str, int] = {}
        self.pool, self.pool_starts, self.pool_lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.bytes[repeat_ranges(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file, once per worker."""
    return Vocabulary(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", packed: bool = False, decoded: str | None = None) -> DataFrame:
    """Add the ids of each text: an array of int or, if ``packed``, little-endian unsigned 32-bit integers in one binary.

    With ``decoded`` the bytes that the ids decode to are added too, in the same pass.
    """
    keep = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = StructType([*keep, StructField(ids, BinaryType() if packed else ArrayType(IntegerType(), False), False)])
    if decoded is not None:
        schema = schema.add(StructField(decoded, BinaryType(), False))

    def run(batches):
        vocabulary = load(path, pattern)
        for rows, _, _ in text_slices(batches, text, SLICE):
            found, offsets = vocabulary.encode([t or "" for t in rows.column(text).to_pylist()])
            if packed:
                column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(found.astype("<u4"))])
            else:
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found))
            more = []
            if decoded is not None:
                more = [pa.array([vocabulary.decode(found[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in keep], column, *more], names=[f.name for f in schema.fields])
        vocabulary.forget()  # the worker may wait for other work with it
        pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that the ids (either form) stand for; NULL ids count as none."""
    keep = [f for f in df.schema.fields if f.name != out]
    schema = StructType([*keep, StructField(out, BinaryType(), False)])

    def run(batches):
        vocabulary = load(path, pattern)
        for batch in batches:
            rows = batch.column(ids).to_pylist()
            column = [vocabulary.decode(np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.asarray(x or [], np.int64)) for x in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array(column, pa.binary())], names=[f.name for f in schema.fields])

    return small_batches(df).mapInArrow(run, schema)
