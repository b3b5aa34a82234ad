"""Exact top-k by integer inner product with an impact-ordered index, score at a time.

Vectors are quantised to integers and dealt into shards, near vectors to the same one. A shard's index, written once,
holds per dimension its vectors in order of their value, cut into posting segments of equal levels. For a query q, after
both sides are scaled to like lengths, q.x = (|q|^2 + |x|^2) / 2 - sum of (q_d - x_d)^2 / 2, so a posting's impact is how
much it takes from the most that its vector can still score: the square of the distance between the query's component
and the segment's levels, halved. Segments are taken by descending quantised impact. After every step the best vectors
are scored exactly; those whose bound is below the k-th exact score are proven out, and once the others are few they are
all scored from their whole vectors. If that never happens all postings are taken, so the answer is exact either way.

Every query first searches the shard of its own cell; the k-th score found there is the threshold with which it goes to
the others, where the shard's centre and radius may prove it out before any posting is read. Cells are the nearest of at
most ``CELLS`` centres drawn from the rows; a larger cell is split by row number, so shards have a bounded number of
postings whatever the table, and a vector that fills a third of the table is spread over many. Queries travel in blocks.

Ties go to the smaller id. Vectors that are NULL, empty, or hold NULL, NaN or infinity take no part, neither as query
nor as candidate; nor do rows with a NULL id. Shorter vectors count as padded with zeros. Repeated ids are repeated
candidates and repeated queries, each with its own answer, and a query's own id is never its candidate. Components are
exact integers of any size up to 2^500 (kept within that); scores rank exactly up to 2^123 and are written as the nearest
long where they exceed one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

SHARD_ROWS = 16_384
POSTINGS = 1 << 20
QUERY_ROWS = 512
MOST_QUERY_ROWS = 4_096
CELLS = 1_024
SCALE = 64.0
BOUND = 2.0**500
LEVELS = 128
STEPS = (0.03, 0.15, 0.25, 0.32, 0.4, 0.55, 1.0)
PART = 60_000  # postings added at once: what stays in a processor's cache
HIGH = 1 << 61  # scores travel as high * 2^62 + low


def usable(vector: str, key: str) -> Column:
    """Rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad


def quantised(vector: str, scale: float = SCALE) -> Column:
    """floor(scale * component), an integer held in a double; from 2^52 on every double is one."""

    def one(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        return F.when(F.abs(scaled) < F.lit(2.0**52), F.floor(scaled).cast("double")).otherwise(F.least(F.lit(BOUND), F.greatest(F.lit(-BOUND), scaled)))

    return F.transform(vector, one)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    ends = flat.offsets.to_numpy()
    out = np.zeros((len(flat), width))
    counts = np.diff(ends)
    out[np.arange(width)[None, :] < counts[:, None]] = flat.values.to_numpy()[ends[0] : ends[-1]]
    return out


def _packed(matrix: np.ndarray) -> bytes:
    return matrix.astype("<i4" if np.abs(matrix).max(initial=0) < 1 << 31 else "<f8").tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * width else "<f8").reshape(rows, width).astype(np.float64)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integers held in doubles: int64 where all are sure to fit, else Python integers."""
    reach, peak = np.abs(rows).max(axis=1, initial=0), float(np.abs(query).max(initial=0))
    most = reach * peak * max(len(query), 1)
    if (most < 2.0**52).all():
        return (rows @ query).astype(np.int64)
    fits = (most < 2.0**62) & (reach < 2.0**62)
    if fits.all() and peak < 2.0**62:
        return rows.astype(np.int64) @ query.astype(np.int64)
    out = np.empty(len(rows), object)
    if peak < 2.0**62:
        out[fits] = (rows[fits].astype(np.int64) @ query.astype(np.int64)).astype(object)
    else:
        fits[:] = False
    whole = [int(x) for x in query]
    for i in np.flatnonzero(~fits):
        out[i] = sum(int(x) * y for x, y in zip(rows[i], whole, strict=True))
    return out


class ImpactIndex:
    """Posting segments of one shard: per dimension the rows by value, cut where the quantised level changes."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, rows: np.ndarray | None = None):
        self.ids, self.matrix = ids, matrix
        n, width = matrix.shape
        self.rows = rows if rows is not None else np.ascontiguousarray(np.argsort(matrix, axis=0, kind="stable").T.astype("<u2" if n <= 1 << 16 else "<u4"))
        values = np.take_along_axis(matrix.T, self.rows, axis=1)
        low, high = values[:, :1], values[:, -1:]
        step = np.maximum(1.0, np.ceil((high - low + 1) / LEVELS))
        self.edges = low + step * np.arange(LEVELS + 1)[None, :]
        self.starts = np.stack([np.searchsorted(v, e) for v, e in zip(values, self.edges, strict=True)])
        self.starts[:, -1] = n
        self.sizes = np.diff(self.starts, axis=1)
        self.norms = np.einsum("ij,ij->i", matrix, matrix)
        self.centre = matrix.mean(axis=0)
        self.radius = float(np.sqrt(((matrix - self.centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        self.taken = self.postings = 0

    def may_reach(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Queries for which some vector of the ball around the centre reaches the threshold."""
        length = np.sqrt((queries**2).sum(axis=1))
        error = 1e-9 * length * (np.sqrt((self.centre**2).sum()) + self.radius)
        return queries @ self.centre + length * self.radius + error >= least

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and exact scores of the best k vectors, best first; those below ``least`` may be missing."""
        n, width = self.matrix.shape
        possible = np.flatnonzero(self.ids != own)
        self.postings += n * width
        if not len(possible) or k <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        norm, usual = float(query @ query), float(self.norms.mean())
        ratio = np.sqrt(usual / norm) if usual > 0 and norm > 0 else 1.0
        # the most each vector can score, with more than all roundings to come on top
        most = (self.norms / ratio + norm * ratio) / 2 * (1 + (width + 16) * 2.0**-49)
        side = query * ratio
        gap = np.maximum(0.0, np.maximum(self.edges[:, :-1] - side[:, None], side[:, None] - (self.edges[:, 1:] - 1)))
        impact = gap * gap / (2 * ratio) * (1 - 2.0**-40)
        peak = float(impact.max())
        level = np.ceil(impact * (4095 / peak)).astype(np.int64) if peak > 0 else np.zeros(impact.shape, np.int64)
        below = self.edges[:, :-1] <= side[:, None]  # a dimension's taken segments are one run from each end
        mass = np.cumsum(np.bincount(level.ravel(), self.sizes.ravel(), 4096)[::-1])[::-1]
        few, last = max(4 * k, n // 8), 4096
        wanted = min(k, len(possible))
        for share in STEPS:
            cut = 1 if share == 1.0 else max(1, 4096 - int(np.searchsorted(mass[::-1], share * n * width, side="right")))
            if cut < last:
                new = (level >= cut) & (level < last) & (self.sizes > 0)
                last = cut
                runs = []
                for mask in (new & below, new & ~below):
                    dims = np.flatnonzero(mask.any(axis=1))
                    first, end = mask[dims].argmax(axis=1), LEVELS - mask[dims][:, ::-1].argmax(axis=1)
                    runs += zip(dims.tolist(), self.starts[dims, first].tolist(), self.starts[dims, end].tolist(), first.tolist(), end.tolist(), strict=True)
                each = -(-len(runs) // max(1, sum(b - a for _, a, b, _, _ in runs) // PART))
                for begin in range(0, len(runs), max(1, each)):
                    part = runs[begin : begin + each]
                    rows = np.concatenate([self.rows[d, a:b] for d, a, b, _, _ in part])
                    gains = np.repeat(np.concatenate([impact[d, f:e] for d, _, _, f, e in part]), np.concatenate([self.sizes[d, f:e] for d, _, _, f, e in part]))
                    most -= np.bincount(rows, gains, n)
                    self.taken += len(rows)
            bound = most[possible]
            top = possible if len(possible) <= 4 * k else possible[np.argpartition(-bound, 4 * k)[: 4 * k]]
            scores = exact_scores(self.matrix[top], query)
            if len(top) >= wanted:
                kth = np.sort(scores)[len(top) - wanted]
                if wanted == k:
                    least = max(least, float(kth))
            possible = possible[bound >= least - abs(least) * 2.0**-50]
            if len(possible) <= few or cut == 1:
                break
        score = exact_scores(self.matrix[possible], query)
        best = np.lexsort((self.ids[possible], -score))[:k] if score.dtype != object else np.array(
            sorted(range(len(score)), key=lambda i: (-score[i], self.ids[possible[i]]))[:k], np.int64)
        return possible[best], score[best]


def _parts(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) of high * 2^62 + low, which order like the scores."""
    if scores.dtype != object:
        return scores >> 62, scores & ((1 << 62) - 1)
    kept = [max(-HIGH << 62, min((HIGH << 62) - 1, s)) for s in scores]
    return np.array([s >> 62 for s in kept], np.int64), np.array([s & ((1 << 62) - 1) for s in kept], np.int64)


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("u", F.monotonically_increasing_id())


def _to_cells(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the nearest centre of every row."""
    width, half = centres.shape[1], (centres**2).sum(axis=1) / 2

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cell = np.concatenate([np.zeros(0, np.int64), *[
                (part @ centres.T - half).argmax(axis=1) for part in np.array_split(_matrix(table.column("v"), width), max(1, len(table) // 1024))
            ]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "u", "cell"])

    return df.mapInArrow(place, "id long, v array<double>, u long, cell int")


def _pack_queries(df: DataFrame, width: int) -> DataFrame:
    """One row per (shard, block) with the block's queries as binaries; ``shard`` is -1 for those who go to all."""

    def pack(table: pa.Table) -> pa.Table:
        data = {name: pa.array([table.column(name).to_numpy().astype(kind).tobytes()]) for name, kind in (("id", "<i8"), ("u", "<i8"), ("home", "<i8"), ("least", "<f8"))}
        return pa.table({**{name: pa.array([table.column(name)[0].as_py()], pa.int64()) for name in ("to", "block")}, **data, "data": pa.array([_packed(_matrix(table.column("v"), width))])})

    return df.groupBy("to", "block").applyInArrow(pack, "to long, block long, id binary, u binary, home binary, least binary, data binary")


def _pack_index(df: DataFrame, width: int) -> DataFrame:
    """One row per shard: ids, vectors, and the rows of every dimension by value, in order of id."""

    def pack(table: pa.Table) -> pa.Table:
        ids, matrix = table.column("id").to_numpy(), _matrix(table.column("v"), width)
        order = np.argsort(ids, kind="stable")
        made = ImpactIndex(ids[order], matrix[order])
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "ids": pa.array([made.ids.astype("<i8").tobytes()]),
            "vectors": pa.array([_packed(made.matrix)]), "rows": pa.array([made.rows.tobytes()]),
        })

    return df.select("id", "v", "shard").groupBy("shard").applyInArrow(pack, "shard long, ids binary, vectors binary, rows binary")


def _run(index: DataFrame, blocks: DataFrame, tasks: int, width: int, k: int) -> DataFrame:
    """Every block against the shard it meets.

    Spark does not see how often ``blocks`` are repeated, so it would take them for small and gather all of them on the driver.
    """

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                order = np.frombuffer(row["rows"], "<u2" if len(row["rows"]) == 2 * len(ids) * width else "<u4").reshape(width, len(ids))
                made = ImpactIndex(ids, _unpacked(row["vectors"], len(ids), width), order)
                own, number, home, least = (np.frombuffer(row[c], t) for c, t in (("id", "<i8"), ("u", "<i8"), ("home", "<i8"), ("least", "<f8")))
                queries = _unpacked(row["data"], len(own), width)
                todo = np.flatnonzero(made.may_reach(queries, least) & ((home != row["shard"]) | (row["to"] >= 0)))
                for i in todo:
                    at, score = made.search(queries[i], int(own[i]), k, float(least[i]))
                    high, low = _parts(score)
                    yield pa.RecordBatch.from_pydict({
                        "q": np.full(len(at), number[i]), "query_id": np.full(len(at), own[i]), "vec_id": ids[at], "high": high, "low": low,
                    })

    return index.join(blocks.hint("merge"), "shard").repartition(tasks, "shard", "block").mapInArrow(find, "q long, query_id long, vec_id long, high long, low long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) with the k best candidates of every query."""

    def ready(df: DataFrame, name: str) -> DataFrame:
        return materialize(_number(df.where(usable(vector, key)).select(F.col(key).cast("long").alias("id"), quantised(vector, scale).alias("v"))), name)

    rows, asked = ready(vectors, "vectors"), ready(queries, "queries")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    wide = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(size.w or 1, wide.w or 1)
    full = min(SHARD_ROWS, max(256, POSTINGS // width))
    cells = min(CELLS, max(1, -(-size.n // full)))
    if cells > 1:
        drawn = rows.orderBy(F.xxhash64("u"), "u").limit(cells).select("v").toArrow()
        centres = _matrix(drawn.column("v"), width)
        rows, asked = materialize(_to_cells(rows, centres), "celled"), materialize(_to_cells(asked, centres), "asked")
    else:
        rows, asked = rows.withColumn("cell", F.lit(0)), asked.withColumn("cell", F.lit(0))
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [max(1, -(-counts.get(c, 0) // full)) for c in range(cells)]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    shards = first[-1]
    sizes = F.array(*[F.lit(x) for x in parts])
    starts = F.array(*[F.lit(x) for x in first[:-1]])
    home = (F.get(starts, F.col("cell")) + F.pmod(F.xxhash64("u"), F.get(sizes, F.col("cell")))).cast("long")
    index = materialize(_pack_index(rows.withColumn("shard", home), width), "index")

    def blocks(df: DataFrame, each: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("u", F.lit(2)), F.lit(each)).cast("long"))

    busiest = asked.groupBy(home.alias("home")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    near = blocks(asked.withColumn("home", home).withColumn("to", home).withColumn("least", F.lit(float("-inf"))), -(-busiest // QUERY_ROWS))
    near = _pack_queries(near, width).withColumn("shard", F.col("to"))
    found = materialize(_run(index, near, min(4096, shards * -(-busiest // QUERY_ROWS)), width, k), "near")
    if shards > 1:
        score = F.col("high").cast("double") * F.lit(2.0**62) + F.col("low").cast("double")
        known = found.groupBy("q").agg(F.count("*").alias("m"), F.min(score).alias("kth"))
        known = known.select(F.col("q").alias("u"), F.when(F.col("m") >= k, F.col("kth") - F.abs("kth") * 2.0**-48).alias("kth"))
        far = asked.withColumn("home", home).join(known, "u", "left").withColumn("least", F.coalesce("kth", F.lit(float("-inf")))).withColumn("to", F.lit(-1).cast("long"))
        each = min(MOST_QUERY_ROWS, max(QUERY_ROWS, wide.n * shards // CELLS))
        number = max(1, -(-wide.n // each))
        far = _pack_queries(blocks(far, number), width).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        found = found.unionByName(_run(index, far, min(4096, shards * number), width, k))
    order = Window.partitionBy("q").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # the two parts as one long: high is 0 or -1 up to 2^62, one further on each side still fits
    score = F.when(F.col("high") > 1, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(F.col("high") * F.lit(1 << 62) + F.col("low"))
    return best.select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
