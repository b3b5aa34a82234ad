"""Near duplicates among embeddings with a robust-pruned flat graph.

Equal vectors become one node that counts its copies. Nodes are dealt into overlapping cells (their nearest
centroids; the centroids are fitted on a bounded sample, all nodes are indexed). Inside a cell, overlapping cluster
shards each build a graph: nearest candidates, thinned by robust pruning so that edges point in different directions.
The shards' adjacency lists are united, with reverse edges, and nodes that the medoids do not reach are tied in. Every
node then searches the graphs of the cells it visits: a greedy beam from the medoids (and from itself where it lives
there), and from each neighbour within range on to all its neighbours, until no neighbour in range is left. A found
pair counts only if its cosine in double precision reaches the threshold.

The recall of the links is audited against brute force for two bounded sets of nodes, some drawn from all and some
that are known to have links, as a mean over nodes, so that large groups hide nothing; below the goal the search is
repeated with twice as many cells to visit, at last all. Counts of links are added up where the pairs are found and
only one edge per node and cell leaves it, so a group of thousands of near copies sends no pairs anywhere. Cells with
too many nodes are split by hash, and each part is searched by all visitors of the cell.

Vectors that are NULL, empty, zero, or hold NULL, NaN or infinity link with nothing and are kept, each its own
component; vectors of another length than most are compared among their length only. Equal rows are copies of each
other; a repeated id counts each row as a vector. Extra columns are ignored; rows with a NULL id link with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.topk_search import usable
from faultline.session import materialize

THRESHOLD = 0.95
CELL_NODES, PART_NODES, QUERY_NODES, MOST_CELLS = 2048, 4096, 1024, 4096
SHARD_NODES, CANDIDATES, DEGREE, ALPHA = 512, 40, 14, 1.2
HOMES, VISITS, MEDOIDS, BEAM, WIDTH = 2, 5, 8, 24, 4
SAMPLE, DRAWN, AUDIT, GOAL = 20_000, 2_048, 256, 0.99
SLACK = 1e-4


def _centroids(points: np.ndarray, count: int, seed: int, rounds: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        near = (points @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, near, points)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(norm > 0, total / np.maximum(norm, 1e-12), centers)
    return centers


def _pruned(sims: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Which of each node's candidates (most similar first) stay: one is dropped if a kept one is much closer to it than the node."""
    n, width = near.shape
    away = np.sqrt(np.maximum(0, 2 - 2 * sims))
    own = np.take_along_axis(away, near, axis=1)
    alive, kept = np.ones((n, width), bool), np.zeros((n, width), bool)
    for j in range(width):
        pick = alive[:, j] & (kept.sum(axis=1) < degree)
        kept[:, j] = pick
        between = away[near[:, j][:, None], near]
        alive &= ~(pick[:, None] & (alpha * between <= own))
    return kept


class FlatGraph:
    """Graph over the unit vectors of one cell part."""

    def __init__(self, points: np.ndarray, near: np.ndarray, medoids: np.ndarray):
        self.points, self.near, self.medoids = points.astype(np.float32), near, medoids

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 1) -> FlatGraph:
        self = cls(points, np.zeros((len(points), 0), np.int32), np.zeros(0, np.int64))
        n, edges = len(points), []
        shards = max(1, -(-n // SHARD_NODES))
        centers = _centroids(self.points, shards, seed)
        near = np.argsort(-(self.points @ centers.T), axis=1)[:, : min(HOMES, shards)]
        for s in range(shards):
            members = np.flatnonzero((near == s).any(axis=1))
            for start in range(0, len(members), 4 * SHARD_NODES):  # a crowded shard is built in pieces, its nodes in another shard too
                piece = members[start : start + 4 * SHARD_NODES]
                width = min(CANDIDATES, len(piece) - 1)
                if width < 1:
                    continue
                sims = self.points[piece] @ self.points[piece].T
                ranked = sims - 4 * np.eye(len(piece), dtype=np.float32)
                top = np.argpartition(-ranked, width - 1, axis=1)[:, :width]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(ranked, top, axis=1), axis=1), axis=1)
                row, place = np.nonzero(_pruned(sims, top))
                edges.append(np.stack([piece[row], piece[top[row, place]]]))
        found = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        self.medoids = self._medoids(centers)
        ring = np.random.default_rng(seed).permutation(n)  # one long link per node
        links = np.concatenate([found, found[::-1], np.stack([ring, np.roll(ring, 1)])], axis=1)
        self._lists(np.unique(links[:, links[0] != links[1]], axis=1))
        self._tie_in()
        return self

    def _medoids(self, centers: np.ndarray) -> np.ndarray:
        """The node next to each shard's centre, and the nodes farthest from those chosen before."""
        chosen = list(dict.fromkeys((centers @ self.points.T).argmax(axis=1).tolist()))
        while len(chosen) < min(MEDOIDS, len(self.points)):
            far = int((self.points @ self.points[chosen].T).max(axis=1).argmin())
            if far in chosen:
                break
            chosen.append(far)
        return np.array(chosen)

    def _lists(self, links: np.ndarray) -> None:
        counts = np.bincount(links[0], minlength=len(self.points))
        self.near = np.full((len(self.points), max(1, int(counts.max(initial=0)))), -1, np.int32)
        self.near[np.arange(self.near.shape[1])[None, :] < counts[:, None]] = links[1]

    def _tie_in(self) -> None:
        """Give every node that no path from the medoids reaches an edge from its most similar reached node."""
        reached = np.zeros(len(self.points), bool)
        front = self.medoids
        while len(front):
            reached[front] = True
            following = np.unique(self.near[front])
            following = following[following >= 0]
            front = following[~reached[following]]
        lost, known = np.flatnonzero(~reached), np.flatnonzero(reached)
        if len(lost):
            source = known[(self.points[lost] @ self.points[known].T).argmax(axis=1)]
            row, place = np.nonzero(self.near >= 0)
            self._lists(np.unique(np.concatenate([np.stack([row, self.near[row, place]]), np.stack([source, lost])], axis=1), axis=1))

    def within(self, queries: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
        """Rows of booleans: which nodes the search finds at a similarity of ``least`` or more."""
        asked, n = queries.astype(np.float32), len(self.points)
        rows = np.arange(len(asked))
        seen, hit = np.zeros((len(asked), n), bool), np.zeros((len(asked), n), bool)
        grown = np.zeros((len(asked), n), bool)
        start = np.concatenate([np.tile(self.medoids, (len(asked), 1)), np.where(own >= 0, own, self.medoids[0])[:, None]], axis=1)
        ids = np.full((len(asked), BEAM), -1, np.int64)
        sims = np.full((len(asked), BEAM), -np.inf, np.float32)
        todo = self._visit(asked, rows, start, seen, hit, least)
        ids, sims = self._keep(ids, sims, *todo)
        active = rows
        while len(active):
            open_ = np.where((ids[active] >= 0) & ~grown[active[:, None], ids[active]], sims[active], -np.inf)
            pick = np.argsort(-open_, axis=1)[:, :WIDTH]
            good = np.take_along_axis(open_, pick, axis=1) > -np.inf
            nodes = np.where(good, np.take_along_axis(ids[active], pick, axis=1), -1)
            idle = np.flatnonzero(~good[:, 0])
            if len(idle):  # the beam is done: go on from nodes in range that have not been left yet
                waiting = hit[active[idle]] & ~grown[active[idle]]
                first = np.argpartition(~waiting, min(4 * WIDTH, n - 1), axis=1)[:, : 4 * WIDTH]
                ready = np.take_along_axis(waiting, first, axis=1)
                wide = np.full((len(active), first.shape[1]), -1, np.int64)
                wide[:, : nodes.shape[1]] = nodes[:, : wide.shape[1]]
                wide[idle] = np.where(ready, first, -1)
                nodes = wide
            going = (nodes >= 0).any(axis=1)
            active, nodes = active[going], nodes[going]
            if not len(active):
                break
            r, c = np.nonzero(nodes >= 0)
            grown[active[r], nodes[r, c]] = True
            following = np.where(nodes[:, :, None] >= 0, self.near[nodes], -1).reshape(len(active), -1)
            found = self._visit(asked, active, following, seen, hit, least)
            ids[active], sims[active] = self._keep(ids[active], sims[active], *found)
        return hit

    def _visit(self, asked, rows, nodes, seen, hit, least):
        """Similarities of nodes not seen before (-inf elsewhere); notes the ones in range."""
        ordered = np.sort(nodes, axis=1)
        fresh = ordered >= 0
        fresh[:, 1:] &= ordered[:, 1:] != ordered[:, :-1]
        fresh &= ~seen[rows[:, None], ordered]
        r, c = np.nonzero(fresh)
        at = ordered[r, c]
        value = np.einsum("ij,ij->i", asked[rows[r]], self.points[at])
        seen[rows[r], at] = True
        inside = value >= least - SLACK
        hit[rows[r[inside]], at[inside]] = True
        sims = np.full(ordered.shape, -np.inf, np.float32)
        sims[r, c] = value
        return np.where(fresh, ordered, -1), sims

    @staticmethod
    def _keep(ids, sims, more_ids, more_sims):
        ids, sims = np.concatenate([ids, more_ids], axis=1), np.concatenate([sims, more_sims], axis=1)
        top = np.argpartition(-sims, BEAM - 1, axis=1)[:, :BEAM]
        return np.take_along_axis(ids, top, axis=1), np.take_along_axis(sims, top, axis=1)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining the roots of a and b; a root is the smallest place of its group."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        if (low == high).all():
            return labels
        np.minimum.at(labels, high, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def _rows(binary: bytes, width: int) -> np.ndarray:
    return np.frombuffer(binary, "<f8").reshape(-1, width)


def _packed(df: DataFrame, width: int, more: str) -> DataFrame:
    """One row per (cell, part): ids, copies, vectors and a column of cell lists, as binaries."""

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        flat = lambda name: np.array(table.column(name).combine_chunks().values)
        return pa.table({
            "cell": pa.array([table.column("cell")[0].as_py()], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
            "ids": pa.array([table.column("id").to_numpy()[order].astype("<i8").tobytes()]),
            "copies": pa.array([table.column("copies").to_numpy()[order].astype("<i8").tobytes()]),
            "data": pa.array([flat("v").reshape(-1, width)[order].astype("<f8").tobytes()]),
            more: pa.array([flat(more).reshape(len(order), -1)[order].astype("<i4").tobytes()]),
        })

    return df.groupBy("cell", "part").applyInArrow(pack, f"cell int, part long, ids binary, copies binary, data binary, {more} binary")


def _search(nodes: DataFrame, centers: np.ndarray, width: int, visits: int, threshold: float) -> DataFrame:
    """(id, links, root) per node and searched graph part: weighted links found there, and one edge per node that has any."""
    count = len(centers)
    homes, visits = min(HOMES, count), min(visits, count)

    def place(batches):
        for batch in batches:
            data = np.array(batch.column("v").flatten()).reshape(-1, width)
            near = np.argsort(-(data @ centers.T), axis=1, kind="stable")[:, :visits].astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(near[:, :homes]), lists(near)], names=[*batch.schema.names, "homes", "visits"])

    placed = materialize(nodes.mapInArrow(place, "id long, copies long, v array<double>, homes array<int>, visits array<int>"), "placed")
    living = placed.select("id", "copies", "v", "homes", F.explode("homes").alias("cell"))
    visiting = placed.select("id", "copies", "v", "visits", F.explode("visits").alias("cell"))
    sizes = materialize(living.groupBy("cell").count().join(visiting.groupBy("cell").agg(F.count("*").alias("asked")), "cell"), "cell-sizes")
    split = lambda rows, column, most: (
        rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.ceil(F.col(column) / most))).drop("count", "asked")
    )
    index = _packed(split(living, "count", PART_NODES), width, "homes")
    asked = _packed(split(visiting, "asked", QUERY_NODES), width, "visits")

    def build(batches):
        for batch in batches:
            graphs = [FlatGraph.build(_rows(data, width)) for data in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([g.near.astype("<i4").tobytes() for g in graphs]), pa.array([g.medoids.astype("<i8").tobytes() for g in graphs])],
                names=[*batch.schema.names, "near", "medoids"],
            )

    stored = "cell int, part long, ids binary, copies binary, data binary, homes binary, near binary, medoids binary"
    index = materialize(index.mapInArrow(build, stored), "graph-parts")
    pairs = index.join(asked.select("cell", F.col("part").alias("chunk"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "visits"), "cell")
    pairs = pairs.repartition(max(8, 4 * count), "cell", "part", "chunk")

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                cell, ids = row["cell"], np.frombuffer(row["ids"], "<i8")
                points, queries = _rows(row["data"], width), _rows(row["q_data"], width)
                graph = FlatGraph(points, np.frombuffer(row["near"], "<i4").reshape(len(points), -1), np.frombuffer(row["medoids"], "<i8"))
                copies, asked_ids = np.frombuffer(row["copies"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                home = np.frombuffer(row["homes"], "<i4").reshape(-1, homes)
                visit = np.frombuffer(row["visits"], "<i4").reshape(-1, visits)
                own = np.searchsorted(ids, asked_ids)
                own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == asked_ids), own, -1)
                both = np.concatenate([asked_ids, ids])
                labels, links = np.arange(len(both)), np.zeros(len(asked_ids), np.int64)
                same = np.flatnonzero(own >= 0)
                labels = merge_labels(labels, same, own[same] + len(asked_ids))
                for a in range(0, len(queries), 128):
                    r, c = np.nonzero(graph.within(queries[a : a + 128], own[a : a + 128], threshold))
                    r += a
                    exact = (np.einsum("ij,ij->i", queries[r], points[c]) >= threshold) & (own[r] != c)
                    r, c = r[exact], c[exact]
                    labels = merge_labels(labels, r, c + len(asked_ids))
                    first = np.ones(len(r), bool)  # a pair counts in the first of its node's homes that the query visits
                    for h in range(homes):
                        first &= ~((home[c, h] < cell) & (visit[r] == home[c, h][:, None]).any(axis=1))
                    links += np.bincount(r, copies[c] * first, len(links)).astype(np.int64)
                joined = labels != np.arange(len(labels))
                yield pa.RecordBatch.from_pydict({
                    "id": np.concatenate([asked_ids, both[joined]]), "links": np.concatenate([links, np.zeros(int(joined.sum()), np.int64)]),
                    "root": np.concatenate([asked_ids, both[labels[joined]]]),
                })

    return pairs.mapInArrow(find, "id long, links long, root long")


def audit(nodes: DataFrame, found: DataFrame, width: int, threshold: float = THRESHOLD, drawn: int = DRAWN, linked: int = AUDIT) -> tuple[float | None, int]:
    """(recall, nodes it was measured on), against brute force over all nodes.

    ``drawn`` nodes are picked by hash from all, which shows what the search lost altogether, and ``linked`` from those
    it found links of, which shows what it lost of groups too rare for the first. A node's recall is the share of its
    links that were found, so large groups weigh no more than pairs; the lower of the two means counts. Without any
    node that has links there is nothing to measure and the recall is None.
    """
    hashed = F.xxhash64("id", F.lit(17))
    some = nodes.orderBy(hashed, "id").limit(drawn).select("id", "v", F.lit(0).alias("group"))
    got = found.groupBy("id").agg(F.sum("links").alias("got"))
    known = nodes.join(got.where("got > 0").orderBy(hashed, "id").limit(linked), "id").select("id", "v", F.lit(1).alias("group"))
    picked = some.unionByName(known).collect()  # bounded by drawn + linked
    if not picked:
        return None, 0
    ids, points, group = np.array([r.id for r in picked]), np.array([r.v for r in picked]), np.array([r.group for r in picked])

    def count(batches):
        total = np.zeros(len(ids))
        for batch in batches:
            data = np.array(batch.column("v").flatten()).reshape(-1, width)
            own, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            for a in range(0, len(own), 1024):
                near = (data[a : a + 1024] @ points.T >= threshold) & (own[a : a + 1024, None] != ids[None, :])
                total += copies[a : a + 1024] @ near
        yield pa.RecordBatch.from_pydict({"id": ids, "group": group.astype(np.int32), "links": total.astype(np.int64)})

    truth = nodes.mapInArrow(count, "id long, group int, links long").groupBy("id", "group").agg(F.sum("links").alias("all")).where(F.col("all") > 0)
    share = F.least("all", F.coalesce("got", F.lit(0))) / F.col("all")
    means = truth.join(got, "id", "left").groupBy("group").agg(F.avg(share).alias("recall"), F.count("*").alias("n")).collect()  # two rows at most
    return (min(r.recall for r in means), sum(r.n for r in means)) if means else (None, 0)


def dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, visits: int = VISITS, goal: float = GOAL, with_recall: bool = False) -> DataFrame:
    """(key, n_links, component_id, kept) per row; ``with_recall`` adds the audited recall of the links (NULL if no audited node has any)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("raw"), usable(vector, key).alias("ok"))
    doubles = F.transform("raw", lambda x: x.cast("double"))
    most = F.array_max(F.transform(doubles, F.abs))
    scaled = F.transform(doubles, lambda x: x / most)  # no overflow in the squares
    rows = rows.withColumn("s", F.when(F.col("ok") & (most > 0), scaled))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x))
    groups = rows.where(F.col("s").isNotNull()).groupBy("raw").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.first("s").alias("s"))
    nodes = materialize(groups.select("raw", "id", "copies", F.size("s").alias("width"), F.transform("s", lambda x: x / norm).alias("v")), "nodes")
    widths = [r.width for r in nodes.select("width").distinct().collect()]  # vector lengths in use
    links, recalls = None, []
    for width in sorted(widths):
        mine = nodes.where(F.col("width") == width).select("id", "copies", "v")
        total = mine.count()
        wanted = max(1, min(MOST_CELLS, -(-HOMES * total // CELL_NODES)))
        share = min(1.0, SAMPLE / total)
        sample = mine.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1_000_000)) < share * 1_000_000).select("v").collect()  # bounded by SAMPLE
        points = np.array([r.v for r in sample] or [mine.select("v").first().v])
        centers = _centroids(points, min(wanted, len(points)), seed=29)
        reach = visits
        while True:
            found = materialize(_search(mine, centers, width, reach, threshold), "links-found")
            recall, _ = audit(mine, found, width, threshold) if with_recall or reach < len(centers) else (None, 0)
            if reach >= len(centers) or recall is None or recall >= goal:
                break
            reach *= 2
        recalls += [] if recall is None else [recall]
        links = found if links is None else links.unionByName(found)
    more = [F.lit(min(recalls, default=None)).cast("double").alias("recall")] if with_recall else []
    if links is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.col("key").isNotNull().alias("kept"), *more)
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = nodes.select("raw", "id", "copies").join(counts, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    named = materialize(named.select(
        F.xxhash64("raw").alias("rh"), F.col("raw").alias("r"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("part"),
    ), "named")
    rows = rows.withColumn("h", F.when(F.col("s").isNotNull(), F.xxhash64("raw")))
    out = rows.join(named, (F.col("h") == F.col("rh")) & (F.col("raw") == F.col("r")), "left")
    return out.select(
        F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("part", "key").alias("component_id"),
        F.coalesce(F.coalesce("part", "key") == F.col("key"), F.lit(True)).alias("kept"), *more,
    )
