"""Isolation forest (Liu, Ting, Zhou 2008): trees grown per group on bounded samples, scored in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.ordered import smallest_hashes
from faultline.session import materialize

EULER = 0.5772156649


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=np.float64)
    safe = np.maximum(n, 3.0)
    out = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def _grow(seed: int, limit: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.array(pdf.sort_values("id")["vec"].tolist(), dtype=np.float64)
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        count = 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            low, high = part.min(0), part.max(0)
            open_dims = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(open_dims) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, float(depth + _expected_path(len(rows)))))
                continue
            dim = int(rng.choice(open_dims))
            at = float(rng.uniform(low[dim], high[dim]))
            goes_left = part[:, dim] <= at
            left, right = count, count + 1
            count += 2
            nodes.append((tree, node, dim, at, left, right, 0.0))
            todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "dim", "at", "lo", "hi", "path"])

    return grow


def grow_trees(df: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, id: str = "id", vector: str = "features") -> DataFrame:
    """Node table of the forest. Each tree gets ``sample`` rows in the order of a hash of (id, tree).

    The trees draw from a pool of trees x sample rows taken once by hash, so the work after the
    pool does not grow with the table.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    pool = materialize(smallest_hashes(rows, "id", trees * sample, seed), "pool")
    drawn = pool.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn(
        "r", F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("id", "tree", F.lit(seed)), "id"))
    ).where(F.col("r") <= sample)
    limit = int(np.ceil(np.log2(max(sample, 2))))
    return drawn.join(pool, "id").select("tree", "id", "vec").groupBy("tree").applyInPandas(
        _grow(seed, limit), "tree int, node int, dim int, at double, lo int, hi int, path double"
    )


def isolation_scores(
    df: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, id: str = "id", vector: str = "features"
) -> DataFrame:
    """(id, score) with scores in (0, 1); higher is more isolated."""
    # At most trees x (2 x sample - 1) rows, fixed by the parameters.
    nodes = grow_trees(df, trees, sample, seed, id, vector).toPandas().sort_values(["tree", "node"])
    forest = [tuple(g[c].to_numpy() for c in ("dim", "at", "lo", "hi", "path")) for _, g in nodes.groupby("tree")]
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    size = rows.limit(sample).count()
    norm = float(max(_expected_path(size), 1.0))
    shipped = df.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["vec"].tolist(), dtype=np.float64)
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for dim, at, lo, hi, path in shipped.value:
                node = np.zeros(len(x), dtype=np.int64)
                while True:
                    inner = dim[node] >= 0
                    if not inner.any():
                        break
                    left = x[every, np.maximum(dim[node], 0)] <= at[node]
                    node = np.where(inner, np.where(left, lo[node], hi[node]), node)
                total += path[node]
            yield pd.DataFrame({"id": pdf["id"], "score": 2.0 ** (-total / len(shipped.value) / norm)})

    return rows.mapInPandas(score, "id bigint, score double")
