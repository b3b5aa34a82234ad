"""Online template mining: shapes are combined per batch, the tree and its clusters are keyed state.

State is a map per node, so an update writes only the entries it touches. A busy leaf can be dealt to several state keys
(``parts``); `catalogue` reads the clusters of all keys from the state store and merges partial templates as the batch
form does. Clusters without a message for ``idle_ms`` are forgotten by a timer.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.operators.templates import WILD, LeafClusters, _cluster, masked, tokens

OUTPUT = "leaf string, cluster_id string, template string, change_type string, n bigint"


def combine(rows: DataFrame) -> DataFrame:
    """Per Arrow batch, one row per distinct shape: the map-side combine of the stateful step."""

    def run(batches):
        for pdf in batches:
            yield pdf.groupby(["node", "head", "shape"], as_index=False, sort=False)["n"].sum()

    return rows.mapInPandas(run, "node string, head string, shape string, n bigint")


class ChildState(StatefulProcessor):
    """The children of one node of the tree: the first ``max_children - 1`` heads have their own, others the wildcard's.

    State is one entry per child, so it is bounded; heads that are new in the same batch are taken in their order as text.
    """

    def __init__(self, max_children: int):
        self.most = max_children - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._children = handle.getMapState("children", "head string", "place int")

    def handleInputRows(self, key, rows, timerValues):
        frames = [pdf for pdf in rows if len(pdf)]
        own = {k[0] for k in self._children.keys()}
        for head in sorted(set().union(*[set(pdf["head"]) for pdf in frames]) - own):
            if len(own) >= self.most:
                break
            self._children.updateValue((head,), (len(own),))
            own.add(head)
        for pdf in frames:
            leaf = [f"{key[0]}|{h if h in own else WILD}" for h in pdf["head"]]
            yield pd.DataFrame({"leaf": leaf, "shape": pdf["shape"], "n": pdf["n"]})

    def close(self) -> None:
        pass


class LeafState(StatefulProcessor):
    """Clusters of one leaf, or of one part of it.

    ``shapes`` tells the cluster of every shape seen; only a new shape makes the templates be read. ``clusters`` has one
    entry per cluster: template, messages, and when the last one came. Only the clusters of a batch's messages are written.
    """

    def __init__(self, threshold: float = 0.4, idle_ms: int | None = None):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._shapes = handle.getMapState("shapes", "shape string", "cluster int")
        self._clusters = handle.getMapState("clusters", "cluster int", "template string, n bigint, seen bigint")
        self._next = handle.getValueState("next", "cluster int")

    def handleInputRows(self, key, rows, timerValues):
        name, part = key
        counts: Counter[str] = Counter()
        for pdf in rows:
            for shape, n in zip(pdf["shape"], pdf["n"], strict=True):
                counts[shape] += int(n)
        member = {s: self._shapes.getValue((s,))[0] for s in counts if self._shapes.containsKey((s,))}
        change = dict.fromkeys(counts, "none")
        templates: dict[int, str] = {}
        new = sorted(counts.keys() - member.keys())
        if new:
            stored = sorted((k[0], v[0]) for k, v in self._clusters.iterator())
            leaf, ids = LeafClusters(len(new[0].split(" ")), self.threshold), [c for c, _ in stored]
            for _, template in stored:
                leaf.restore(template.split(" "))
            fresh = self._next.get()[0] if self._next.exists() else 0
            for shape in new:
                place, change[shape] = leaf.add(shape.split(" "))
                if place == len(ids):
                    ids.append(fresh)
                    fresh += 1
                member[shape] = ids[place]
                self._shapes.updateValue((shape,), (ids[place],))
            self._next.update((fresh,))
            templates = {c: leaf.template(p) for p, c in enumerate(ids)}
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        touched: Counter[int] = Counter()
        for shape, n in counts.items():
            touched[member[shape]] += n
        for cluster, n in touched.items():
            old = self._clusters.getValue((cluster,)) if self._clusters.containsKey((cluster,)) else ("", 0, 0)
            templates.setdefault(cluster, old[0])
            self._clusters.updateValue((cluster,), (templates[cluster], old[1] + n, now))
        if self.idle_ms and not any(True for _ in self._handle.listTimers()):
            self._handle.registerTimer(now + self.idle_ms)
        told: Counter[tuple[int, str]] = Counter()
        for shape, n in counts.items():
            told[member[shape], change[shape]] += n
        label = name if part == 0 else f"{name}@{part}"
        out = [(name, f"{label}#{c}", templates[c], what, n) for (c, what), n in told.items()]
        yield pd.DataFrame(out, columns=["leaf", "cluster_id", "template", "change_type", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forget clusters that had no message for ``idle_ms``, with the shapes that led to them."""
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = {k[0]: v[2] for k, v in self._clusters.iterator()}
        idle = {c for c, at in seen.items() if at + self.idle_ms <= now}
        for shape in [k for k, v in self._shapes.iterator() if v[0] in idle] if idle else []:
            self._shapes.removeKey(tuple(shape))
        for cluster in idle:
            self._clusters.removeKey((cluster,))
        left = [at for c, at in seen.items() if c not in idle]
        if left:
            self._handle.registerTimer(min(left) + self.idle_ms)
        yield pd.DataFrame(columns=["leaf", "cluster_id", "template", "change_type", "n"])

    def close(self) -> None:
        pass


def mine_stream(
    messages: DataFrame, content: str = "content", threshold: float = 0.4, max_children: int | None = 100, parts: int = 1, idle_ms: int | None = None
) -> DataFrame:
    """(leaf, cluster_id, template, change_type, n) per batch; needs the RocksDB state store provider.

    Cluster ids are (leaf, part, ordinal), so no global counter exists. ``max_children`` costs a second stateful step, whose
    keys are token counts; without it the first token names the leaf directly. With ``idle_ms`` the stream has processing-time
    timers, which belong to a stream that runs on; a run over what is available would wait for them.
    """
    rows = messages.where(F.col(content).isNotNull()).withColumn("m", masked(tokens(F.col(content))))
    keyed = combine(rows.select(
        F.size("m").cast("string").alias("node"), F.get("m", F.lit(0)).alias("head"), F.array_join("m", " ").alias("shape"),
        F.lit(1).cast("long").alias("n"),
    ))
    if max_children is None:
        leaves = keyed.select(F.concat_ws("|", "node", "head").alias("leaf"), "shape", "n")
    else:
        leaves = keyed.groupBy("node").transformWithStateInPandas(
            statefulProcessor=ChildState(max_children), outputStructType="leaf string, shape string, n bigint", outputMode="append", timeMode="none"
        )
    part = F.pmod(F.xxhash64("shape"), F.lit(parts)).cast("int")
    return leaves.withColumn("part", part).groupBy("leaf", "part").transformWithStateInPandas(
        statefulProcessor=LeafState(threshold, idle_ms), outputStructType=OUTPUT, outputMode="append",
        timeMode="processingTime" if idle_ms else "none",
    )


def catalogue(spark: SparkSession, checkpoint: str, threshold: float = 0.4) -> DataFrame:
    """(leaf, template, count) as the state of a stream has it; partial templates of a dealt leaf are clustered together,
    those of more messages first."""
    steps = spark.read.format("state-metadata").load(checkpoint).where(F.col("operatorProperties").contains('"clusters"'))
    operator = steps.select("operatorId").distinct().first()["operatorId"]
    stored = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "clusters").load(checkpoint)
    rows = stored.select("key.leaf", F.col("user_map_value.template").alias("text"), F.col("user_map_value.n").alias("n"))
    partial = rows.groupBy("leaf", "text").agg(F.sum("n").alias("n")).withColumn("first", -F.col("n"))
    return _cluster(partial, ["leaf"], threshold).groupBy("leaf", "template").agg(F.sum("n").alias("count"))
