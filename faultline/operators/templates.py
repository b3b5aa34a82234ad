"""Template mining in the manner of Drain (He et al., ICWS 2017), batch form.

Messages are compacted to distinct shapes (digit-bearing tokens replaced by ``<*>``) with partial
aggregation, so the similarity step sees shapes, not lines. Shapes meet in leaves of a prefix tree (token
count, then leading tokens, with a limit of children per node) and are clustered in order of first appearance.

A leaf of many shapes is not one task. A shape joins a template only if it is similar to the shape that founded it, so
shapes that no chain of similar ones connects never meet: such a leaf falls into units (`_units`) with the same result as
the whole. A unit that is still large is dealt to parts, whose partial catalogues are then clustered like shapes.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from faultline.functions.graph import smallest_reachable
from faultline.functions.text import compute_once, strip_ws
from faultline.operators.sessions import ids_by_first_appearance
from faultline.session import materialize

WILD = "<*>"
MOST_SHAPES = 20_000


@dataclass(frozen=True)
class Templates:
    """``catalogue``: event_id, template, count, first_line. ``shapes``: key, event_id."""

    catalogue: DataFrame
    shapes: DataFrame


def tokens(content: Column) -> Column:
    return F.split(strip_ws(content), r"(?U)\s+")


def masked(parts: Column) -> Column:
    return F.transform(parts, lambda t: F.when(t.rlike(r"\d"), F.lit(WILD)).otherwise(t))


def shape(content: Column) -> Column:
    return F.array_join(masked(tokens(content)), " ")


def merge_tokens(a: Column, b: Column) -> Column:
    """Wildcard where two equally long token lists differ."""
    return F.zip_with(a, b, lambda x, y: F.when(x == y, x).otherwise(F.lit(WILD)))


def similarity(template: Column, parts: Column) -> Column:
    """Share of positions with the same literal; wildcards count as different."""
    same = F.zip_with(template, parts, lambda x, y: ((x == y) & (x != WILD)).cast("int"))
    return F.try_divide(F.aggregate(same, F.lit(0), lambda acc, v: acc + v), F.size(template))


def least_equal(width: int, threshold: float) -> int:
    """The least number of equal literals with which two rows of ``width`` tokens reach the threshold."""
    return next((k for k in range(int(threshold * width), width + 1) if k / max(width, 1) >= threshold), width + 1)


class LeafClusters:
    """Greedy clusters of equally long token lists: the first best match of at least ``threshold`` takes a shape.

    Templates are rows of one growing matrix, found through an index from (position, token) to the templates with that
    literal: of any ``width - least + 1`` positions a match shares one, so only the rarest tokens of a shape are looked up and
    few templates compared. Tokens that no template has are not kept, so memory grows with the templates alone.
    """

    def __init__(self, width: int, threshold: float):
        self.threshold, self.count, self.least = threshold, 0, least_equal(width, threshold)
        self.codes, self.words = {WILD: 0}, [WILD]
        self.matrix = np.zeros((16, width), np.int32)
        self.index: dict[tuple[int, int], list[int]] = {}
        self.exact: dict[bytes, list[int]] = {}

    def add(self, parts: list[str]) -> tuple[int, str]:
        """The cluster of a shape and what it did: cluster_created, cluster_template_changed or none."""
        row = np.array([self.codes.get(p, -1) for p in parts], np.int32)
        whole = self.exact.get(row.tobytes())
        if whole:
            return whole[0], "none"
        near = self._candidates(row)
        if len(near):
            known = self.matrix[near]
            equal = known == row
            score = (equal & (known != 0)).sum(axis=1) / max(len(row), 1)
            top = int(score.argmax())
            if score[top] >= self.threshold:
                best = int(near[top])
                merged = np.where(equal[top], row, 0).astype(np.int32)
                if (merged == known[top]).all():
                    return best, "none"
                self._rename(best, merged)
                return best, "cluster_template_changed"
        self.restore(parts)
        return self.count - 1, "cluster_created"

    def _candidates(self, row: np.ndarray) -> np.ndarray:
        """Templates, ascending, that can have ``least`` literals in common with a row."""
        if not self.least:
            return np.arange(self.count)
        lists = [self.index.get(item, ()) if item[1] > 0 else () for item in enumerate(row.tolist())]
        lists = sorted(lists, key=len)[: len(lists) - self.least + 1]
        return np.array(sorted(set().union(*lists)), np.int64)

    def _rename(self, cluster: int, merged: np.ndarray) -> None:
        old = self.matrix[cluster].copy()
        for place in np.flatnonzero(old != merged).tolist():
            self.index[place, int(old[place])].remove(cluster)
        self.exact[old.tobytes()].remove(cluster)
        self.matrix[cluster] = merged
        self.exact[merged.tobytes()] = sorted([*self.exact.get(merged.tobytes(), []), cluster])

    def restore(self, parts: list[str]) -> None:
        """Add a template as it is."""
        for part in parts:
            if part not in self.codes:
                self.codes[part] = len(self.words)
                self.words.append(part)
        row = np.array([self.codes[p] for p in parts], np.int32)
        if self.count == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[self.count] = row
        for item in enumerate(row.tolist()):
            if item[1]:
                self.index.setdefault(item, []).append(self.count)
        self.exact.setdefault(row.tobytes(), []).append(self.count)
        self.count += 1

    def template(self, cluster: int) -> str:
        return " ".join(self.words[c] for c in self.matrix[cluster])


def cluster_shapes(texts: list[str], threshold: float) -> list[str]:
    """Greedy clustering of equally long shapes in the given order; returns each shape's template."""
    leaf = LeafClusters(len(texts[0].split(" ")), threshold)
    members = [leaf.add(t.split(" "))[0] for t in texts]
    return [leaf.template(m) for m in members]


def _leaves(compact: DataFrame, prefix: int, max_children: int | None) -> DataFrame:
    """Add ``leaf``: token count (``width``) and leading tokens (``heads``), one level of the tree after the other.

    With ``max_children``, the first ``max_children - 1`` tokens to appear below a node get children of their own, the others
    share the child of the wildcard.
    """
    rows = compact.withColumn("leaf", F.col("width").cast("string"))
    for level in range(prefix):
        token = F.coalesce(F.get("heads", F.lit(level)), F.lit(""))
        if max_children is not None:
            order = Window.partitionBy("_node").orderBy("first", "_head")
            heads = rows.groupBy(F.col("leaf").alias("_node"), token.alias("_head")).agg(F.min("first").alias("first"))
            kept = heads.withColumn("_r", F.row_number().over(order)).where(F.col("_r") < max_children).select("_node", "_head")
            rows = rows.join(kept, (F.col("leaf") == F.col("_node")) & (token == F.col("_head")), "left")
            token = F.coalesce("_head", F.lit(WILD))
        rows = rows.withColumn("leaf", F.concat_ws("|", "leaf", token)).select(*compact.columns, "leaf")
    return rows


def _units(shapes: DataFrame, threshold: float) -> DataFrame:
    """(key, root): shapes that a chain of similar ones may connect have one root; a shape without a row is alone.

    Two similar shapes share one of the rarest (position, token) items of each, as many as it has literals beyond
    those that similarity needs, less one. Each item links its shapes to its first, so no pair is listed.
    """
    each = shapes.select("key", "leaf", F.posexplode(F.split("text", " ")).alias("pos", "token"), F.size(F.split("text", " ")).alias("width"))
    each = each.where(F.col("token") != WILD).select("key", "width", F.xxhash64("leaf", "pos", "token").alias("item"))
    each = materialize(each, "shape-items")
    shared = materialize(each.groupBy(F.col("item").alias("_i")).agg(F.count("*").alias("times"), F.min("key").alias("lead")).where("times > 1"), "shared-items")
    ranked = each.join(shared, F.col("item") == F.col("_i"), "left").groupBy("key", "width").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "item", "lead"))).alias("items")
    )
    needed = F.ceil(F.lit(threshold) * F.col("width") - 1e-9)
    first = F.slice("items", F.lit(1), F.greatest(F.size("items") - needed + 1, F.lit(0)).cast("int"))
    links = ranked.select("key", F.explode(first).alias("x")).where("x.lead IS NOT NULL").select(F.col("key").alias("a"), F.col("x.lead").alias("b"))
    return smallest_reachable(links).select(F.col("node").alias("key"), "root")


def _dealt(compact: DataFrame, rows: DataFrame, threshold: float, most: int) -> tuple[DataFrame, bool]:
    """Add ``unit`` and ``part``: the leaf itself (part -1), or for leaves of more than ``most`` shapes their units, in parts from
    0 on where those are still as large."""
    counts = materialize(compact.groupBy(F.col("leaf").alias("_l")).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "hot-leaves")
    whole = compact.withColumn("unit", F.col("leaf")).withColumn("part", F.lit(-1))
    if not counts.limit(1).count():
        return whole, False
    hot = materialize(compact.join(counts, F.col("leaf") == F.col("_l"), "left_semi"), "hot-shapes")
    units = hot.withColumn("unit", F.col("leaf"))
    if threshold > 0:
        texts = _with_texts(hot, rows).select("key", "leaf", "text").dropDuplicates(["key"])
        roots = _units(materialize(texts, "hot-texts"), threshold).withColumnRenamed("key", "_k")
        units = hot.join(roots, F.col("key") == F.col("_k"), "left").withColumn("unit", F.concat_ws("#", "leaf", F.coalesce("root", "key")))
        units = materialize(units.drop("_k", "root"), "units")
    sizes = units.groupBy(F.col("unit").alias("_u")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / most)), F.lit(-1)).cast("int")
    dealt = units.join(sizes, F.col("unit") == F.col("_u"), "left").withColumn("part", part).drop("_u", "_n")
    cold = whole.join(counts, F.col("leaf") == F.col("_l"), "left_anti")
    return materialize(cold.unionByName(dealt), "dealt"), True


def _with_texts(shapes: DataFrame, rows: DataFrame) -> DataFrame:
    """``shapes`` with ``text`` and the tokens ``t`` of the message from which each came, found by the line on which it first appeared.

    A line that comes twice can give a shape two rows, with equal texts. Shapes without a line are found by their key. Messages
    are cut into tokens only once they are found.
    """
    spot = lambda line, key: F.coalesce(F.col(line).cast("string"), F.concat(F.lit("#"), key))
    messages = rows.select(F.col("content").alias("_c"), spot("line", shape_key(shape(F.col("content")))).alias("_s"))
    found = shapes.withColumn("_w", spot("first", F.col("key"))).join(messages, F.col("_w") == F.col("_s")).withColumn("_t", tokens(F.col("_c")))
    found = compute_once(found.drop("_c", "_w", "_s"), "_x", F.struct(F.array_join(masked(F.col("_t")), " ").alias("text"), F.col("_t").alias("t")))
    return found.where(shape_key(F.col("_x.text")) == F.col("key")).select(*shapes.columns, "_x.text", "_x.t")


_SPOTS = "array<array<struct<pos:int,lo:bigint,hi:bigint,raw:string>>>"


def _clustered(compact: DataFrame, seen: DataFrame, rows: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(key, leaf, tkey) of the shapes and (leaf, tkey, template, count, first_line) of the templates.

    The shapes of a unit stream through one task in order of first appearance, so the result does not depend on how
    many there are or how they are batched. Where a unit has parts, their templates are clustered in the same way, in the
    order of their first shapes. Texts are sent to the tasks and written once, as templates.
    """
    dealt, split = _dealt(compact, rows, threshold, most)
    spots = seen.where("pos >= 0").groupBy(F.col("key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("spots"))
    # A table: few shapes are then seen to be few, and no message is sent to find theirs.
    wanted = materialize(dealt.join(spots, F.col("key") == F.col("_k"), "left").drop("_k"), "wanted")
    raw = lambda s: F.struct(s["pos"].alias("pos"), s["lo"].alias("lo"), s["hi"].alias("hi"), F.get("t", s["pos"]).alias("raw"))
    texts = _with_texts(wanted, rows).withColumn("spots", F.array(F.coalesce(F.transform("spots", raw), F.array().cast(_SPOTS[6:-1]))))
    members, made = _cluster_texts(texts.drop("t"), ["unit", "part"], threshold)
    if split:
        partial = made.where("part >= 0").groupBy("unit", "leaf", F.col("tkey").alias("key"), F.col("template").alias("text")).agg(
            F.min("first").alias("first"), F.sum("n").alias("n"), F.flatten(F.collect_list("spots")).alias("spots")
        )
        inner, whole = _cluster_texts(partial, ["unit"], threshold)
        final = inner.select(F.col("unit").alias("_u"), F.col("key").alias("_t"), F.col("tkey").alias("_final"))
        members = members.join(final, (F.col("part") >= 0) & (F.col("unit") == F.col("_u")) & (F.col("tkey") == F.col("_t")), "left").withColumn(
            "tkey", F.coalesce("_final", "tkey")
        )
        made = made.where("part < 0").drop("part").unionByName(whole)
    return materialize(members.select("key", "leaf", "tkey"), "mapping"), made.select("leaf", "tkey", _restored().alias("template"), F.col("n").alias("count"), F.col("first").alias("first_line"))


def _restored() -> Column:
    """The template; a wildcard whose raw token never varied gets its literal back, known from the hashes of all raw tokens."""
    constant = F.filter(F.flatten("spots"), lambda s: (s["lo"] == s["hi"]) & F.col("first").isNotNull())
    fixed = F.map_from_entries(F.transform(constant, lambda s: F.struct(s["pos"], s["raw"])))
    whole = F.transform(F.split("template", " "), lambda t, i: F.coalesce(F.try_element_at(fixed, i), t))
    return F.when(F.size(constant) > 0, F.array_join(whole, " ")).otherwise(F.col("template"))


class _Literals:
    """Of each cluster: masked positions that all its shapes have, with the least and greatest hash and a raw token; rows and first line."""

    def __init__(self):
        self.spots, self.count, self.first = [], [], []

    def add(self, cluster: int, lists: list[list[dict]], n: int, first) -> None:
        if cluster == len(self.spots):
            self.spots.append({s["pos"]: (s["lo"], s["hi"], s["raw"]) for s in lists[0]})
            self.count.append(0)
            self.first.append(None)
        here = self.spots[cluster]
        for spots in lists if here else ():
            theirs = {s["pos"]: s for s in spots}
            here = {p: (min(lo, theirs[p]["lo"]), max(hi, theirs[p]["hi"]), raw) for p, (lo, hi, raw) in here.items() if p in theirs}
        self.spots[cluster] = here
        self.count[cluster] += n
        if first is not None and (self.first[cluster] is None or first < self.first[cluster]):
            self.first[cluster] = first

    def of(self, cluster: int) -> list[list[dict]]:
        return [[{"pos": p, "lo": lo, "hi": hi, "raw": raw} for p, (lo, hi, raw) in sorted(self.spots[cluster].items())]]


def _cluster_texts(rows: DataFrame, group: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Shapes (with ``text`` and ``spots``) clustered in each group by itself: members (group, key, leaf, tkey) and templates
    (group, leaf, tkey, template, n, first, spots). Members keep no text; of the rows of one key one counts."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*group, "key", "leaf", "first", "n").schema}
    kinds |= {"cluster": "int", "template": "string", "tkey": "string", "spots": _SPOTS}
    out = to_arrow_schema(StructType.fromDDL(", ".join(f"`{k}` {t}" for k, t in kinds.items())))

    def made(columns: dict, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in out], schema=out)

    def templates(name: tuple, of: str, leaf: LeafClusters, known: _Literals) -> pa.RecordBatch:
        texts = [leaf.template(c) for c in range(leaf.count)]
        same = {g: [v] * leaf.count for g, v in zip(group, name, strict=True)} | {"leaf": [of] * leaf.count}
        return made(same | {
            "first": known.first, "n": known.count, "cluster": range(leaf.count), "template": texts,
            "tkey": [md5(t.encode()).hexdigest() for t in texts], "spots": [known.of(c) for c in range(leaf.count)],
        }, leaf.count)

    def run(batches):
        name = of = leaf = known = last = None
        for batch in batches:
            given = {c: batch.column(c).to_pylist() for c in (*group, "key", "leaf", "first", "n", "text", "spots")}
            members = {c: [] for c in (*group, "key", "leaf", "cluster")}
            for i, here in enumerate(zip(*[given[g] for g in group], strict=True)):
                parts = given["text"][i].split(" ")
                if here != name:
                    if leaf:
                        yield templates(name, of, leaf, known)
                    name, of, leaf, known, last = here, given["leaf"][i], LeafClusters(len(parts), threshold), _Literals(), None
                if given["key"][i] == last:
                    continue
                last, cluster = given["key"][i], leaf.add(parts)[0]
                known.add(cluster, given["spots"][i], given["n"][i], given["first"][i])
                for c, v in (*zip(group, here, strict=True), ("key", last), ("leaf", of), ("cluster", cluster)):
                    members[c].append(v)
            yield made(members, len(members["key"]))
        if leaf:
            yield templates(name, of, leaf, known)

    ordered = rows.select(*group, "key", "leaf", "first", "n", "text", "spots").repartition(*group).sortWithinPartitions(*group, "first", "text")
    both = materialize(ordered.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items())), "clusters")
    found = both.where("key IS NULL").drop("key")
    named = found.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("cluster").alias("_c"), F.col("tkey").alias("tkey"))
    same = [F.col(g) == F.col(f"_{g}") for g in group]
    members = both.where("key IS NOT NULL").select(*group, "key", "leaf", "cluster").join(named, [*same, F.col("cluster") == F.col("_c")])
    return members.select(*group, "key", "leaf", "tkey"), found.drop("cluster")


def _cluster(rows: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """``rows`` (with ``text`` and ``first``) with the ``template`` of each, clustered in each group by itself."""

    def run(batches):
        leaf, name = None, None

        def row_batch(columns: dict, count: int, kinds: pa.Schema) -> pa.RecordBatch:
            made = [columns[k.name] if k.name in columns else pa.nulls(count, k.type) for k in kinds]
            made += [pa.array(columns["cluster"], pa.int32()), pa.array(columns.get("template", [None] * count), pa.string())]
            return pa.RecordBatch.from_arrays(made, names=[*kinds.names, "cluster", "template"])

        def templates(kinds: pa.Schema) -> pa.RecordBatch:
            found = range(leaf.count)
            named = {g: pa.array([v] * leaf.count, kinds.field(g).type) for g, v in zip(group, name, strict=True)}
            return row_batch({**named, "cluster": list(found), "template": [leaf.template(c) for c in found]}, leaf.count, kinds)

        kinds = None
        for batch in batches:
            kinds, members = batch.schema, []
            names = zip(*[batch.column(g).to_pylist() for g in group], strict=True)
            for here, text in zip(names, batch.column("text").to_pylist(), strict=True):
                parts = text.split(" ")
                if here != name:
                    if leaf:
                        yield templates(kinds)
                    leaf, name = LeafClusters(len(parts), threshold), here
                members.append(leaf.add(parts)[0])
            yield row_batch({**dict(zip(batch.schema.names, batch.columns, strict=True)), "cluster": members}, len(members), kinds)
        if leaf:
            yield templates(kinds)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "first", "text")
    both = materialize(ordered.mapInArrow(run, f"{types}, cluster int, template string"), "clusters")
    named = [f"_{g}" for g in group]
    known = both.where("template IS NOT NULL").select(*[F.col(g).alias(n) for g, n in zip(group, named, strict=True)], F.col("cluster").alias("_c"), "template")
    members = both.where("template IS NULL").drop("template")
    same = [F.col(g) == F.col(n) for g, n in zip(group, named, strict=True)]
    return members.join(known, [*same, F.col("cluster") == F.col("_c")]).select(*rows.columns, "template")


def shape_key(c: Column) -> Column:
    """Fixed-length key of a shape; joins carry it instead of the (possibly long) text."""
    return F.md5(c)


def _shape_statistics(shaped: DataFrame, prefix: int) -> DataFrame:
    """One pass over the messages: (key, pos, width, heads, n, first, lo, hi).

    Position -1 stands for the message itself (its token count and first tokens, count and first line), the others for its
    masked tokens with the smallest and largest token hash. All buffers are longs, so tasks combine
    by hash before the shuffle and a frequent shape leaves a task as a handful of rows. Texts stay where they are.
    """
    whole = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("h")))
    spots = F.transform("digits", lambda d, i: F.struct(i.alias("pos"), F.xxhash64(d).alias("h")))
    kept = F.filter(F.zip_with(spots, "digits", lambda s, d: F.when(d.isNotNull(), s)), lambda s: s.isNotNull())
    own = lambda c: F.when(F.col("x.pos") < 0, F.col(c)).alias(c)
    return (
        shaped.select("key", "line", F.size("t").alias("width"), masked(F.slice("t", 1, prefix)).alias("heads"), F.explode(F.concat(whole, kept)).alias("x"))
        .groupBy("key", F.col("x.pos").alias("pos"), own("width"), own("heads"))
        .agg(F.count("*").alias("n"), F.min("line").alias("first"), F.min("x.h").alias("lo"), F.max("x.h").alias("hi"))
    )


def mine(
    df: DataFrame, content: str = "content", line: str = "line_no", depth: int = 4, threshold: float = 0.4, max_children: int | None = 100,
    most: int = MOST_SHAPES,
) -> Templates:
    """Mine templates from messages; NULL messages are left out. ``line`` orders the messages.

    The tree has ``depth - 3`` levels of leading tokens. Leaves of more than ``most`` shapes are split: exactly where shapes
    that cannot meet lie in different units, and into parts with merged catalogues where a unit itself is larger.
    """
    prefix = max(depth - 3, 0)
    rows = df.where(F.col(content).isNotNull()).select(F.col(content).alias("content"), F.col(line).alias("line"))
    digits = F.transform("t", lambda x: F.when(x.rlike(r"\d"), x))
    shaped = rows.select(tokens(F.col("content")).alias("t"), "line").withColumn("digits", digits)
    shaped = shaped.withColumn("key", shape_key(F.array_join(F.zip_with("t", "digits", lambda a, d: F.when(d.isNull(), a).otherwise(F.lit(WILD))), " ")))
    seen = materialize(_shape_statistics(shaped, prefix), "shapes")
    compact = materialize(
        _leaves(seen.where("pos = -1").select("key", "width", "heads", "n", "first"), prefix, max_children).select("key", "leaf", "first", "n"), "leaves"
    )
    mapping, final = _clustered(compact, seen, rows, threshold, most)
    # Numbers are found without the texts: prose has about as many templates as messages.
    numbered = ids_by_first_appearance(final.select("leaf", "tkey", "first_line"), "first_line")
    numbered = numbered.select(F.col("leaf").alias("_l"), F.col("tkey").alias("_k"), F.col("event_id").cast("int").alias("event_id"))
    numbered = materialize(numbered, "numbers")
    catalogue = final.join(numbered, (F.col("leaf") == F.col("_l")) & (F.col("tkey") == F.col("_k")))
    shapes = mapping.join(numbered, (F.col("leaf") == F.col("_l")) & (F.col("tkey") == F.col("_k")))
    return Templates(catalogue.select("event_id", "template", "count", "first_line"), shapes.select("key", "event_id"))


def assign(df: DataFrame, model: Templates, content: str = "content") -> DataFrame:
    """Add the event id of every message by its shape (JVM only)."""
    keyed = df.withColumn("key", shape_key(shape(F.col(content))))
    return keyed.join(model.shapes, "key", "left").drop("key")


def with_template(df: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add the template text to event rows."""
    return df.join(catalogue.select("event_id", "template"), "event_id", "left")


def match_catalogue(df: DataFrame, catalogue: DataFrame, content: str = "content") -> DataFrame:
    """Event id of the most literal catalogue template that fits each message, NULL if none does.

    Templates are grouped by token count and first token, so a message meets the few candidates that begin
    like it and those that begin with a wildcard, and no message row is multiplied. Ties go to the smaller id.
    """
    known = catalogue.select("event_id", F.split("template", " ").alias("t")).withColumn(
        "literals", F.size(F.filter("t", lambda x: x != WILD))
    )
    by_head = known.groupBy(F.size("t").alias("width"), F.get("t", F.lit(0)).alias("head")).agg(
        F.collect_list(F.struct((-F.col("literals")).alias("rank"), "event_id", "t")).alias("c")
    )
    literal = by_head.where(F.col("head") != WILD).select(F.col("width").alias("_lw"), F.col("head").alias("_lh"), F.col("c").alias("_lc"))
    open_ = by_head.where(F.col("head") == WILD).select(F.col("width").alias("_ow"), F.col("c").alias("_oc"))
    rows = df.withColumn("_t", tokens(F.col(content))).withColumn("_w", F.size("_t"))
    rows = rows.join(literal, (F.col("_w") == F.col("_lw")) & (F.get("_t", F.lit(0)) == F.col("_lh")), "left")
    rows = rows.join(open_, F.col("_w") == F.col("_ow"), "left")
    none = F.array().cast(by_head.schema["c"].dataType)
    rows = rows.withColumn("candidates", F.concat(F.coalesce("_lc", none), F.coalesce("_oc", none)))

    def fits(c: Column) -> Column:
        return F.forall(F.zip_with(c["t"], F.col("_t"), lambda a, b: (a == b) | (a == WILD)), lambda ok: ok)

    best = F.array_min(
        F.transform(F.filter("candidates", fits), lambda c: F.struct(c["rank"].alias("rank"), c["event_id"].alias("event_id")))
    )["event_id"]
    return rows.select(*df.columns, best.alias("event_id"))


def catalogue_of(assigned: DataFrame) -> DataFrame:
    """(event_id, template, count), most frequent first."""
    return assigned.groupBy("event_id", "template").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "event_id")
