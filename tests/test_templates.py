import random
import time

import pytest
from pyspark.sql import functions as F

from faultline.operators import templates as tp


def messages(spark):
    rows = [(i, f"Received block blk_{i} of size {i * 7} from /10.0.0.{i}") for i in range(1, 60)]
    rows += [(100, "writeBlock blk_-31 received exception java.net.SocketTimeoutException")]
    rows += [(200 + i, f"Deleting block blk_{i} file /mnt/a") for i in range(5)]
    rows += [(300 + i, f"Deleting block blk_{i} file /mnt/b") for i in range(5)]
    rows += [(400, None)]
    return spark.createDataFrame(rows, "line_no long, content string")


def test_counts_literals_and_order(spark):
    model = tp.mine(messages(spark))
    got = {r.template: (r.event_id, r["count"]) for r in model.catalogue.collect()}
    assert got == {
        "Received block <*> of size <*> from <*>": (1, 59),
        "writeBlock blk_-31 received exception java.net.SocketTimeoutException": (2, 1),
        "Deleting block <*> file <*>": (3, 10),
    }


def test_independent_of_partitioning(spark):
    one = tp.mine(messages(spark).coalesce(1)).catalogue.collect()
    many = tp.mine(messages(spark).repartition(7)).catalogue.collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_catalogue_does_not_depend_on_batch_size(spark):
    words = ["alpha", "beta", "gamma", "delta", "rho", "tau", "phi", "chi", "psi", "eta"]
    rows = [(i, f"job {words[i % 10]} done in {words[(i // 10) % 10]} at host{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "line_no long, content string")
    found = []
    for size in ("3", "40", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(map(tuple, tp.mine(df).catalogue.collect())))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and sum(r[2] for r in found[0]) == 100 and len(found[0]) < 100


def test_every_message_is_assigned(spark):
    df = messages(spark).where("content IS NOT NULL")
    model = tp.mine(df)
    out = tp.with_template(tp.assign(df, model), model.catalogue)
    assert out.where("event_id IS NULL OR template IS NULL").count() == 0
    assert out.count() == df.count()


def test_max_children_sends_late_heads_to_the_wildcard_leaf(spark):
    rows = [(i, f"head{chr(97 + i)} same tail words") for i in range(6)]
    df = spark.createDataFrame(rows, "line_no long, content string")
    assert tp.mine(df).catalogue.count() == 6
    assert tp.mine(df, max_children=2).catalogue.count() == 2


def test_match_catalogue_prefers_literals(spark):
    known = spark.createDataFrame([(1, "a <*> c"), (2, "a b <*>"), (3, "<*> <*> <*>"), (4, "a b c")], "event_id int, template string")
    df = spark.createDataFrame([("a b c",), ("a x c",), ("q r s",), ("a b",)], "content string")
    got = {r.content: r.event_id for r in tp.match_catalogue(df, known).collect()}
    assert got == {"a b c": 4, "a x c": 1, "q r s": 3, "a b": None}


def test_merge_and_similarity(spark):
    df = spark.createDataFrame([(["a", "<*>", "c", "d"], ["a", "x", "c", "e"])], "t array<string>, p array<string>")
    r = df.select(tp.merge_tokens(F.col("t"), F.col("p")).alias("m"), tp.similarity(F.col("t"), F.col("p")).alias("s")).first()
    assert r.m == ["a", "<*>", "c", "<*>"] and r.s == 0.5


class PlainLeaf:
    """The clustering rule row by row: the first template with the most equal literals, if they are enough."""

    def __init__(self, threshold):
        self.threshold, self.rows = threshold, []

    def add(self, parts):
        if parts in self.rows:
            return self.rows.index(parts), "none"
        shares = [sum(a == b != tp.WILD for a, b in zip(r, parts, strict=True)) / len(parts) for r in self.rows]
        best = max(range(len(shares)), key=lambda i: (shares[i], -i), default=None)
        if best is None or shares[best] < self.threshold:
            self.rows.append(list(parts))
            return len(self.rows) - 1, "cluster_created"
        merged = [a if a == b else tp.WILD for a, b in zip(self.rows[best], parts, strict=True)]
        changed, self.rows[best] = merged != self.rows[best], merged
        return best, "cluster_template_changed" if changed else "none"


def test_indexed_clusters_equal_a_plain_search():
    rng = random.Random(0)
    for _ in range(120):
        width, threshold = rng.randint(1, 7), rng.choice([0, 0.2, 0.4, 0.5, 0.7, 1.0])
        leaf, plain = tp.LeafClusters(width, threshold), PlainLeaf(threshold)
        for _ in range(60):
            parts = [rng.choice(["a", "b", "c", "d", tp.WILD]) for _ in range(width)]
            assert leaf.add(parts) == plain.add(parts)
        assert [leaf.template(c).split(" ") for c in range(leaf.count)] == plain.rows


def test_many_templates_of_one_leaf_take_near_linear_time():
    rng, took = random.Random(1), {}
    for many in (4000, 16000):
        leaf, start = tp.LeafClusters(10, 0.4), time.perf_counter()
        for _ in range(many):
            leaf.add(["same", *(f"t{rng.randint(0, 5000)}" for _ in range(9))])
        took[many] = time.perf_counter() - start
        assert leaf.count > 0.9 * many and len(leaf.words) <= 5003
    assert took[16000] < 4 * 4 * took[4000] / 2


def hot_leaf(spark, many=600):
    """One leaf: statements that share no words beyond the first, and one with words as variables."""
    rng = random.Random(5)
    rows = []
    for i in range(many):
        verb = "qrstuvwxyz"[i % 10]
        place = "".join(rng.choice("abcdefg") for _ in range(4))
        rows.append((i, f"begin {verb}now {verb}then {place} {verb}end {verb}last {verb}ever"))
    return spark.createDataFrame(rows, "line_no long, content string")


@pytest.mark.parametrize("most", [3, 40, 70])
def test_split_leaves_give_the_catalogue_of_the_whole(spark, most):
    df = hot_leaf(spark)
    whole = sorted(map(tuple, tp.mine(df).catalogue.collect()))
    split = tp.mine(df.repartition(5), most=most)
    assert sorted(map(tuple, split.catalogue.collect())) == whole and len(whole) == 10
    assert sum(r[2] for r in whole) == 600
    assert tp.assign(df, split).where("event_id IS NULL").count() == 0


def test_units_are_exact_on_random_shapes(spark):
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    rows = [(i, "same " + " ".join(rng.choice(words[: 600 if i % 3 else 40]) for _ in range(5))) for i in range(400)]
    df = spark.createDataFrame(rows, "line_no long, content string")
    whole = sorted(map(tuple, tp.mine(df, threshold=0.6).catalogue.collect()))
    shaped = df.select(F.md5("content").alias("key"), F.lit("l").alias("leaf"), F.col("content").alias("text"))
    units = tp._units(shaped, 0.6).groupBy("root").count()
    largest = units.agg(F.max("count")).first()[0]
    assert 1 < units.count() and largest < 400
    assert sorted(map(tuple, tp.mine(df, threshold=0.6, most=max(largest, 399)).catalogue.collect())) == whole
    assert len(whole) < 400


def test_a_deeper_tree_limits_children_of_each_node(spark):
    rows = [(i, f"head{'ab'[i % 2]} kind{'cdefgh'[i // 2]} same tail words") for i in range(12)]
    df = spark.createDataFrame(rows, "line_no long, content string")
    assert tp.mine(df, depth=5, max_children=None).catalogue.count() == 12
    assert tp.mine(df, depth=5, max_children=3).catalogue.count() == 6
    assert tp.mine(df, depth=4).catalogue.count() == 2
    assert tp.mine(df, depth=3).catalogue.count() == 1


def test_templates_are_numbered_without_their_texts(spark, monkeypatch):
    """Numbering meets up to a million templates in one task, and of prose nearly every message is one."""
    seen, number = [], tp.ids_by_first_appearance
    monkeypatch.setattr(tp, "ids_by_first_appearance", lambda df, *a: number(seen.append(df.columns) or df, *a))
    told = {r.event_id: (r.template, r["count"], r.first_line) for r in tp.mine(messages(spark)).catalogue.collect()}
    assert seen == [["leaf", "tkey", "first_line"]]
    assert [told[i][2] for i in sorted(told)] == sorted(t[2] for t in told.values()) and sum(t[1] for t in told.values()) == 70


def test_texts_are_stored_once(spark, monkeypatch):
    """Of prose every table with texts is as large as the messages."""
    kept, store = {}, tp.materialize
    monkeypatch.setattr(tp, "materialize", lambda df, name="stage": kept.setdefault(name, store(df, name)))
    rows = [(i, f"alpha beta word{chr(97 + i)} number {i} ends") for i in range(20)]
    found = tp.mine(spark.createDataFrame(rows, "line_no long, content string")).catalogue.collect()
    assert [(r.template, r["count"]) for r in found] == [("alpha beta <*> number <*> ends", 20)]
    texts = {name for name, df in kept.items() if {"shape", "text", "template", "content"} & set(df.columns)}
    assert texts == {"clusters"}


def test_repeated_and_missing_lines(spark):
    """Lines need not be unique or known; a shape counts once whatever its line, and a wildcard without a line stays one."""
    rows = [(1, "send 5 to ana now"), (1, "send 7 to ana now"), (1, "take 5 from ben here"), (2, "take 5 from ben here"), (None, "drop 9 items"), (None, "drop 9 items"), (3, "<*> is up"), (4, "12 is up")]
    found = tp.mine(spark.createDataFrame(rows, "line_no long, content string"))
    got = {r.template: (r["count"], r.first_line) for r in found.catalogue.collect()}
    assert got == {"send <*> to ana now": (2, 1), "take 5 from ben here": (2, 1), "drop <*> items": (2, None), "<*> is up": (2, 3)}
