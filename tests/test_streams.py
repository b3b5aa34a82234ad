from pyspark.sql import functions as F

from faultline.operators import parse as ps
from faultline.plans import streams as sq
from faultline.plans import views as v
from faultline.streaming import jobs
from faultline.streaming.templates import LeafState, catalogue, mine_stream


def test_stream_parse_equals_batch(spark, small):
    batch = ps.parse_lines(v.log_lines(spark, small), "hdfs")
    stream = jobs.run_to_table(jobs.parsed_stream(sq.line_stream(spark, small)), "t1")
    assert stream.exceptAll(batch.select(*stream.columns)).count() == 0 and stream.count() == batch.count()


def test_window_counts_over_several_files(spark, tmp_path):
    """Three files, one per micro-batch; the last window stays open."""
    rows = [(i, f"2024-01-01 00:{i:02d}:30", i % 2) for i in range(60)]
    src = str(tmp_path / "in")
    for part in range(3):
        df = spark.createDataFrame(rows[part * 20 : part * 20 + 20], "id int, t string, event_id int").withColumn("ts", F.to_timestamp("t"))
        df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.window_start.minute, r.event_id): r.n for r in jobs.run_to_table(jobs.window_counts(stream), "t2").collect()}
    want: dict = {}
    for i, _, e in rows:
        want[(i // 5 * 5, e)] = want.get((i // 5 * 5, e), 0) + 1
    assert got == {k: n for k, n in want.items() if k[0] + 5 <= 49}


def test_online_templates_change_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for text in ("open door one", "open door two", "open door three"):
        spark.createDataFrame([(text,)] * 4, "content string").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("content string").option("maxFilesPerTrigger", 1).parquet(src)
    rows = jobs.run_to_table(mine_stream(stream), "t3").collect()
    assert sorted((r.change_type, r.n) for r in rows) == [("cluster_created", 4), ("cluster_template_changed", 4), ("none", 4)]
    assert {r.cluster_id for r in rows} == {"3|open#0"}
    assert "open door <*>" in {r.template for r in rows}


def test_running_totals_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([(part % 2,)] * (part + 1), "event_id int").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("event_id int").option("maxFilesPerTrigger", 1).parquet(src)
    from faultline.operators.profile import running_totals

    got = {r.event_id: r.messages for r in jobs.run_totals(running_totals(stream), "t4", ["event_id"]).collect()}
    assert got == {0: 4, 1: 2}


def batches_of(spark, folder, texts):
    for text in texts:
        spark.createDataFrame([(t,) for t in text], "content string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("content string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_and_batch_agree_with_limited_children(spark, tmp_path):
    """Few children per node in both; the state holds what the batch form mines, in one or in several keys per leaf."""
    from faultline.operators import templates as tp

    words = ["alpha", "beta", "gamma", "delta", "eta", "iota"]
    lines = [f"{h} job went to {w} now" for w in words for h in ("ask", "bid", "cut", "dig")] + ["ask only once", "two words"]
    stream = batches_of(spark, str(tmp_path / "in"), [lines[:9], lines[9:20], lines[20:]])
    frame = spark.createDataFrame(list(enumerate(lines)), "line_no long, content string")
    want = {(r.template, r["count"]) for r in tp.mine(frame, max_children=3).catalogue.collect()}
    assert {t.split(" ")[0] for t, _ in want if "job" in t} == {"ask", "bid", "<*>"}
    for parts in (1, 3):
        state = str(tmp_path / f"state{parts}")
        jobs.run_to_table(mine_stream(stream, max_children=3, parts=parts), "t5", state=state)
        assert {(r.template, r["count"]) for r in catalogue(spark, state).collect()} == want
        keys = spark.read.format("state-metadata").load(state).select("operatorId").distinct().count()
        assert keys == 2


def test_only_touched_clusters_are_written(spark, tmp_path):
    stream = batches_of(spark, str(tmp_path / "in"), [["a b c", "a x y", "a q r"], ["a b c"], ["a b d"]])
    state = str(tmp_path / "state")
    rows = jobs.run_to_table(mine_stream(stream, threshold=0.6, max_children=None), "t6", state=state).collect()
    assert sorted((r.template, r.change_type) for r in rows) == sorted([
        ("a b c", "cluster_created"), ("a x y", "cluster_created"), ("a q r", "cluster_created"), ("a b c", "none"), ("a b <*>", "cluster_template_changed"),
    ])
    feed = spark.read.format("statestore").option("stateVarName", "clusters").option("readChangeFeed", True).option("changeStartBatchId", 0).load(state)
    written = {r.batch_id: r.n for r in feed.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert written[0] == 3 and written[1] == 1 and written[2] == 1


class PlainMap(dict):
    """A map state without a store."""

    getValue, containsKey, updateValue = dict.__getitem__, dict.__contains__, dict.__setitem__
    iterator, removeKey = dict.items, dict.__delitem__


class PlainValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class PlainHandle:
    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return PlainMap()

    def getValueState(self, *_):
        return PlainValue()

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_idle_clusters_are_forgotten():
    """Clusters go when their time is over, with their shapes; ordinals are not used again and the next timer is set."""
    import pandas as pd

    handle, state = PlainHandle(), LeafState(threshold=0.6, idle_ms=100)
    state.init(handle)

    def send(now, *shapes):
        return list(state.handleInputRows(("3|a", 0), iter([pd.DataFrame({"shape": shapes, "n": 1})]), Clock(now)))[0]

    send(0, "a b c", "a x y")
    send(60, "a x y")
    assert handle.timers == [100]
    handle.timers.clear()
    list(state.handleExpiredTimer(("3|a", 0), Clock(101), None))
    assert [v[0] for v in state._clusters.values()] == ["a x y"] and list(state._shapes) == [("a x y",)] and handle.timers == [160]
    again = send(120, "a b c")
    assert list(again["cluster_id"]) == ["3|a#2"] and list(again["change_type"]) == ["cluster_created"]
