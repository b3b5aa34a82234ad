import os

import pytest
from pyspark.sql import functions as F

from faultline.functions import text as tx
from faultline.operators import parse as ps
from faultline.operators import profile as pf
from faultline.sources import logs as lg
from faultline.sources.formats import custom

HDFS = "081109 203615 148 INFO dfs.DataNode$PacketResponder: PacketResponder 1 for block blk_38865049064139660 terminating"


def parse(spark, fmt, *lines):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    return [r.asDict() for r in ps.parse_lines(df, fmt).collect()]


def test_hdfs_line(spark):
    row, wrapped, bad, empty, none = parse(spark, "hdfs", HDFS, f"\t {HDFS}　", "garbage", "", None)
    want = {"date": "081109", "time": "203615", "pid": "148", "level": "INFO", "component": "dfs.DataNode$PacketResponder",
            "content": "PacketResponder 1 for block blk_38865049064139660 terminating", "parsed_ok": True}
    assert {k: row[k] for k in want} == want and wrapped["content"] == want["content"]
    assert [r["parsed_ok"] for r in (bad, empty, none)] == [False] * 3 and bad["content"] is None


def test_bgl_and_openstack(spark):
    bgl = "- 1117838570 2005.06.03 R02-M1 2005-06-03-15.42.50.675872 R02-M1 RAS KERNEL INFO instruction cache parity error corrected"
    (b,) = parse(spark, "bgl", bgl)
    assert b["label"] == "-" and b["node_repeat"] == "R02-M1" and b["content"] == "instruction cache parity error corrected"
    os_line = "nova-api.log 2017-05-16 00:00:00.008 25746 INFO nova.osapi [req-38101a0b - - -] 10.11.10.1 GET"
    (o,) = parse(spark, "openstack", os_line)
    assert o["address"] == "[req-38101a0b - - -]" and o["pid"] == "25746" and o["content"] == "10.11.10.1 GET"


def test_custom_pattern_takes_a_prefix_and_backreferences(spark):
    fmt = custom(r"(?P<first_word>\w+) (\d+) (?P<again>(?P=first_word))")
    rows = [r.asDict() for r in ps.parse_lines(spark.createDataFrame([("ab 12 ab rest",), ("ab 12 cd",)], "value string"), fmt).collect()]
    assert rows[0]["first_word"] == "ab" and rows[0]["again"] == "ab" and not rows[1]["parsed_ok"]
    with pytest.raises(ValueError):
        custom(r"\d+")


def test_statistics_add_up_and_survive_no_input(spark):
    df = spark.createDataFrame([(HDFS,), ("x",), ("y",)], "value string")
    r = ps.parse_statistics(ps.parse_lines(df)).first()
    assert (r.total_lines, r.parsed_ok, r.failures) == (3, 1, 2) and r.success_rate == pytest.approx(100 / 3)
    assert ps.parse_statistics(ps.parse_lines(df.limit(0))).first().success_rate == 100


def test_block_ids_and_levels(spark):
    rows = [("a blk_-12 b blk_7",), ("none",), ("xblk_5",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(tx.block_id(F.col("c"))).collect()]
    assert got == ["blk_-12", None, "blk_5", None]
    lines = [("an error here",), ("terror INFORMED",), ("WARNING: x",), ("éerror warn",), ("nothing",)]
    got = [r[0] for r in spark.createDataFrame(lines, "c string").select(tx.detect_level(F.col("c"))).collect()]
    assert got == ["ERROR", None, "WARNING", "WARN", None]


def test_cuts_names_and_words(spark):
    df = spark.createDataFrame([("x" * 201, "bandwidth_mbps", "The café Disk_io 9lives a1b ok")], "a string, b string, c string")
    r = df.select(tx.ellipsis(F.col("a")).alias("a"), tx.display_name(F.col("b")).alias("b"), tx.words(F.col("c")).alias("c")).first()
    assert r.a == "x" * 200 + "..." and r.c == ["the", "disk_io", "a1b"]
    assert r.b == "Bandwidth (Mbps)"


def test_labels(spark, tmp_path):
    for name, header, want in (("a", "BlockId,Label", {"b1": 1, "b2": 0}), ("b", "block_id,label", {"b1": 1, "b2": 0}), ("c", "id,what", {"b1": 1, "b2": 0})):
        (tmp_path / f"{name}.csv").write_text(f"{header}\nb1,Anomaly\nb2,Normal\n")
        assert {r.session_id: r.label for r in lg.read_labels(spark, str(tmp_path / f"{name}.csv")).collect()} == want
    (tmp_path / "n.csv").write_text("BlockId,Label\nb1,2\nb2,0\n")
    assert {r.session_id: r.label for r in lg.read_labels(spark, str(tmp_path / "n.csv")).collect()} == {"b1": 2, "b2": 0}


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "z" * (i % 50) for i in range(1, 3001)]
    (tmp_path / "one.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "two.log").write_bytes(b"first\r\nbad \xff byte\nthird")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = lg.read_log_lines(spark, str(tmp_path), dataset="d")
        got = {(r.file, r.line_no): r.value for r in df.collect()}
        assert [got[("one.log", i)] for i in range(1, 3001)] == lines
        assert [got[("two.log", i)] for i in (1, 2, 3)] == ["first", "bad � byte", "third"]
        assert lg.read_log_lines(spark, str(tmp_path / "one.log"), max_lines=7).count() == 7
        both = lg.read_log_lines(spark, str(tmp_path), number_by="dataset")
        assert both.agg(F.max("line_no"), F.count_distinct("line_no")).first()[:] == (3003, 3003)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dataset_layouts(spark, tmp_path):
    os.makedirs(tmp_path / "HDFS_v1")
    (tmp_path / "HDFS_v1" / "HDFS.log").write_text("inside\n")
    (tmp_path / "HDFS.log").write_text("flat\n")
    os.makedirs(tmp_path / "preprocessed")
    (tmp_path / "preprocessed" / "anomaly_label.csv").write_text("BlockId,Label\n")
    (tmp_path / "openstack_normal2.log").write_text("a\nb\n")
    assert [r.value for r in lg.read_dataset(spark, str(tmp_path), "hdfs_v1").collect()] == ["inside"]
    assert len(lg.dataset_paths(spark, str(tmp_path), "hdfs_v1", "label")) == 1
    assert lg.read_dataset(spark, str(tmp_path), "openstack").count() == 2
    assert lg.read_dataset(spark, str(tmp_path), "bgl").count() == 0
    assert lg.read_dataset(spark, str(tmp_path / "nowhere"), "bgl").count() == 0


def test_inventory(spark, tmp_path):
    (tmp_path / "a.log").write_text("1\n2\n")
    (tmp_path / "b.log").write_text("1\n" * 50)
    inv = lg.file_inventory(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.lines for r in inv.collect()} == {"a.log": 2, "b.log": 50}
    assert lg.largest_file(inv).first().path.endswith("b.log")


def test_histogram_of_a_constant_and_its_closed_end(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    got = {r.bin: r.n for r in pf.histogram(df, "x", 5).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    flat = pf.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 5).collect()
    assert [(r.bin, r.n) for r in flat] == [(3, 4)]


def test_lines_survive_another_split_plan(spark, tmp_path, monkeypatch):
    """The number of cores may change between counting and reading; no line is lost."""
    monkeypatch.setattr(lg, "SPLIT_BYTES", 4096)
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000))
    (tmp_path / "a.log").write_text(text)
    df = lg.read_log_lines(spark, str(tmp_path / "a.log"))
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "17")
    try:
        got = {r.line_no: r.value for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert got == dict(enumerate(text.splitlines(), 1))


def test_dataset_kept_as_part_files(spark, tmp_path):
    folder = tmp_path / "BGL" / "BGL.log"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"part-0000{i}").write_text(f"p{i}a\np{i}b\n")
    (folder / "_SUCCESS").write_text("")
    got = sorted((r.line_no, r.value) for r in lg.read_dataset(spark, str(tmp_path), "bgl").collect())
    assert [v for _, v in got] == ["p0a", "p0b", "p1a", "p1b", "p2a", "p2b"] and [n for n, _ in got] == list(range(1, 7))


def test_quoted_csv_cells(spark):
    from faultline.sources.samples import csv_cells

    df = spark.createDataFrame([("a,b,,c",), ('1,"x,y","say ""hi""",2',), ("",)], "line string")
    got = [r[0] for r in df.select(csv_cells(F.col("line"))).collect()]
    assert got == [["a", "b", "", "c"], ["1", "x,y", 'say "hi"', "2"], [""]]
