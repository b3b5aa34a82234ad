"""Parsing, levels, counts and reports over log lines and manifests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from faultline.functions import text as tx
from faultline.functions.ordered import attach, id_bucket, number_rows
from faultline.operators import parse as ps
from faultline.operators import profile as pf
from faultline.operators import series as sr
from faultline.operators import sessions as ss
from faultline.operators import traces as tr
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.session import materialize
from faultline.sources import catalogue as cat
from faultline.sources.values import LAYERS

W = v.with_views
r6 = lambda c: F.round(c, 6)
BGL_RE = r"^(\S+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
OS_RE = r"^(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\w+)\s+(\S+)\s+(\[[\w\s\-\.]*\])\s+(.*)$"
LEVEL_SQL = (
    r"upper(nullif(regexp_extract({c}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(INFO|WARN|WARNING|ERROR|FATAL|DEBUG|TRACE|CRITICAL)(?:$|[^\p{{L}}\p{{N}}_])', 1), ''))"
)


def _fields_sql(regex: str, fields: tuple[str, ...]) -> str:
    """One extraction per field; the SQL engine knows nine groups, so only the wanted one captures."""
    parts = re.split(r"(?<!\\)(\((?!\?))", regex)
    out = []
    for i, f in enumerate(fields):
        own = "".join("(" if n == i else "(?:" if p == "(" else p for n, p in _numbered(parts))
        out.append(f"regexp_extract(value, '{own}', 1) AS {f}")
    return ", ".join(out)


def _numbered(parts: list[str]):
    seen = -1
    for p in parts:
        if p == "(":
            seen += 1
            yield seen, p
        else:
            yield -1, p


@query("P1_parse_hdfs", W("parsed", "SELECT line_no, date, time, pid, level, component, content FROM parsed WHERE parsed_ok"))
def parse_hdfs(spark, sf):
    return ps.route(ps.parse_lines(v.log_lines(spark, sf), "hdfs"))[0].drop("value")


_BGL = ("label", "timestamp", "date", "node", "time", "node_repeat", "type", "component", "level", "content")


@query("P2_parse_bgl", W("bgl_lines", f"SELECT line_no, {_fields_sql(BGL_RE, _BGL)} FROM bgl_lines WHERE regexp_matches(value, '{BGL_RE}')"))
def parse_bgl(spark, sf):
    return ps.route(ps.parse_lines(v.bgl_lines(spark, sf), "bgl"))[0].drop("value")


_OS = ("logrecord", "date", "time", "pid", "level", "component", "address", "content")


@query("P3_parse_openstack", W("openstack_lines", f"SELECT line_no, {_fields_sql(OS_RE, _OS)} FROM openstack_lines WHERE regexp_matches(value, '{OS_RE}')"))
def parse_openstack(spark, sf):
    return ps.route(ps.parse_lines(v.openstack_lines(spark, sf), "openstack"))[0].drop("value")


@query(
    "P4_parse_custom",
    W("log_lines", r"SELECT line_no, regexp_extract(value, '^\d+ (\d+) (\d+) (\w+)', 1) AS clock, regexp_extract(value, '^\d+ (\d+) (\d+) (\w+)', 2) AS user_no, "
      r"regexp_extract(value, '^\d+ (\d+) (\d+) (\w+)', 3) AS word FROM log_lines WHERE regexp_matches(value, '^\d+ (\d+) (\d+) (\w+)')"),
)
def parse_custom(spark, sf):
    pattern = r"\d+ (?P<clock>\d+) (?P<user_no>\d+) (?P<word>\w+)"
    return ps.route(ps.parse_lines(v.log_lines(spark, sf), pattern))[0].drop("value")


@query("P5_rejects", W("parsed", "SELECT line_no, value FROM parsed WHERE NOT parsed_ok"))
def rejects(spark, sf):
    return ps.route(ps.parse_lines(v.log_lines(spark, sf), "hdfs"))[1].select("line_no", "value")


@query("P6_block_id", W("parsed", "SELECT line_no, block_id FROM parsed WHERE parsed_ok"))
def block_ids(spark, sf):
    return v.parsed(spark, sf).where("parsed_ok").select("line_no", "block_id")


@query("P7_bgl_alerts", W("bgl_lines", f"SELECT regexp_extract(value, '{BGL_RE}', 1) <> '-' AS alert, count(*) AS n FROM bgl_lines WHERE regexp_matches(value, '{BGL_RE}') GROUP BY 1"))
def bgl_alerts(spark, sf):
    rec = ps.route(ps.parse_lines(v.bgl_lines(spark, sf), "bgl"))[0]
    return pf.value_counts(rec.select(ps.alert_flag().alias("alert")), "alert")


@query("P8_detect_level", "SELECT doc_id, " + LEVEL_SQL.format(c="text") + " AS level FROM documents")
def detect_level(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.detect_level(F.col("text")).alias("level"))


@query("P8_detect_level_lines", W("log_lines", "SELECT line_no, " + LEVEL_SQL.format(c="value") + " AS level FROM log_lines"))
def detect_level_lines(spark, sf):
    return v.log_lines(spark, sf).select("line_no", tx.detect_level(F.col("value")).alias("level"))


@query("P9_session_events", W("parsed", "SELECT line_no, block_id, CAST(length(component) AS INTEGER) AS event_id FROM parsed WHERE block_id IS NOT NULL"))
def session_events(spark, sf):
    rec = v.parsed(spark, sf).select("line_no", "block_id", F.length("component").cast("string").alias("event_id"))
    return ps.keep_session_events(rec)


@query("P10_non_null_content", W("parsed", "SELECT line_no, content FROM parsed WHERE content IS NOT NULL"))
def non_null_content(spark, sf):
    return v.parsed(spark, sf).where("content IS NOT NULL").select("line_no", "content")


@query(
    "P11_normalize_label",
    "SELECT event_id, CAST(CASE WHEN lower(w) IN ('anomaly', 'abnormal', '1') THEN 1 ELSE 0 END AS INTEGER) AS from_text, CAST(event_id % 3 AS INTEGER) AS from_number "
    "FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'Anomaly' WHEN 'signup' THEN 'ABNORMAL' WHEN 'view' THEN '1' ELSE 'Normal' END AS w FROM events)",
)
def normalize_label(spark, sf):
    words = F.when(F.col("event_type") == "error", "Anomaly").when(F.col("event_type") == "signup", "ABNORMAL").when(F.col("event_type") == "view", "1").otherwise("Normal")
    rec = v.table(spark, sf, "events").select("event_id", words.alias("w"), (F.col("event_id") % 3).alias("num"))
    return rec.select("event_id", ps.normalize_label(rec, "w").alias("from_text"), ps.normalize_label(rec, "num").alias("from_number"))


_SAMPLE_SQL = """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, lvl AS level, upper(event_type) AS layer, msg AS content FROM evm"""


@query("P12_parse_sample_line", W("evm", _SAMPLE_SQL))
def parse_sample_line(spark, sf):
    lines = v._ev(spark, sf).select(
        "event_id",
        F.format_string("%s [%-8s] [%-12s] %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.col("lvl"), F.upper("event_type"), F.col("msg")).alias("value"),
    )
    rec = ps.route(ps.parse_lines(lines, "sample"))[0]
    typed = rec.withColumn("ts", F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
    return typed.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_text"), "level", "layer", "content")


@query("P13_slow_calls", W("calls", "SELECT event_id, um, dm, rt, rt > 30 AS slow FROM calls"))
def slow_calls(spark, sf):
    return tr.flag_slow_calls(v.calls(spark, sf)).select("event_id", "um", "dm", "rt", "slow")


@query("P14_pick_samples", W("manifest", "SELECT sample_id, layer, scenario_id FROM manifest WHERE is_anomaly = 1 AND layer = 'building' ORDER BY sample_id LIMIT 5"))
def pick_samples(spark, sf):
    return ps.pick_samples(v.manifest(spark, sf), 5, 1, "building").select("sample_id", "layer", "scenario_id")


@query("P17_truncate", "SELECT doc_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS short, text[1:150] AS cut FROM documents")
def truncate(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", tx.ellipsis(F.col("text")).alias("short"), tx.plain_cut(F.col("text"), 150).alias("cut"))


@query(
    "P18_display_name",
    W("metric_points", "SELECT metric, CASE metric WHEN 'response_time_ms' THEN 'Response Time (Ms)' WHEN 'latency_ms' THEN 'Latency (Ms)' WHEN 'disk_usage_pct' THEN 'Disk Usage %' "
      "WHEN 'cpu_usage_pct' THEN 'Cpu Usage %' ELSE 'Page Views' END AS shown, count(*) AS n FROM metric_points GROUP BY 1"),
)
def display_name(spark, sf):
    counts = pf.value_counts(v.metric_points(spark, sf), "metric")
    return counts.select("metric", tx.display_name(F.col("metric")).alias("shown"), "n")


@query(
    "A1_parse_statistics",
    W("parsed", "SELECT count(*) AS total_lines, count(*) FILTER (parsed_ok) AS parsed_ok, count(*) FILTER (NOT parsed_ok) AS failures, "
      "round((1 - count(*) FILTER (NOT parsed_ok) / greatest(count(*), 1)) * 100, 6) AS success_rate FROM parsed"),
)
def parse_statistics(spark, sf):
    return ps.parse_statistics(v.parsed(spark, sf)).withColumn("success_rate", r6("success_rate"))


@query("A2_level_counts", W("parsed", "SELECT level, count(*) AS n FROM parsed WHERE parsed_ok GROUP BY 1"))
def level_counts(spark, sf):
    return pf.value_counts(v.parsed(spark, sf).where("parsed_ok"), "level")


@query("A2_manifest_counts", W("manifest", "SELECT layer, severity, count(*) AS n FROM manifest GROUP BY 1, 2"))
def manifest_counts(spark, sf):
    return pf.value_counts(v.manifest(spark, sf), "layer", "severity")


@query("A3_level_histogram", "SELECT source, level, count(*) AS n FROM (SELECT source, " + LEVEL_SQL.format(c="text") + " AS level FROM documents) WHERE level IS NOT NULL GROUP BY 1, 2")
def level_histogram(spark, sf):
    return pf.level_histogram(v.table(spark, sf, "documents"), "text", ("source",))


@query("A3_level_histogram_lines", W("log_lines", "SELECT level, count(*) AS n FROM (SELECT " + LEVEL_SQL.format(c="value") + " AS level FROM log_lines) WHERE level IS NOT NULL GROUP BY 1"))
def level_histogram_lines(spark, sf):
    return pf.level_histogram(v.log_lines(spark, sf))


@query("A3_line_length", W("log_lines", "SELECT count(*) AS lines, round(avg(length(value)), 6) AS avg_length FROM log_lines"))
def line_length(spark, sf):
    return pf.line_length(v.log_lines(spark, sf)).withColumn("avg_length", r6("avg_length"))


_STACK = "SELECT 'HDFS' AS dataset, value FROM log_lines UNION ALL SELECT 'BGL', value FROM bgl_lines UNION ALL SELECT 'OpenStack', value FROM openstack_lines"


@query(
    "A4_dataset_comparison",
    W("log_lines bgl_lines openstack_lines", f"WITH l AS (SELECT dataset, value, {LEVEL_SQL.format(c='value')} AS level FROM ({_STACK})), "
      "c AS (SELECT dataset, level, count(*) AS n FROM l WHERE level IS NOT NULL GROUP BY 1, 2), "
      "t AS (SELECT dataset, string_agg(level || ':' || n, ', ' ORDER BY n DESC, level) AS levels FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, level) AS r FROM c) WHERE r <= 5 GROUP BY 1) "
      "SELECT dataset, count(*) AS lines, round((sum(strlen(value)) + count(*)) / 1048576, 6) AS size_mb, round(avg(length(value)), 6) AS avg_length, any_value(levels) AS levels FROM l JOIN t USING (dataset) GROUP BY 1"),
)
def dataset_comparison(spark, sf):
    parts = [(n, f(spark, sf)) for n, f in (("HDFS", v.log_lines), ("BGL", v.bgl_lines), ("OpenStack", v.openstack_lines))]
    frames = [d.select(F.lit(n).alias("dataset"), "value") for n, d in parts]
    out = pf.dataset_comparison(frames[0].unionByName(frames[1]).unionByName(frames[2]))
    return out.withColumn("size_mb", r6("size_mb")).withColumn("avg_length", r6("avg_length"))


@query(
    "A5_block_statistics",
    W("parsed", "SELECT count(*) AS rows, count(block_id) AS with_block, round(count(block_id) / count(*) * 100, 6) AS share_pct, count(DISTINCT block_id) AS blocks FROM parsed WHERE parsed_ok"),
)
def block_statistics(spark, sf):
    return pf.block_statistics(v.parsed(spark, sf).where("parsed_ok")).withColumn("share_pct", r6("share_pct"))


@query(
    "A6_session_lengths",
    W("records", "SELECT count(*) AS sessions, min(n) AS min_len, max(n) AS max_len, round(avg(n), 6) AS mean_len, median(n) AS median_len FROM (SELECT session_id, count(*) AS n FROM records GROUP BY 1)"),
)
def session_lengths(spark, sf):
    out = pf.session_length_statistics(v.records(spark, sf))
    return out.withColumn("mean_len", r6("mean_len"))


@query(
    "A9_event_prevalence",
    W("records", "WITH p AS (SELECT event_id, count(DISTINCT session_id) AS n FROM records GROUP BY 1), s AS (SELECT count(DISTINCT session_id) AS t FROM records) "
      "SELECT count(*) AS events, count(*) FILTER (n = t) AS in_all, count(*) FILTER (n / t < 0.1) AS in_few FROM p, s"),
)
def event_prevalence(spark, sf):
    return pf.event_prevalence(v.records(spark, sf))


@query("A10_class_balance", W("session_labels", "SELECT count(*) FILTER (label = 0) AS normal, CAST(sum(label) AS BIGINT) AS anomaly, round(sum(label) / count(*) * 100, 6) AS anomaly_pct FROM session_labels"))
def class_balance(spark, sf):
    return pf.class_balance(v.session_labels(spark, sf)).withColumn("anomaly_pct", r6("anomaly_pct"))


@query(
    "A11_contingency_margins",
    W("manifest", "SELECT CASE WHEN grouping(layer) = 1 THEN 'All' ELSE layer END AS layer, count(*) FILTER (is_anomaly = 0) AS c_0, count(*) FILTER (is_anomaly = 1) AS c_1, count(*) AS \"All\" "
      "FROM manifest GROUP BY ROLLUP(layer)"),
)
def contingency_margins(spark, sf):
    return pf.contingency_with_margins(v.manifest(spark, sf), "layer", "is_anomaly", [0, 1])


_CAUSES = ["africa", "america", "asia", "europe", "middle east"]


@query(
    "A12_contingency",
    W("manifest", "SELECT layer, " + ", ".join(f"count(*) FILTER (root_cause_category = '{c}') AS \"{c}\"" for c in _CAUSES) + " FROM manifest WHERE is_anomaly = 1 GROUP BY 1"),
)
def contingency(spark, sf):
    return pf.contingency(v.manifest(spark, sf).where("is_anomaly = 1"), "layer", "root_cause_category", _CAUSES)


@query("A13_layer_breakdown", W("manifest", "SELECT layer, count(*) AS total, CAST(sum(is_anomaly) AS BIGINT) AS anomalies FROM manifest GROUP BY 1"))
def layer_breakdown(spark, sf):
    return pf.layer_breakdown(v.manifest(spark, sf))


@query("A14_scenario_breakdown", W("manifest", "SELECT scenario_id, min(scenario_name) AS name, count(*) AS n FROM manifest WHERE scenario_id <> '' GROUP BY 1"))
def scenario_breakdown(spark, sf):
    return pf.scenario_breakdown(v.manifest(spark, sf))


@query(
    "A15_cardinalities",
    W("manifest", "SELECT count(DISTINCT layer) AS n_layer, count(DISTINCT scenario_id) AS n_scenario_id, count(DISTINCT root_cause_category) AS n_root_cause_category, count(DISTINCT severity) AS n_severity "
      "FROM manifest WHERE is_anomaly = 1"),
)
def cardinalities(spark, sf):
    return pf.cardinalities(v.manifest(spark, sf).where("is_anomaly = 1"), "layer", "scenario_id", "root_cause_category", "severity")


def sample_lines(spark, sf):
    """Sample-log lines of each user with their position; a user's first event carries the class."""
    ev = v._ev(spark, sf).select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("sample_id"), F.col("event_id").alias("line_no"), "lvl",
        F.format_string("[%-8s] [%-12s] %s", F.col("lvl"), F.upper("event_type"), F.col("msg")).alias("value"),
    )
    return ev


_SAMPLE_CTE = (
    "sl AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS sample_id, event_id AS line_no, "
    "'[' || rpad(lvl, 8, ' ') || '] [' || rpad(upper(event_type), 12, ' ') || '] ' || msg AS value FROM evm)"
)
_HITS = ", ".join(
    f"CAST(sum((length(value) - length(replace(value, '[{w}', ''))) // {len(w) + 1}) AS BIGINT) AS {w.lower()}" for w in ("INFO", "WARN", "ERROR", "CRITICAL")
)


@query(
    "A16_sample_levels",
    W("evm", f"WITH {_SAMPLE_CTE} SELECT sample_id, {_HITS} FROM sl GROUP BY 1"),
)
def sample_levels(spark, sf):
    return pf.sample_level_counts(sample_lines(spark, sf))


@query(
    "A16_mean_levels_by_class",
    W("evm", f"WITH {_SAMPLE_CTE}, c AS (SELECT sample_id, {_HITS}, min(line_no) % 2 AS is_anomaly FROM sl GROUP BY 1), "
      "r AS (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY sample_id) AS r FROM c) "
      "SELECT CAST(is_anomaly AS INTEGER) AS is_anomaly, round(avg(info), 6) AS avg_info, round(avg(warn), 6) AS avg_warn, round(avg(error), 6) AS avg_error, round(avg(critical), 6) AS avg_critical FROM r WHERE r <= 50 GROUP BY 1"),
)
def mean_levels_by_class(spark, sf):
    lines = sample_lines(spark, sf)
    classes = lines.groupBy("sample_id").agg((F.min("line_no") % 2).cast("int").alias("is_anomaly"))
    out = pf.mean_levels_by_class(pf.sample_level_counts(lines), classes)
    return out.select("is_anomaly", *[r6(c).alias(c) for c in out.columns[1:]])


@query("A17_caller_counts", W("calls", "SELECT um, count(*) AS n FROM calls GROUP BY 1"))
def caller_counts(spark, sf):
    return pf.caller_counts(v.calls(spark, sf))


@query(
    "A17_fan_out",
    W("calls", "SELECT um, count(*) AS calls, count(DISTINCT dm) AS callees, round(count(*) FILTER (rt > 30) / count(*), 6) AS slow_share FROM calls GROUP BY 1"),
)
def fan_out(spark, sf):
    return tr.caller_fan_out(v.calls(spark, sf)).withColumn("slow_share", r6("slow_share"))


def _hist_sql(bins: int, source: str, value: str) -> str:
    return (
        f"WITH s AS (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) SELECT CAST(least(floor(({value} - lo) * {bins} / (hi - lo)) + 1, {bins}) AS INTEGER) AS bin, "
        f"count(*) AS n, min({value}) AS lowest, max({value}) AS highest FROM {source}, s GROUP BY 1"
    )


@query("A18_histogram_rt", W("calls", _hist_sql(50, "calls", "rt")))
def histogram_rt(spark, sf):
    return pf.histogram(v.calls(spark, sf), "rt", 50)


@query("A18_histogram_doc_length", _hist_sql(30, "(SELECT length(text)::DOUBLE AS len FROM documents)", "len"))
def histogram_doc_length(spark, sf):
    return pf.histogram(v.table(spark, sf, "documents").select(F.length("text").cast("double").alias("len")), "len", 30)


@query(
    "A19_five_numbers",
    "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in (("q0", 0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1))) + " FROM lineitem GROUP BY 1",
)
def five_numbers(spark, sf):
    out = pf.five_numbers(v.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns[1:]])


@query(
    "A19_sketched_numbers",
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(min(l_extendedprice), 6) AS q0, round(max(l_extendedprice), 6) AS q100, 0 AS outside FROM lineitem GROUP BY 1",
)
def sketched_numbers(spark, sf):
    """Sketches per ship month, merged per flag; ``outside`` counts quartiles whose true rank is off by more than the sketch's bound."""
    rows = v.table(spark, sf, "lineitem").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice")
    merged = pf.merge_sketches(pf.quantile_sketches(rows, "l_extendedprice", ["l_returnflag", "month"]), ["l_returnflag"])
    told = materialize(pf.sketched_five_numbers(merged), "sketched")
    beside = attach(rows, told, ["l_returnflag"])
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    below = [F.count_if(F.col("l_extendedprice") < F.col(q)).alias(f"lt_{q}") for q in probs]
    upto = [F.count_if(F.col("l_extendedprice") <= F.col(q)).alias(f"le_{q}") for q in probs]
    ranks = beside.groupBy("l_returnflag", "rows", "q0", "q100").agg(*below, *upto)
    off = [F.greatest(F.col(f"lt_{q}") - p * F.col("rows"), p * F.col("rows") - F.col(f"le_{q}")) > 0.01 * F.col("rows") for q, p in probs.items()]
    outside = sum((o.cast("int") for o in off[1:]), off[0].cast("int"))
    return ranks.select("l_returnflag", "rows", r6("q0").alias("q0"), r6("q100").alias("q100"), outside.alias("outside"))


@query(
    "A19_session_box",
    W("records", "SELECT " + ", ".join(f"round(quantile_cont(n, {p}), 6) AS {n}" for n, p in (("q0", 0), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q100", 1))) + " FROM (SELECT session_id, count(*)::DOUBLE AS n FROM records GROUP BY 1)"),
)
def session_box(spark, sf):
    lengths = v.records(spark, sf).groupBy("session_id").agg(F.count("*").cast("double").alias("n"))
    out = pf.five_numbers(lengths, "n")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "A20_sample_facts",
    W("metric_points evm", "WITH f AS (SELECT sample_id, metric, count(*) AS points, min(ts) AS a, max(ts) AS b FROM metric_points GROUP BY 1, 2), "
      "l AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, count(*) AS num_log_lines FROM evm GROUP BY 1) "
      "SELECT sample_id, any_value(num_log_lines) AS num_log_lines, max(points) AS num_metric_points, string_agg(metric, ',' ORDER BY metric) AS metrics, "
      "strftime(min(a), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_start, strftime(max(b), '%Y-%m-%d %H:%M:%S.%f') AS timestamp_end FROM f JOIN l USING (sample_id) GROUP BY 1"),
)
def sample_facts(spark, sf):
    pts = v.metric_points(spark, sf).withColumn("slot", F.array_position(F.array(*[F.lit(m) for m in sorted(v.METRICS.values())]), F.col("metric")))
    logs = v.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sample_id"))
    out = pf.sample_facts(logs, pts)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return out.select("sample_id", "num_log_lines", "num_metric_points", F.array_join("metrics", ",").alias("metrics"), fmt("timestamp_start"), fmt("timestamp_end"))


@query("T1_top_components", W("parsed", "SELECT component, count(*) AS n FROM parsed WHERE parsed_ok GROUP BY 1 ORDER BY n DESC, component LIMIT 3"))
def top_components(spark, sf):
    return pf.top_counts(v.parsed(spark, sf).where("parsed_ok"), 3, "component")


@query("T5_preview", W("log_lines", "SELECT file, line_no, value FROM (SELECT 'part' || (line_no % 4) AS file, row_number() OVER (PARTITION BY line_no % 4 ORDER BY line_no) AS line_no, value FROM log_lines) WHERE line_no <= 5 AND file < 'part3'"))
def preview(spark, sf):
    lines = v.log_lines(spark, sf).withColumn("file", F.concat(F.lit("part"), (F.col("line_no") % 4).cast("string")))
    numbered = number_rows(lines, ["file"], ["line_no"], id_bucket("line_no"), "pos")
    return pf.preview(numbered.select("file", F.col("pos").alias("line_no"), "value"), 5, 3)


@query("T6_subsample", "SELECT least(5000, count(*)) AS n, least(5000, count(*)) AS n_ids FROM lineitem")
def subsample(spark, sf):
    keyed = v.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"))
    return pf.subsample(keyed, "id").agg(F.count("*").alias("n"), F.count("id").alias("n_ids"))


@query("U1_shared_ids", W("records session_labels", "SELECT DISTINCT r.session_id FROM records r JOIN session_labels l ON r.session_id = l.session_id WHERE l.label = 1"))
def shared_ids(spark, sf):
    return pf.shared_ids(v.records(spark, sf), v.session_labels(spark, sf).where("label = 1"))


@query("U2_concatenate", W("log_lines bgl_lines openstack_lines", f"SELECT dataset, count(*) AS lines FROM ({_STACK}) GROUP BY 1"))
def concatenate(spark, sf):
    parts = [(n, f(spark, sf)) for n, f in (("HDFS", v.log_lines), ("BGL", v.bgl_lines), ("OpenStack", v.openstack_lines))]
    frames = [d.groupBy().agg(F.count("*").alias("lines")).select(F.lit(n).alias("dataset"), "lines") for n, d in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("U3_vocabulary", W("records", "SELECT DISTINCT event_id FROM records"))
def vocabulary(spark, sf):
    return pf.vocabulary(v.records(spark, sf))


@query(
    "U4_missing_and_extra",
    W("records session_labels", "WITH s AS (SELECT session_id, event_id, label FROM records JOIN session_labels USING (session_id)), "
      "p AS (SELECT length(session_id) AS width, min(CASE WHEN label = 0 THEN session_id END) AS normal_id, min(CASE WHEN label = 1 THEN session_id END) AS anomaly_id FROM session_labels GROUP BY 1), "
      "e AS (SELECT session_id, list(DISTINCT event_id) AS ev FROM s GROUP BY 1) "
      "SELECT normal_id, anomaly_id, array_to_string(list_sort(list_filter(n.ev, lambda x: NOT list_contains(a.ev, x))), ',') AS missing, array_to_string(list_sort(list_filter(a.ev, lambda x: NOT list_contains(n.ev, x))), ',') AS extra "
      "FROM p JOIN e n ON n.session_id = normal_id JOIN e a ON a.session_id = anomaly_id"),
)
def missing_and_extra(spark, sf):
    labels = v.session_labels(spark, sf).withColumn("width", F.length("session_id"))
    pairs = ss.pair_sessions(labels, "width").drop("width")
    sets = v.records(spark, sf).groupBy("session_id").agg(F.collect_set("event_id").alias("ev"))
    n = sets.select(F.col("session_id").alias("normal_id"), F.col("ev").alias("nev"))
    a = sets.select(F.col("session_id").alias("anomaly_id"), F.col("ev").alias("aev"))
    missing, extra = pf.missing_and_extra(F.col("nev"), F.col("aev"))
    joined = pairs.join(n, "normal_id").join(a, "anomaly_id")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return joined.select("normal_id", "anomaly_id", text(missing).alias("missing"), text(extra).alias("extra"))


@query(
    "J4_scenario_facts",
    W("manifest catalogue", "SELECT sample_id, m.scenario_id, coalesce(c.name, '?') AS info_name, coalesce(c.layer, '?') AS info_layer, coalesce(c.root_cause, '?') AS info_root_cause, coalesce(c.severity, '?') AS info_severity "
      "FROM manifest m LEFT JOIN catalogue c USING (scenario_id) WHERE is_anomaly = 1"),
)
def scenario_facts(spark, sf):
    bad = v.manifest(spark, sf).where("is_anomaly = 1").select("sample_id", "scenario_id")
    return cat.remediation_for(bad, cat.scenarios(spark)).drop("actions")


@query(
    "R9_remediation",
    W("manifest catalogue", "SELECT sample_id, m.scenario_id, coalesce(c.name, '?') AS info_name, CASE WHEN c.name IS NOT NULL THEN s.i END AS step, CASE s.i WHEN 0 THEN action1 ELSE action2 END AS action "
      "FROM manifest m LEFT JOIN catalogue c USING (scenario_id) JOIN (VALUES (0), (1)) s(i) ON (c.name IS NOT NULL OR s.i = 0) WHERE is_anomaly = 1"),
)
def remediation(spark, sf):
    bad = v.manifest(spark, sf).where("is_anomaly = 1").select("sample_id", "scenario_id")
    known = cat.remediation_for(bad, cat.scenarios(spark))
    return known.select("sample_id", "scenario_id", "info_name", F.posexplode_outer("actions").alias("step", "action"))


@query("S11_scenario_layers", W("manifest catalogue", "SELECT c.layer, c.category, count(*) AS n FROM manifest JOIN catalogue c USING (scenario_id) GROUP BY 1, 2"))
def scenario_layers(spark, sf):
    dim = cat.scenarios(spark).select("scenario_id", F.col("layer").alias("clayer"), F.col("root_cause_category").alias("category"))
    joined = v.manifest(spark, sf).join(dim, "scenario_id")
    return joined.groupBy(F.col("clayer").alias("layer"), "category").agg(F.count("*").alias("n"))


_LAYER_METRICS = ", ".join(f"('{m}', '{k}')" for k, _, ms in LAYERS for m in ms)


@query("S11_layers_of_metrics", W("metric_points", f"SELECT l.layer, count(*) AS points FROM metric_points JOIN (VALUES {_LAYER_METRICS}) l(metric, layer) USING (metric) GROUP BY 1"))
def layers_of_metrics(spark, sf):
    pairs = cat.layers(spark).select("layer", F.explode("metrics").alias("metric"))
    per_metric = v.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    names = F.create_map(*[F.lit(x) for kv in v.METRICS.items() for x in kv])
    counted = per_metric.select(names[F.col("event_type")].alias("metric"), "n")
    return counted.join(pairs, "metric").groupBy("layer").agg(F.sum("n").alias("points"))


@query(
    "W9_stratified_quota",
    W("manifest", "WITH s AS (SELECT layer, row_number() OVER (ORDER BY layer) AS i, count(*) OVER () AS k, n FROM (SELECT layer, count(*) AS n FROM manifest GROUP BY 1)) "
      "SELECT layer, least(n, 103 // k + CASE WHEN i <= 103 % k THEN 1 ELSE 0 END) AS drawn FROM s WHERE least(n, 103 // k + CASE WHEN i <= 103 % k THEN 1 ELSE 0 END) > 0"),
)
def stratified_quota(spark, sf):
    return sr.quota_sample(v.manifest(spark, sf), "layer", "sample_id", 103).groupBy("layer").agg(F.count("*").alias("drawn"))
