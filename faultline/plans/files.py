"""Readers and writers, run over files that Spark first derives from the tables into the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import parse as ps
from faultline.operators import sessions as ss
from faultline.plans import text as tq
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.session import scratch_path
from faultline.sources import catalogue as cat
from faultline.sources import logs as lg
from faultline.sources import samples as sm
from faultline.sources import sinks as sk
from faultline.sources import traces as tc

W = v.with_views
r6 = lambda c: F.round(c, 6)


def write_log_files(spark, sf) -> str:
    """Log lines of each event type as one log in several part files, ordered by part."""
    path = scratch_path(spark, "lines")
    lines = v.log_lines(spark, sf).join(v.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "event_type"), "line_no")
    ordered = lines.repartitionByRange(6, "event_type", "line_no").sortWithinPartitions("event_type", "line_no")
    ordered.select("event_type", "value").write.partitionBy("event_type").text(path)
    return path


_LINES = "SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY line_no) AS line_no, value FROM log_lines JOIN (SELECT event_id AS line_no, event_type FROM events) USING (line_no)"


@query("S1_numbered_lines", W("log_lines", _LINES))
def numbered_lines(spark, sf):
    root = write_log_files(spark, sf)
    frames = [
        lg.read_log_lines(spark, f"{root}/event_type={t}", dataset=t, number_by="dataset").select(F.col("dataset").alias("event_type"), "line_no", "value")
        for t in v.EVENT_TYPES
    ]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


@query("S1_first_lines", W("log_lines", f"SELECT line_no, value FROM ({_LINES}) WHERE event_type = 'error' AND line_no <= 1000"))
def first_lines(spark, sf):
    root = write_log_files(spark, sf)
    return lg.read_log_lines(spark, f"{root}/event_type=error", max_lines=1000, number_by="dataset").select("line_no", "value")


@query("S2_dataset_lines", W("log_lines bgl_lines openstack_lines", "SELECT 'bgl' AS dataset, count(*) AS lines FROM bgl_lines UNION ALL SELECT 'openstack', count(*) FROM openstack_lines"))
def dataset_lines(spark, sf):
    """Known datasets below a root folder; the one that is not there gives no rows."""
    root = scratch_path(spark, "raw")
    v.bgl_lines(spark, sf).select("value").write.text(f"{root}/BGL/BGL.log")
    v.openstack_lines(spark, sf).select("value").write.text(f"{root}/openstack_normal1.log")
    out = lg.read_dataset(spark, f"{root}/absent", "hdfs_v1").groupBy("dataset").agg(F.count("*").alias("lines"))
    for key in ("bgl", "openstack"):
        out = out.unionByName(lg.read_dataset(spark, root, key).groupBy("dataset").agg(F.count("*").alias("lines")))
    return out


@query("S3_file_inventory", W("log_lines", f"SELECT event_type, count(*) AS lines, CAST(sum(strlen(value) + 1) AS BIGINT) AS bytes FROM ({_LINES}) GROUP BY 1"))
def file_inventory(spark, sf):
    inv = lg.file_inventory(spark, write_log_files(spark, sf))
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1)
    return inv.groupBy(kind.alias("event_type")).agg(F.sum("lines").alias("lines"), F.round(F.sum("size_mb") * 1024 * 1024).cast("long").alias("bytes"))


@query("S3_largest_file", W("log_lines", f"SELECT max(n) AS lines FROM (SELECT count(*) AS n, sum(strlen(value)) AS b FROM ({_LINES}) GROUP BY event_type QUALIFY row_number() OVER (ORDER BY b DESC) = 1)"))
def largest_file(spark, sf):
    root = scratch_path(spark, "whole")
    lines = v.log_lines(spark, sf).join(v.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "event_type"), "line_no")
    lines.select("event_type", "value").write.partitionBy("event_type").text(root)
    inv = lg.file_inventory(spark, root).withColumn("path", F.regexp_extract("path", "event_type=([^/]+)", 1))
    per_log = inv.groupBy("path").agg(F.sum("lines").alias("lines"), F.sum("size_mb").alias("size_mb"))
    return lg.largest_file(per_log).select("lines")


@query("S4_labels", W("session_labels", "SELECT session_id, label FROM session_labels"))
def labels(spark, sf):
    path = scratch_path(spark, "labels")
    words = F.when(F.col("label") == 1, "Anomaly").otherwise("Normal")
    v.session_labels(spark, sf).select(F.col("session_id").alias("BlockId"), words.alias("Label")).write.csv(path, header=True)
    return lg.read_labels(spark, path)


@query("S5_parsed_csv", W("parsed", "SELECT line_no, level, component, content, block_id FROM parsed WHERE parsed_ok"))
def parsed_csv(spark, sf):
    path = scratch_path(spark, "parsed")
    rec = v.parsed(spark, sf).where("parsed_ok").select("line_no", "level", "component", "content", "block_id")
    rec.write.csv(path, header=True, escape='"')
    return lg.read_parsed(spark, path, rec.schema, "csv")


@query("S6_template_csv", W("records", "SELECT event_id AS cluster_id, component || ', <*>' AS template, count(*) AS count FROM records GROUP BY 1, 2"))
def template_csv(spark, sf):
    path = scratch_path(spark, "templates")
    cat = v.records(spark, sf).groupBy(F.col("event_id").alias("cluster_id"), F.concat("component", F.lit(", <*>")).alias("template")).agg(F.count("*").alias("count"))
    sk.write_templates(cat, path)
    return lg.read_templates(spark, path)


def manifest_rows(spark, sf):
    m = v.manifest(spark, sf)
    folder = lambda kind, ext: F.concat(F.lit(f"{kind}/"), "sample_id", F.lit(ext))
    return m.select(
        "sample_id", "layer", "layer_name", "is_anomaly", "scenario_id", "scenario_name", "root_cause_category", "severity",
        folder("logs", ".txt").alias("log_path"), folder("metrics", ".csv").alias("metrics_path"), F.lit("").alias("dashboard_path"), folder("labels", ".json").alias("label_path"),
    )


@query("S7_manifest", W("manifest", "SELECT sample_id, layer, is_anomaly, nullif(scenario_id, '') AS scenario_id, nullif(severity, '') AS severity, 'logs/' || sample_id || '.txt' AS log_path FROM manifest"))
def manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    manifest_rows(spark, sf).write.csv(path, header=True, escape='"')
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return sm.read_manifest(spark, path).select("sample_id", "layer", "is_anomaly", blank("scenario_id"), blank("severity"), "log_path")


@query("S8_metric_series", "SELECT sample_no, metric, count(*) AS points, round(sum(value), 6) AS total FROM (SELECT CAST(user_id % 7 AS INTEGER) AS sample_no, unnest(CASE WHEN user_id % 7 < 3 THEN [{'metric': 'a', 'value': value}, {'metric': 'b', 'value': user_id::DOUBLE}] "
       "ELSE [{'metric': 'a', 'value': value}, {'metric': 'c', 'value': user_id * 2.0::DOUBLE}] END, recursive := true) FROM events) GROUP BY 1, 2")
def metric_series(spark, sf):
    """Metric files whose columns differ: samples 0-2 carry a and b, the others a and c."""
    root = scratch_path(spark, "series")
    rows = v.table(spark, sf, "events").select((F.col("user_id") % 7).cast("int").alias("sample_no"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("value").alias("a"), F.col("user_id").cast("double").alias("b"))
    rows.where("sample_no < 3").write.partitionBy("sample_no").csv(f"{root}/first", header=True)
    rows.where("sample_no >= 3").withColumn("b", F.col("b") * 2).withColumnRenamed("b", "c").write.partitionBy("sample_no").csv(f"{root}/second", header=True)
    series = sm.read_metric_series(spark, [f"{root}/first", f"{root}/second"], key="path", recursiveFileLookup="true")
    number = F.regexp_extract("sample_id", r"sample_no=(\d+)", 1).cast("int")
    return series.groupBy(number.alias("sample_no"), "metric").agg(F.count("*").alias("points"), r6(F.sum("value")).alias("total"))


@query("S9_sample_logs", W("log_lines", f"SELECT event_type, max(line_no) AS last_line, count(*) AS lines FROM ({_LINES}) GROUP BY 1"))
def sample_logs(spark, sf):
    root = scratch_path(spark, "logs")
    lines = v.log_lines(spark, sf).join(v.table(spark, sf, "events").select(F.col("event_id").alias("line_no"), "event_type"), "line_no")
    lines.select("event_type", "value").write.partitionBy("event_type").text(root)
    read = sm.read_sample_logs(spark, root, key="path")
    kind = F.regexp_extract("sample_id", "event_type=([^/]+)", 1)
    per_file = read.groupBy("sample_id").agg(F.max("line_no").alias("last"), F.count("*").alias("n"))
    return per_file.groupBy(kind.alias("event_type")).agg(F.sum("last").alias("last_line"), F.sum("n").alias("lines"))


@query("S10_label_documents", W("manifest", "SELECT sample_id, is_anomaly = 1 AS is_anomaly, scenario_id, anomaly_start_idx, 'm1,m2' AS metrics FROM manifest"))
def label_documents(spark, sf):
    path = scratch_path(spark, "documents")
    docs = v.manifest(spark, sf).select(
        "sample_id", (F.col("is_anomaly") == 1).alias("is_anomaly"), "scenario_id", "anomaly_start_idx", F.array(F.lit("m1"), F.lit("m2")).alias("metrics")
    )
    docs.write.option("ignoreNullFields", False).json(path)
    # Written as one document per line; the reader also takes one document per file.
    out = sm.read_label_documents(spark, path, per_line=True)
    return out.select("sample_id", "is_anomaly", "scenario_id", "anomaly_start_idx", F.array_join("metrics", ",").alias("metrics"))


def write_json_document(df, document, path):
    """One JSON document for a whole table; it is configuration, so it fits one row."""
    df.agg(F.to_json(document).alias("value")).write.text(path)


@query(
    "S12_read_prompts",
    "SELECT c_custkey, r_name AS name, 'You look after ' || lower(r_name) AS system, 'Case ' || c_custkey || ' of ' || r_name AS user "
    "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def read_prompts(spark, sf):
    """Prompt templates from a JSON file, filled in for every customer of the region they are for."""
    path = scratch_path(spark, "prompts")
    text = F.struct(F.concat(F.lit("You look after "), F.lower("r_name")).alias("system"), F.concat(F.lit("Case {case} of "), F.col("r_name")).alias("user"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("r_name"), text)))
    write_json_document(v.table(spark, sf, "region"), entries, path)
    places = v.table(spark, sf, "nation").join(v.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    asked = v.table(spark, sf, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    read = asked.join(cat.read_prompt_templates(spark, path), F.col("r_name") == F.col("name"))
    return read.select("c_custkey", "name", "system", F.replace("user", F.lit("{case}"), F.col("c_custkey").cast("string")).alias("user"))


@query(
    "S11_read_scenarios",
    "SELECT c_custkey, 'N_' || n_nationkey AS scenario_id, r_name AS layer, n_name AS name, 'Trouble in ' || n_name AS description, 'high' AS severity, 'load' AS metric, "
    "'additive' AS kind, CAST(n_nationkey AS DOUBLE) AS lo, CAST(n_nationkey + 1 AS DOUBLE) AS hi FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def read_scenarios(spark, sf):
    """Scenarios with descriptions and effects on metrics from a JSON configuration, given to the customers of their nation."""
    path = scratch_path(spark, "scenarios")
    number = F.col("n_nationkey").cast("double")
    effect = F.struct(F.array(number, number + 1).alias("additive"), F.lit("step").alias("pattern"))
    scenario = F.struct(
        F.concat(F.lit("N_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.concat(F.lit("Trouble in "), F.col("n_name")).alias("description"), F.lit("high").alias("severity"), F.create_map(F.lit("load"), effect).alias("affected_metrics"),
    )
    layered = v.table(spark, sf, "nation").join(v.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    layered = layered.groupBy("r_name").agg(F.struct(F.collect_list(scenario).alias("scenarios")).alias("body"))
    write_json_document(layered, F.struct(F.map_from_entries(F.collect_list(F.struct("r_name", "body"))).alias("layers")), path)
    hit = v.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("N_"), F.col("c_nationkey").cast("string")).alias("scenario_id"))
    found = hit.join(cat.read_scenarios(spark, path)[1], "scenario_id")
    return found.select("c_custkey", "scenario_id", "layer", "name", "description", "severity", F.explode("affected").alias("metric", "e")).select(
        "c_custkey", "scenario_id", "layer", "name", "description", "severity", "metric", "e.kind", "e.lo", "e.hi"
    )


@query(
    "S11_scenario_effects",
    W("catalogue", "SELECT count(*) AS users, true AS described, true AS affected FROM (SELECT DISTINCT user_id FROM events)"),
)
def scenario_effects(spark, sf):
    """Every user gets a built-in scenario that has a description and effects."""
    ids = F.array(*[F.lit(i) for i in v.SCENARIO_IDS])
    users = v.table(spark, sf, "events").select("user_id").distinct().withColumn("scenario_id", F.get(ids, (F.abs("user_id") % len(v.SCENARIO_IDS)).cast("int")))
    known = users.join(cat.scenarios(spark), "scenario_id")
    return known.agg(F.count("*").alias("users"), F.every(F.length("description") > 0).alias("described"), F.every(F.size("affected") > 0).alias("affected"))


def resource_rows(spark, sf):
    events = v.table(spark, sf, "events")
    return events.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("event_type").alias("msname"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("msinstanceid"),
        F.concat(F.lit("n"), (F.col("user_id") % 7).cast("string")).alias("nodeid"), F.col("value").alias("a"), (F.col("value") / 2).alias("b"),
    )


_NODES = "SELECT 'n' || (user_id % 7) AS nodeid, event_type AS msname, value AS a FROM events"


@query("S13_node_table", f"SELECT nodeid, count(*) AS points, round(max(a), 6) AS cpu FROM ({_NODES}) GROUP BY 1")
def node_table(spark, sf):
    path = scratch_path(spark, "nodes")
    resource_rows(spark, sf).select("timestamp", "nodeid", "a", "b").toDF("timestamp", "nodeid", "cpu_utilization", "memory_utilization").write.csv(path, header=True)
    return tc.read_trace_table(spark, "Node", path).groupBy("nodeid").agg(F.count("*").alias("points"), r6(F.max("cpu_utilization")).alias("cpu"))


@query("S13_service_resources", f"SELECT msname, nodeid, count(*) AS points, round(max(a) / 2, 6) AS memory FROM ({_NODES}) GROUP BY 1, 2")
def service_resources(spark, sf):
    path = scratch_path(spark, "resources")
    rows = resource_rows(spark, sf).select("timestamp", "msname", "msinstanceid", "nodeid", "a", "b")
    rows.toDF("timestamp", "msname", "msinstanceid", "nodeid", "cpu_utilization", "memory_utilization").write.csv(path, header=True)
    read = tc.read_trace_table(spark, "MSResource", path)
    return read.groupBy("msname", "nodeid").agg(F.count("*").alias("points"), r6(F.max("memory_utilization")).alias("memory"))


@query("S13_response_times", f"SELECT msname, count(*) AS points, round(max(a), 6) AS rt FROM ({_NODES}) GROUP BY 1")
def response_times(spark, sf):
    path = scratch_path(spark, "response-times")
    rows = resource_rows(spark, sf).select("timestamp", "msname", "msinstanceid", "nodeid", "a", "b", "a", "b")
    rows.toDF("timestamp", "msname", "msinstanceid", "nodeid", "providerrpc_rt", "providerrpc_mcr", "consumerrpc_rt", "consumerrpc_mcr").write.csv(path, header=True)
    read = tc.read_trace_table(spark, "MSRTMCR", path)
    return read.groupBy("msname").agg(F.count("*").alias("points"), r6(F.max("providerrpc_rt")).alias("rt"))


@query("S13_call_graph", W("calls", "SELECT um, dm, count(*) AS calls, round(sum(rt), 6) AS rt FROM calls GROUP BY 1, 2"))
def call_graph(spark, sf):
    path = scratch_path(spark, "calls")
    edges = v.calls(spark, sf).select(
        "timestamp", "traceid", F.lit("svc").alias("service"), F.lit("0.1").alias("rpc_id"), "um", F.concat("um", F.lit("-0")).alias("uminstanceid"),
        F.lit("rpc").alias("rpctype"), F.lit("").alias("interface"), "dm", "dminstanceid", "rt",
    )
    edges.write.csv(path, header=True)
    read = tc.read_trace_table(spark, "MSCallGraph", path)
    return read.groupBy("um", "dm").agg(F.count("*").alias("calls"), r6(F.sum("rt")).alias("rt"))


# Sinks: what was written is read back ------------------------------------------------------------


@query("K1_write_parsed", W("parsed bgl_lines", "SELECT 'bgl' AS dataset, count(*) AS n FROM bgl_lines UNION ALL SELECT 'hdfs', count(*) FROM parsed WHERE parsed_ok"))
def write_parsed(spark, sf):
    path = scratch_path(spark, "k1")
    cols = ["line_no", "level", "component", "content"]
    hdfs = v.parsed(spark, sf).where("parsed_ok").select(F.lit("hdfs").alias("dataset"), *cols)
    bgl = ps.route(ps.parse_lines(v.bgl_lines(spark, sf), "bgl"))[0].select(F.lit("bgl").alias("dataset"), *cols)
    sk.write_parsed(hdfs.unionByName(bgl), path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n"))


@query("K2_write_templates", W("records", "SELECT event_id AS cluster_id, component AS template, count(*) AS count FROM records GROUP BY 1, 2"))
def write_templates(spark, sf):
    path = scratch_path(spark, "k2")
    sk.write_templates(tq.component_catalogue(v.records(spark, sf)).withColumnRenamed("event_id", "cluster_id"), path)
    return lg.read_templates(spark, path)


@query("K3_write_features", W("records session_labels", "SELECT session_id, " + ", ".join(f"count(*) FILTER (event_id = {i}) AS E{i}" for i in range(1, 6)) + ", any_value(label) AS label FROM records JOIN session_labels USING (session_id) GROUP BY 1"))
def write_features(spark, sf):
    path = scratch_path(spark, "k3")
    wide = ss.count_matrix(v.records(spark, sf), [1, 2, 3, 4, 5])
    sk.write_features(ss.align_labels(wide, v.session_labels(spark, sf).select("session_id", "label")), path)
    return spark.read.parquet(path)


@query("K4_write_detector_results", W("predictions", "SELECT 'rule ' || model_no AS method, round(2 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)), 6) AS f1_score FROM predictions GROUP BY 1"))
def write_detector_results(spark, sf):
    from faultline.operators.evaluate import binary_metrics

    path = scratch_path(spark, "k4")
    scores = binary_metrics(v.predictions(spark, sf), ["model_no"])
    sk.write_detector_results(scores.select(F.concat(F.lit("rule "), F.col("model_no").cast("string")).alias("method"), r6("f1").alias("f1_score")), path)
    return spark.read.schema("method string, f1_score double").csv(path, header=True)


@query("K5_write_samples", W("manifest", "SELECT layer, count(*) AS rows, count(anomaly_start_idx) AS starts FROM manifest GROUP BY 1"))
def write_samples(spark, sf):
    path = scratch_path(spark, "k5")
    docs = v.manifest(spark, sf).select("sample_id", "layer", "anomaly_start_idx")
    sk.write_samples(manifest_rows(spark, sf), docs, path)
    rows = sm.read_manifest(spark, f"{path}/metadata").select("sample_id", "layer")
    read = sm.read_label_documents(spark, f"{path}/labels", per_line=True).select("sample_id", "anomaly_start_idx")
    return rows.join(read, "sample_id").groupBy("layer").agg(F.count("*").alias("rows"), F.count("anomaly_start_idx").alias("starts"))


@query("K6_write_incidents", W("records", "SELECT count(*) AS incidents FROM (SELECT DISTINCT session_id FROM records WHERE level = 'ERROR')"))
def write_incidents(spark, sf):
    from faultline.operators.fusion import fuse

    path = scratch_path(spark, "k6")
    sk.write_incidents(fuse(*tq.incident_frames(spark, sf)), path)
    back = spark.read.json(path)
    return back.where("multimodal_fusion.strategy IS NOT NULL AND log_analysis.source = 'system_logs'").agg(F.count("*").alias("incidents"))
