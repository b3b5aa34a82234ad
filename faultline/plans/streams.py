"""Streaming jobs over the event table as a file stream; each gives the batch answer for closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import text as tx
from faultline.operators import parse as ps
from faultline.operators import profile as pf
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.session import scratch_path
from faultline.streaming import jobs
from faultline.streaming.templates import catalogue, mine_stream

W = v.with_views


def event_stream(spark, sf):
    schema = v.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def line_stream(spark, sf):
    """The rendered log lines as a stream."""
    return v.render_lines(v.render_events(event_stream(spark, sf)))


@query("Y1_stream_parse", W("parsed", "SELECT parsed_ok, level, count(*) AS n FROM parsed GROUP BY 1, 2"))
def stream_parse(spark, sf):
    out = jobs.run_to_table(jobs.parsed_stream(line_stream(spark, sf)), "y1")
    return out.groupBy("parsed_ok", "level").agg(F.count("*").alias("n"))


@query("Y1_stream_rejects", W("parsed", "SELECT line_no, value FROM parsed WHERE NOT parsed_ok"))
def stream_rejects(spark, sf):
    out = jobs.run_to_table(jobs.parsed_stream(line_stream(spark, sf)), "y1-rejects")
    return ps.route(out)[1].select("line_no", "value")


@query(
    "Y2_stream_window_counts",
    "SELECT strftime(time_bucket(INTERVAL 5 minutes, ts), '%Y-%m-%d %H:%M:%S') AS window_id, event_type, count(*) AS n FROM events "
    "WHERE time_bucket(INTERVAL 5 minutes, ts) + INTERVAL 5 minutes <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 10 minutes GROUP BY 1, 2",
)
def stream_window_counts(spark, sf):
    events = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.window_counts(events, event="event_type"), "y2")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_id"), "event_type", "n")


@query("Y3_stream_templates", "SELECT count(*) AS messages, count(DISTINCT event_type) AS clusters FROM events WHERE event_id % 97 <> 0")
def stream_templates(spark, sf):
    content = ps.parse_lines(line_stream(spark, sf), "hdfs").select("content")
    out = jobs.run_to_table(mine_stream(content), "y3")
    return out.agg(F.sum("n").alias("messages"), F.count_distinct("cluster_id").alias("clusters"))


@query("D4_change_types", "SELECT 'cluster_created' AS change_type, count(DISTINCT event_type) AS clusters FROM events WHERE event_id % 97 <> 0")
def change_types(spark, sf):
    """Every message of the log is one of five shapes, so each cluster is created once and never changes."""
    content = ps.parse_lines(line_stream(spark, sf), "hdfs").select("content")
    out = jobs.run_to_table(mine_stream(content), "d4")
    return out.where("change_type <> 'none'").groupBy("change_type").agg(F.count_distinct("cluster_id").alias("clusters"))


@query(
    "D4_word_changes",
    "SELECT change_type, count(DISTINCT event_type = 'click') AS clusters FROM events, (VALUES ('cluster_created'), ('cluster_template_changed')) AS c(change_type) GROUP BY 1",
)
def word_changes(spark, sf):
    """Messages whose variable parts are words: each cluster is created once and then changes its template."""
    out = jobs.run_to_table(mine_stream(v.worded(event_stream(spark, sf)).select("content")), "d4-words")
    return out.where("change_type <> 'none'").groupBy("change_type").agg(F.count_distinct("cluster_id").alias("clusters"))


@query(
    "Y3_state_catalogue",
    "SELECT CASE WHEN event_type = 'click' THEN 'host <*> is now reachable' ELSE 'user <*> left the <*> queue today' END AS template, count(*) AS count FROM events GROUP BY 1",
)
def state_catalogue(spark, sf):
    """The catalogue as the stream's state holds it, each leaf dealt to four state keys, merged on reading."""
    state = scratch_path(spark, "y3-kept-state")
    jobs.run_to_table(mine_stream(v.worded(event_stream(spark, sf)).select("content"), parts=4), "y3-parts", state=state)
    return catalogue(spark, state).select("template", "count")


@query(
    "Y4_stream_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 minutes THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), b AS (SELECT user_id, s, min(ts) AS a, max(ts) + INTERVAL 30 minutes AS z, count(*) AS n FROM s GROUP BY 1, 2) "
    "SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS burst_start, n FROM b WHERE z <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 10 minutes",
)
def stream_sessions(spark, sf):
    events = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = jobs.run_to_table(jobs.quiet_sessions(events, "user_id"), "y4")
    return out.select("user_id", F.date_format("burst_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("burst_start"), "n")


@query("A22_running_totals", W("records", "SELECT event_id, count(*) AS messages FROM records GROUP BY 1"))
def running_totals(spark, sf):
    """Totals as the stream has seen them: each micro-batch's state is the running count so far."""
    coded = v.render_events(event_stream(spark, sf)).select(F.col("etype").alias("event_id"))
    return jobs.run_totals(pf.running_totals(coded), "a22", ["event_id"])


@query("Y1_stream_block_ids", W("parsed", "SELECT block_id, count(*) AS n FROM parsed WHERE parsed_ok GROUP BY 1"))
def stream_block_ids(spark, sf):
    rows = jobs.parsed_stream(line_stream(spark, sf)).where("parsed_ok").select(tx.block_id(F.col("content")).alias("block_id"))
    return jobs.run_to_table(rows, "y1-blocks").groupBy("block_id").agg(F.count("*").alias("n"))
