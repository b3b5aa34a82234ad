"""The shapes the operators expect, derived from the event, document, vector and customer tables.

Every view exists twice: as a DataFrame function and as the SQL of the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.ordered import carry_last, time_bucket
from faultline.functions.text import block_id
from faultline.operators.parse import parse_lines
from faultline.operators.series import point_index
from faultline.sources import values

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
METRICS = {"click": "response_time_ms", "error": "latency_ms", "purchase": "disk_usage_pct", "signup": "cpu_usage_pct", "view": "page_views"}
SCENARIO_IDS = tuple(s[0] for s in values.SCENARIOS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return render_events(table(spark, sf, "events"))


WORDS = ("alpha", "beta", "gamma", "delta", "omega")


def worded(ev: DataFrame) -> DataFrame:
    """Two kinds of messages per event whose variable parts are words without digits."""
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.abs("user_id") % len(WORDS)).cast("int"))
    moved = F.concat(F.lit("user "), word, F.lit(" left the "), F.col("event_type"), F.lit(" queue today"))
    host = F.concat(F.lit("host "), word, F.lit(" is now reachable"))
    return ev.select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "click", host).otherwise(moved).alias("content"))


def render_events(ev: DataFrame) -> DataFrame:
    """Events with their log message, level, block and event number."""
    return ev.withColumns(
        {
            "k": F.regexp_extract("props", "([0-9]+)", 1),
            "v": F.col("value").cast("decimal(18,2)").cast("string"),
            "blk": F.concat(F.lit("blk_"), F.when(F.col("user_id") % 2 == 1, "-").otherwise(""), F.col("user_id").cast("string")),
            "lvl": F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO"),
            "etype": F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")).cast("int"),
        }
    ).withColumn(
        "msg",
        F.when(F.col("event_type") == "click", F.concat(F.lit("Served block "), "blk", F.lit(" in "), "v", F.lit(" ms")))
        .when(F.col("event_type") == "view", F.concat(F.lit("Served index page to /10.0.0."), "k"))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Receiving block "), "blk", F.lit(" src: /10.0.0."), "k", F.lit(" dest: /10.1.0."), "k"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("allocateBlock: /user/"), "k", F.lit(" "), "blk"))
        .otherwise(F.concat(F.lit("writeBlock "), "blk", F.lit(" received exception java.io.IOException code "), "k")),
    )


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return render_lines(_ev(spark, sf))


def render_lines(ev: DataFrame) -> DataFrame:
    """Events as log lines; every 97th line is malformed so that rejects exist."""
    good = F.concat_ws(" ", F.date_format("ts", "yyMMdd HHmmss"), F.col("user_id").cast("string"), "lvl",
                       F.concat(F.lit("svc."), "event_type", F.lit(":")), "msg")
    return ev.select(
        F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 97 == 0, F.concat(F.lit("--- "), "msg")).otherwise(good).alias("value"),
    )


def bgl_lines(spark: SparkSession, sf: str) -> DataFrame:
    ev = _ev(spark, sf)
    node = F.concat(F.lit("R"), (F.col("user_id") % 64).cast("string"))
    return ev.select(
        F.col("event_id").alias("line_no"),
        F.concat_ws(
            " ", F.when(F.col("event_type") == "error", "KERNDTLB").otherwise("-"),
            (F.lit(1704067200) + F.col("event_id")).cast("string"), F.date_format("ts", "yyyy.MM.dd"), node,
            F.date_format("ts", "yyyy-MM-dd-HH.mm.ss"), node, F.lit("RAS"), F.upper("event_type"), "lvl", "msg",
        ).alias("value"),
    )


def openstack_lines(spark: SparkSession, sf: str) -> DataFrame:
    ev = _ev(spark, sf)
    return ev.select(
        F.col("event_id").alias("line_no"),
        F.concat_ws(
            " ", F.concat(F.lit("nova-"), "event_type", F.lit(".log")), F.date_format("ts", "yyyy-MM-dd"),
            F.date_format("ts", "HH:mm:ss.SSS"), F.col("user_id").cast("string"), "lvl", F.concat(F.lit("nova."), "event_type"),
            F.concat(F.lit("[req-"), "k", F.lit(" - -]")), "msg",
        ).alias("value"),
    )


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_lines(log_lines(spark, sf), "hdfs").withColumn("block_id", block_id(F.col("content")))


def records(spark: SparkSession, sf: str) -> DataFrame:
    ev = _ev(spark, sf)
    return ev.select(
        F.col("blk").alias("session_id"), F.col("etype").alias("event_id"), F.col("event_id").alias("line_no"),
        F.col("ts").alias("event_ts"), F.col("lvl").alias("level"), F.concat(F.lit("svc."), "event_type").alias("component"),
        F.col("msg").alias("content"),
    )


def session_labels(spark: SparkSession, sf: str) -> DataFrame:
    rec = records(spark, sf)
    per = rec.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("e"), F.min("line_no").alias("line_no"))
    total = per.agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    n, e = total.select("n").scalar(), total.select("e").scalar()
    return per.select("session_id", (F.col("e") * n > e * F.col("n")).cast("int").alias("label"), "line_no")


def metric_points(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])
    pts = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("sample_id"), names[F.col("event_type")].alias("metric"), "ts", "value"
    )
    return point_index(pts, ["sample_id", "metric"], "ts", time_bucket("ts"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is called by the user's previous one; the first event of a user has no caller."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    linked = carry_last(ev, ["user_id"], ["ts", "event_id"], time_bucket("ts"), F.col("event_type"), "um", before=True)
    return linked.where("um IS NOT NULL").select(
        "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("user_id").cast("string").alias("traceid"),
        "um", F.col("event_type").alias("dm"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("dminstanceid"),
        F.col("value").alias("rt"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.col("role").alias("level"),
        F.lit("chat").alias("component"), F.col("text").alias("content"),
    )


def answers(spark: SparkSession, sf: str) -> DataFrame:
    ev = _ev(spark, sf)
    kind = F.col("event_id") % 8
    k = F.col("k")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    raw = (
        F.when(kind == 0, text('```json\n{"classification": "ANOMALY", "confidence": 0.', k, ', "root_cause": "disk ', k, '"}\n```'))
        .when(kind == 1, text('Result:\n```\n{"classification": "normal"}\n``` for ', k))
        .when(kind == 2, text('I think {"classification": "NORMAL", "reasoning": "', k, ' ok"} is right'))
        .when(kind == 3, text("{broken ", k, "} classification: ANOMALY with confidence level of 0.85"))
        .when(kind == 4, text("To classify this: NORMAL rather than ANOMALY. Confidence: 0.", k))
        .when(kind == 5, text("Root Cause: block ", k, " lost \nIt is abnormal, an anomaly"))
        .when(kind == 6, text("nothing ", k, " to see"))
        .otherwise("")
    )
    return ev.select(F.col("event_id").alias("session_id"), raw.alias("raw"), (F.col("event_type") == "error").cast("int").alias("label"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    wide = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    bad = F.col("c_acctbal") < 2500
    ids = F.array(*[F.lit(i) for i in SCENARIO_IDS])
    scenario = F.coalesce(F.get(ids, F.col("n_nationkey")), F.concat(F.lit("UNK_"), F.col("n_nationkey").cast("string")))
    sev = F.when(F.col("c_acctbal") < 500, "critical").when(F.col("c_acctbal") < 1500, "high").otherwise("medium")
    pick = lambda x: F.when(bad, x).otherwise("")
    return wide.select(
        F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("sample_id"),
        F.lower("c_mktsegment").alias("layer"), F.col("c_mktsegment").alias("layer_name"), bad.cast("int").alias("is_anomaly"),
        pick(scenario).alias("scenario_id"), pick(F.col("n_name")).alias("scenario_name"),
        pick(F.lower("r_name")).alias("root_cause_category"), pick(sev).alias("severity"),
        F.when(bad, (F.col("c_custkey") % 70).cast("int")).alias("anomaly_start_idx"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled order predictions with tied scores: late orders against a price rule."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") > 250000).cast("int").alias("prediction"),
        F.round(F.col("o_totalprice") / 1000, 0).alias("score"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("model_no"),
    )


_CAT_ROWS = ", ".join(
    "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in (i, la, n, rc, cat, sev, rem[0], rem[1])) + ")"
    for i, la, n, rc, cat, sev, _t, _d, rem in values.SCENARIOS
)
_PROFILE_ROWS = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for m, (a, b, c, d) in values.PROFILES.items())
_METRIC_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRICS.items()) + " END"
_DETECT_ROWS = ", ".join(f"('{s[0]}', '{m}')" for s in values.SCENARIOS for m in s[7])
HDFS_RE = r"^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([^:]+):\s+(.*)$"

SQL = {
    "ev": """SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v,
        'blk_' || CASE WHEN user_id % 2 = 1 THEN '-' ELSE '' END || CAST(user_id AS VARCHAR) AS blk,
        CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS lvl,
        list_position(['click','error','purchase','signup','view'], event_type) AS etype FROM events""",
    "evm": """SELECT *, CASE event_type WHEN 'click' THEN 'Served block ' || blk || ' in ' || v || ' ms'
        WHEN 'view' THEN 'Served index page to /10.0.0.' || k
        WHEN 'purchase' THEN 'Receiving block ' || blk || ' src: /10.0.0.' || k || ' dest: /10.1.0.' || k
        WHEN 'signup' THEN 'allocateBlock: /user/' || k || ' ' || blk
        ELSE 'writeBlock ' || blk || ' received exception java.io.IOException code ' || k END AS msg FROM ev""",
    "log_lines": """SELECT event_id AS line_no, CASE WHEN event_id % 97 = 0 THEN '--- ' || msg
        ELSE strftime(ts, '%y%m%d %H%M%S') || ' ' || user_id || ' ' || lvl || ' svc.' || event_type || ': ' || msg END AS value FROM evm""",
    "bgl_lines": """SELECT event_id AS line_no, CASE WHEN event_type = 'error' THEN 'KERNDTLB' ELSE '-' END || ' ' || (1704067200 + event_id)
        || ' ' || strftime(ts, '%Y.%m.%d') || ' R' || (user_id % 64) || ' ' || strftime(ts, '%Y-%m-%d-%H.%M.%S') || ' R' || (user_id % 64)
        || ' RAS ' || upper(event_type) || ' ' || lvl || ' ' || msg AS value FROM evm""",
    "openstack_lines": """SELECT event_id AS line_no, 'nova-' || event_type || '.log ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || user_id
        || ' ' || lvl || ' nova.' || event_type || ' [req-' || k || ' - -] ' || msg AS value FROM evm""",
    "parsed": f"""SELECT line_no, value, regexp_matches(value, '{HDFS_RE}') AS parsed_ok,
        nullif(regexp_extract(value, '{HDFS_RE}', 1), '') AS date, nullif(regexp_extract(value, '{HDFS_RE}', 2), '') AS time,
        nullif(regexp_extract(value, '{HDFS_RE}', 3), '') AS pid, nullif(regexp_extract(value, '{HDFS_RE}', 4), '') AS level,
        nullif(regexp_extract(value, '{HDFS_RE}', 5), '') AS component, nullif(regexp_extract(value, '{HDFS_RE}', 6), '') AS content,
        nullif(regexp_extract(regexp_extract(value, '{HDFS_RE}', 6), '(blk_-?\\d+)', 1), '') AS block_id FROM log_lines""",
    "records": """SELECT blk AS session_id, etype AS event_id, event_id AS line_no, ts AS event_ts, lvl AS level,
        'svc.' || event_type AS component, msg AS content FROM evm""",
    "session_labels": """SELECT session_id, CAST(CASE WHEN e * (SELECT count(*) FROM records) > (SELECT count(*) FROM records WHERE level = 'ERROR') * n
        THEN 1 ELSE 0 END AS INTEGER) AS label, line_no FROM (SELECT session_id, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e,
        min(line_no) AS line_no FROM records GROUP BY 1)""",
    "metric_points": f"""SELECT CAST(user_id AS VARCHAR) AS sample_id, {_METRIC_CASE} AS metric, ts, value,
        CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1 AS INTEGER) AS idx FROM events""",
    "profiled": f"""SELECT m.*, coalesce(p.mean, 50) AS p_mean, coalesce(p.std, 10) AS p_std, coalesce(p.lo, 0) AS p_min, coalesce(p.hi, 100) AS p_max,
        (value - coalesce(p.mean, 50)) / coalesce(p.std, 10) AS z
        FROM metric_points m LEFT JOIN (VALUES {_PROFILE_ROWS}) p(metric, mean, std, lo, hi) USING (metric)""",
    "calls": """SELECT * FROM (SELECT event_id, epoch_ms(ts) AS timestamp, CAST(user_id AS VARCHAR) AS traceid,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS um, event_type AS dm,
        event_type || '-' || (user_id % 10) AS dminstanceid, value AS rt FROM events) WHERE um IS NOT NULL""",
    "vectors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings",
    "turns": "SELECT conv_id AS session_id, turn AS line_no, role AS level, 'chat' AS component, text AS content FROM conversations",
    "answers": """SELECT event_id AS session_id, CASE event_id % 8
        WHEN 0 THEN '```json' || chr(10) || '{"classification": "ANOMALY", "confidence": 0.' || k || ', "root_cause": "disk ' || k || '"}' || chr(10) || '```'
        WHEN 1 THEN 'Result:' || chr(10) || '```' || chr(10) || '{"classification": "normal"}' || chr(10) || '``` for ' || k
        WHEN 2 THEN 'I think {"classification": "NORMAL", "reasoning": "' || k || ' ok"} is right'
        WHEN 3 THEN '{broken ' || k || '} classification: ANOMALY with confidence level of 0.85'
        WHEN 4 THEN 'To classify this: NORMAL rather than ANOMALY. Confidence: 0.' || k
        WHEN 5 THEN 'Root Cause: block ' || k || ' lost ' || chr(10) || 'It is abnormal, an anomaly'
        WHEN 6 THEN 'nothing ' || k || ' to see' ELSE '' END AS raw, CAST(event_type = 'error' AS INTEGER) AS label FROM ev""",
    "catalogue": f"SELECT * FROM (VALUES {_CAT_ROWS}) t(scenario_id, layer, name, root_cause, category, severity, action1, action2)",
    "detection": f"SELECT * FROM (VALUES {_DETECT_ROWS}) t(scenario_id, metric)",
    "manifest": "SELECT 'S' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS sample_id, lower(c_mktsegment) AS layer, c_mktsegment AS layer_name, "
    "CAST(c_acctbal < 2500 AS INTEGER) AS is_anomaly, CASE WHEN c_acctbal < 2500 THEN coalesce(["
    + ", ".join(f"'{i}'" for i in SCENARIO_IDS)
    + "][n_nationkey + 1], 'UNK_' || n_nationkey) ELSE '' END AS scenario_id, CASE WHEN c_acctbal < 2500 THEN n_name ELSE '' END AS scenario_name, "
    "CASE WHEN c_acctbal < 2500 THEN lower(r_name) ELSE '' END AS root_cause_category, CASE WHEN c_acctbal >= 2500 THEN '' "
    "WHEN c_acctbal < 500 THEN 'critical' WHEN c_acctbal < 1500 THEN 'high' ELSE 'medium' END AS severity, "
    "CAST(CASE WHEN c_acctbal < 2500 THEN c_custkey % 70 END AS INTEGER) AS anomaly_start_idx "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "predictions": """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
        CAST(o_totalprice > 250000 AS INTEGER) AS prediction, round(o_totalprice / 1000, 0) AS score,
        CAST(o_orderpriority[1] AS INTEGER) AS model_no FROM orders""",
}
_NEEDS = {
    "evm": ["ev"], "log_lines": ["evm"], "bgl_lines": ["evm"], "openstack_lines": ["evm"], "parsed": ["log_lines"], "records": ["evm"],
    "session_labels": ["records"], "profiled": ["metric_points"], "answers": ["ev"],
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (blank-separated) and what they need as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({SQL[n]})" for n in order]
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + head[5:]
    return "WITH " + ", ".join(parts) + " " + head
