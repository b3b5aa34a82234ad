"""Sessions, features, metric series, time alignment and template mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.ordered import id_bucket
from faultline.operators import features as ft
from faultline.operators import fusion as fu
from faultline.operators import parse as ps
from faultline.operators import profile as pf
from faultline.operators import series as sr
from faultline.operators import sessions as ss
from faultline.operators import templates as tp
from faultline.operators import traces as tr
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.session import materialize
from faultline.sources import catalogue as cat
from faultline.sources.values import STOP_WORDS

W = v.with_views
r6 = lambda c: F.round(c, 6)
joined_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


def rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


# Sessions ---------------------------------------------------------------------------------------


@query("F1_sessions", W("records", f"SELECT session_id, (r - 1) // {ss.SEGMENT} AS segment, string_agg(event_id, ',' ORDER BY r) AS events FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r FROM records) GROUP BY 1, 2"))
def sessions(spark, sf):
    return ss.event_lists(v.records(spark, sf), ["session_id"]).withColumn("events", joined_text("events"))


@query(
    "F1_sessions_in_segments",
    W("records", "SELECT session_id, (r - 1) // 10 AS segment, string_agg(event_id, ',' ORDER BY r) AS events FROM "
      "(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r FROM records) GROUP BY 1, 2"),
)
def sessions_in_segments(spark, sf):
    rec = v.records(spark, sf)
    out = ss.event_lists(rec, ["session_id"], bucket=id_bucket("line_no", 1000), segment=10)
    return out.withColumn("events", joined_text("events"))


@query(
    "F2_window_sessions",
    W("records", f"SELECT window_id, (r - 1) // {ss.SEGMENT} AS segment, string_agg(event_id, ',' ORDER BY r) AS events FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY line_no) AS r FROM (SELECT *, strftime(time_bucket(INTERVAL 5 minutes, event_ts), '%Y-%m-%d %H:%M:%S') AS window_id FROM records)) GROUP BY 1, 2"),
)
def window_sessions(spark, sf):
    return ss.window_lists(v.records(spark, sf), 5).withColumn("events", joined_text("events"))


@query("F3_event_counts", W("records", "SELECT session_id, event_id, count(*) AS n FROM records GROUP BY 1, 2"))
def event_counts(spark, sf):
    return ss.count_events(v.records(spark, sf), ["session_id"])


@query("F3_count_matrix", W("records", "SELECT session_id, " + ", ".join(f"count(*) FILTER (event_id = {i}) AS E{i}" for i in (1, 2, 3, 4, 5, 9)) + " FROM records GROUP BY 1"))
def count_matrix(spark, sf):
    return ss.count_matrix(v.records(spark, sf), [1, 2, 3, 4, 5, 9])


@query("F3_window_counts", W("records", "SELECT strftime(time_bucket(INTERVAL 5 minutes, event_ts), '%Y-%m-%d %H:%M:%S') AS window_id, event_id, count(*) AS n FROM records GROUP BY 1, 2"))
def window_counts(spark, sf):
    return ss.count_events(ss.with_window(v.records(spark, sf)), ["window_id"])


@query(
    "F5_padded_sequences",
    W("records", "SELECT session_id, array_to_string((list(event_id ORDER BY line_no) || [-1 FOR i IN range(50)])[1:50], ',') AS sequence FROM records GROUP BY 1"),
)
def padded_sequences(spark, sf):
    return ss.padded_sequences(v.records(spark, sf)).withColumn("sequence", joined_text("sequence"))


@query("J1_align_labels", W("records session_labels", "SELECT session_id, event_id, n, label FROM (SELECT session_id, event_id, count(*) AS n FROM records GROUP BY 1, 2) JOIN session_labels USING (session_id)"))
def align_labels(spark, sf):
    counts = ss.count_events(v.records(spark, sf), ["session_id"])
    return ss.align_labels(counts, v.session_labels(spark, sf).select("session_id", "label"))


@query("J3_rows_of_sessions", W("records session_labels", "SELECT session_id, line_no, event_id FROM records WHERE session_id IN (SELECT session_id FROM session_labels WHERE label = 1)"))
def rows_of_sessions(spark, sf):
    chosen = v.session_labels(spark, sf).where("label = 1")
    return ss.rows_of(v.records(spark, sf).select("session_id", "line_no", "event_id"), chosen)


@query("W1_numbered_events", W("records", "SELECT session_id, line_no, printf('E%03d', row_number() OVER (PARTITION BY session_id ORDER BY line_no)) AS code FROM records"))
def numbered_events(spark, sf):
    return ss.numbered_events(v.records(spark, sf).select("session_id", "line_no"), "session_id").select("session_id", "line_no", "code")


@query(
    "W2_first_events",
    W("records", "SELECT session_id, line_no, CAST(r AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r FROM records) WHERE r <= 50"),
)
def first_events(spark, sf):
    return ss.first_events(v.records(spark, sf).select("session_id", "line_no"), "session_id", 50)


@query(
    "W3_first_per_class",
    W("session_labels", "SELECT session_id, label, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY line_no) AS r FROM session_labels) WHERE r <= 20"),
)
def first_per_class(spark, sf):
    return ss.first_per_class(v.session_labels(spark, sf), 20, "line_no").drop("line_no")


@query("W4_ids_by_first_appearance", W("records", "SELECT component, row_number() OVER (ORDER BY min(line_no)) AS event_id FROM records GROUP BY 1"))
def ids_by_first_appearance(spark, sf):
    first = v.records(spark, sf).groupBy("component").agg(F.min("line_no").alias("first_line"))
    return ss.ids_by_first_appearance(first).drop("first_line")


# Text and count features ------------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_TERMS = (
    r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), "
    rf"tc AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE regexp_full_match(term, '[a-z_][a-z0-9_]{{2,}}') AND term NOT IN ({_STOP}) GROUP BY 1, 2), "
    "voc AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY 1 ORDER BY cf DESC, term LIMIT 500)"
)


@query("F4_vocabulary", f"WITH {_TERMS} SELECT term, CAST(cf AS BIGINT) AS cf, df FROM voc")
def tfidf_vocabulary(spark, sf):
    return ft.top_terms(ft.term_counts(v.table(spark, sf, "documents"), "doc_id", "text"))


@query(
    "F4_tfidf",
    f"WITH {_TERMS}, w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tc JOIN voc USING (term)) "
    "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
)
def tfidf(spark, sf):
    return rounded(ft.tfidf(v.table(spark, sf, "documents"), "doc_id", "text", one_row=True), "weight")


@query(
    "F6_standardize",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, "
    "round((l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER (), 6) AS l_discount FROM lineitem",
)
def standardize(spark, sf):
    li = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(ft.standardize(li, ["l_quantity", "l_discount"]), "l_quantity", "l_discount")


@query(
    "F6_standardize_vectors",
    W("vectors", "WITH u AS (SELECT id, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM vectors) "
      "SELECT id, i - 1 AS dim, round((x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i), 6) AS x FROM u"),
)
def standardize_vectors(spark, sf):
    out = ft.standardize_array(v.vectors(spark, sf), ["id"], "features")
    return out.select("id", F.posexplode("features").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long")).withColumn("x", r6("x"))


@query(
    "F8_label_encoding",
    W("manifest", "SELECT sample_id, layer, CAST(i AS DOUBLE) AS layer_index, layer AS layer_index_label FROM manifest JOIN (SELECT layer, dense_rank() OVER (ORDER BY layer) - 1 AS i FROM (SELECT DISTINCT layer FROM manifest)) USING (layer)"),
)
def label_encoding(spark, sf):
    indexed, inverse = ft.encode_labels(v.manifest(spark, sf).select("sample_id", "layer"), "layer", "layer_index")
    return inverse.transform(indexed)


def profiled(spark, sf):
    return cat.with_profile(v.metric_points(spark, sf), cat.profiles(spark))


@query("J6_profiles", W("profiled", "SELECT sample_id, metric, idx, p_mean, p_std, p_min, p_max FROM profiled"))
def join_profiles(spark, sf):
    return profiled(spark, sf).select("sample_id", "metric", "idx", "p_mean", "p_std", "p_min", "p_max")


@query("S14_profiles", W("profiled", "SELECT metric, p_mean, p_std, p_min, p_max, count(*) AS points FROM profiled GROUP BY ALL"))
def profiles(spark, sf):
    return profiled(spark, sf).groupBy("metric", "p_mean", "p_std", "p_min", "p_max").agg(F.count("*").alias("points"))


@query(
    "F9_metric_features",
    W("profiled", "SELECT sample_id, metric, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, arg_max(value, idx) AS last, "
      "round(arg_max(value, idx) - arg_min(value, idx), 6) AS change, round(max(abs(z)), 6) AS max_abs_z, round(count(*) FILTER (abs(z) > 3) / count(*), 6) AS outside_share FROM profiled GROUP BY 1, 2"),
)
def metric_features(spark, sf):
    return rounded(ft.metric_features(profiled(spark, sf)), "mean", "std", "change", "max_abs_z", "outside_share")


def user_lines(spark, sf):
    rec = v.records(spark, sf).select(F.col("session_id").alias("sample_id"), "line_no", "level", "event_id")
    return ss.numbered_events(rec, "sample_id").select("sample_id", F.col("pos").alias("line_no"), "level", "event_id")


_SHARES = ", ".join(f"count(*) FILTER (level = '{w}') AS log_{w.lower()}, round(count(*) FILTER (level = '{w}') / count(*), 6) AS log_{w.lower()}_share" for w in ("INFO", "WARN", "ERROR", "CRITICAL"))


@query(
    "F10_log_features",
    W("records", "WITH n AS (SELECT session_id AS sample_id, level, event_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY session_id) AS t FROM records) "
      f"SELECT sample_id, count(*) AS log_lines, {_SHARES}, count(DISTINCT event_id) AS log_templates, "
      "round(count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL') AND r > t * 2 // 3) / count(*) FILTER (r > t * 2 // 3), 6) AS log_late_error_share FROM n GROUP BY 1"),
)
def log_features(spark, sf):
    out = ft.log_features(user_lines(spark, sf))
    return rounded(out, *[c for c in out.columns if c.endswith("share")])


_LOG_NAMES = ["log_lines", *[f"log_{w}{end}" for w in ("info", "warn", "error", "critical") for end in ("", "_share")], "log_templates", "log_late_error_share"]
_NUMBER = "regexp_extract(session_id, '([0-9]+)', 1)"


def sample_matrix(spark, sf):
    """(table (sample_id, features), feature names): metric features, log features and the whole term block of every sample; missing is 0.

    The features are one array: hundreds of columns would cost more to plan and to aggregate, without generated code, than to compute.
    """
    metric = ft.metric_features(profiled(spark, sf))
    wide = metric.groupBy("sample_id").pivot("metric", sorted(v.METRICS.values())).agg(F.first("mean").alias("mean"), F.first("max_abs_z").alias("peak"))
    wide = wide.withColumnsRenamed({c: f"metric_{c}" for c in wide.columns if c != "sample_id"})
    number = F.regexp_extract("sample_id", r"(\d+)", 1)
    logs = ft.log_features(user_lines(spark, sf)).withColumn("sample_id", number)
    contents = v.records(spark, sf).select(F.regexp_extract("session_id", r"(\d+)", 1).alias("sample_id"), "content")
    weights = materialize(ft.tfidf(contents, "sample_id", "content"), "term-weights")
    terms, vocabulary = ft.term_lists(weights, "sample_id")
    joined = wide.join(logs, "sample_id", "left")
    names = [c for c in joined.columns if c != "sample_id"]
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names])
    features = F.concat(numbers, ft.dense("terms", len(vocabulary)))
    table = joined.join(terms, "sample_id", "left").select("sample_id", features.alias("features"))
    return materialize(table, "matrix"), [*names, *[f"tfidf_{t}" for t in vocabulary]]


@query(
    "F11_feature_cells",
    W("profiled records", f"""WITH mt AS (SELECT sample_id, metric, avg(value) AS mean, max(abs(z)) AS peak FROM profiled GROUP BY 1, 2),
        n AS (SELECT {_NUMBER} AS sample_id, level, event_id, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY session_id) AS t FROM records),
        lg AS (SELECT sample_id, count(*) AS log_lines, {_SHARES.replace("round(", "(").replace(", 6)", ")")}, count(DISTINCT event_id) AS log_templates,
            count(*) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL') AND r > t * 2 // 3) / count(*) FILTER (r > t * 2 // 3) AS log_late_error_share FROM n GROUP BY 1),
        tok AS (SELECT {_NUMBER} AS sample_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM records),
        tc AS (SELECT sample_id, term, count(*) AS tf FROM tok WHERE regexp_full_match(term, '[a-z_][a-z0-9_]{{2,}}') AND term NOT IN ({_STOP}) GROUP BY 1, 2),
        voc AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY 1 ORDER BY cf DESC, term LIMIT 500),
        w AS (SELECT sample_id, term, tf * (ln((1 + (SELECT count(DISTINCT sample_id) FROM n)) / (1 + df)) + 1) AS w FROM tc JOIN voc USING (term)),
        cells AS (SELECT sample_id, 'metric_' || metric || '_mean' AS feature, mean AS value FROM mt UNION ALL SELECT sample_id, 'metric_' || metric || '_peak', peak FROM mt
            UNION ALL SELECT sample_id, unnest([{", ".join(f"'{c}'" for c in _LOG_NAMES)}]), unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in _LOG_NAMES)}]) FROM lg
            UNION ALL SELECT sample_id, 'tfidf_' || term, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) FROM w)
        SELECT sample_id, feature, round(value, 6) AS value FROM cells WHERE value <> 0 AND sample_id IN (SELECT sample_id FROM mt)"""),
)
def feature_cells(spark, sf):
    """The matrix in long form, cells that are not 0."""
    matrix, names = sample_matrix(spark, sf)
    cells = matrix.select("sample_id", F.posexplode("features").alias("i", "value")).where("value <> 0")
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return cells.select("sample_id", feature.alias("feature"), r6("value").alias("value"))


@query("F11_feature_matrix")
def feature_matrix(spark, sf):
    """Metric features, log features and term weights of each sample in one vector."""
    out, _ = sample_matrix(spark, sf)
    values = F.transform("features", lambda x: F.nanvl(x, F.lit(0.0)))
    return out.select("sample_id", F.size("features").alias("dims"), r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("F13_deviation", W("profiled", "SELECT sample_id, metric, idx, round(z, 6) AS z FROM profiled"))
def deviation(spark, sf):
    return ft.deviation(profiled(spark, sf)).select("sample_id", "metric", "idx", r6("z").alias("z"))


@query(
    "F13_detected_scenarios",
    W("profiled detection", "SELECT sample_id, scenario_id, count(*) FILTER (peak > 3) AS metrics_hit, count(*) AS metrics_seen, round(max(peak), 6) AS peak FROM "
      "(SELECT sample_id, metric, max(abs(z)) AS peak FROM profiled GROUP BY 1, 2) JOIN detection USING (metric) GROUP BY 1, 2"),
)
def detected_scenarios(spark, sf):
    return rounded(ft.flag_detected(profiled(spark, sf), cat.scenarios(spark)), "peak")


@query("F14_anomaly_start", W("profiled", "SELECT sample_id, min(idx) FILTER (abs(z) > 3) AS start_idx FROM profiled GROUP BY 1"))
def anomaly_start(spark, sf):
    return ft.anomaly_start(profiled(spark, sf))


_REGION = "WITH st AS (SELECT DISTINCT sample_id, CASE WHEN CAST(sample_id AS BIGINT) % 5 > 0 THEN CAST(sample_id AS BIGINT) % 30 END AS start_idx FROM metric_points) "


def starts(points):
    number = F.col("sample_id").cast("long")
    return points.select("sample_id").distinct().select("sample_id", F.when(number % 5 > 0, (number % 30).cast("int")).alias("anomaly_start_idx"))


_BEFORE_AFTER = (
    _REGION + ", s AS (SELECT sample_id, metric, avg(value) FILTER (start_idx IS NULL OR idx < start_idx) AS before, avg(value) FILTER (idx >= start_idx) AS after, "
    "count(*) FILTER (start_idx IS NULL OR idx < start_idx) AS n_before, count(*) FILTER (idx >= start_idx) AS n_after FROM metric_points JOIN st USING (sample_id) GROUP BY 1, 2) "
)


def before_after_frame(spark, sf):
    pts = v.metric_points(spark, sf)
    return ft.before_after(pts.join(starts(pts), "sample_id"), "anomaly_start_idx")


@query("F15_before_after", W("metric_points", _BEFORE_AFTER + "SELECT sample_id, metric, round(before, 6) AS before, round(after, 6) AS after, n_before, n_after, round(after / before, 6) AS ratio FROM s"))
def before_after(spark, sf):
    return rounded(before_after_frame(spark, sf), "before", "after", "ratio")


@query(
    "R12_observations",
    W("metric_points", _BEFORE_AFTER + "SELECT sample_id, metric, CASE WHEN before IS NULL OR after IS NULL THEN 'no window' WHEN after / before >= 1.5 THEN 'spike' WHEN after / before <= 0.67 THEN 'drop' ELSE 'normal' END AS finding FROM s"),
)
def observations(spark, sf):
    return sr.observations(before_after_frame(spark, sf)).select("sample_id", "metric", "finding")


@query(
    "P15_region_flag",
    W("metric_points", _REGION + "SELECT sample_id, metric, idx, coalesce(start_idx < n AND idx >= start_idx, false) AS in_region FROM metric_points JOIN st USING (sample_id) "
      "JOIN (SELECT sample_id, max(idx) + 1 AS n FROM metric_points GROUP BY 1) USING (sample_id)"),
)
def region_flag(spark, sf):
    pts = v.metric_points(spark, sf)
    return sr.mark_region(pts.select("sample_id", "metric", "idx"), starts(pts))


@query("P16_clip", W("profiled", "SELECT sample_id, metric, idx, round_even(least(greatest(value, p_min), p_max), 4) AS clipped FROM profiled"))
def clip(spark, sf):
    pts = profiled(spark, sf)
    return pts.select("sample_id", "metric", "idx", ps.clip_to_profile(F.col("value"), F.col("p_min"), F.col("p_max")).alias("clipped"))


_MM = "(SELECT sample_id, metric, min(value) AS lo, max(value) AS hi FROM metric_points GROUP BY 1, 2)"


@query("W5_min_max", W("metric_points", f"SELECT sample_id, metric, idx, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM metric_points JOIN {_MM} USING (sample_id, metric)"))
def min_max(spark, sf):
    return sr.normalize(v.metric_points(spark, sf).select("sample_id", "metric", "idx", "value")).select("sample_id", "metric", "idx", r6("scaled").alias("scaled"))


@query("W6_min_max_epsilon", W("metric_points", f"SELECT sample_id, metric, idx, round((value - lo) / (hi - lo + 1e-8), 6) AS scaled FROM metric_points JOIN {_MM} USING (sample_id, metric)"))
def min_max_epsilon(spark, sf):
    pts = v.metric_points(spark, sf).select("sample_id", "metric", "idx", "value")
    return sr.normalize(pts, 1e-8).select("sample_id", "metric", "idx", r6("scaled").alias("scaled"))


@query("W7_last_value", W("metric_points", "SELECT sample_id, metric, arg_max(value, idx) AS last FROM metric_points GROUP BY 1, 2"))
def last_value(spark, sf):
    return sr.last_value(v.metric_points(spark, sf))


@query("W8_point_index", W("metric_points", "SELECT sample_id, metric, idx, value FROM metric_points"))
def point_index(spark, sf):
    return v.metric_points(spark, sf).select("sample_id", "metric", "idx", "value")


@query(
    "W10_log_position",
    W("records metric_points", _REGION + "SELECT sample_id, start_idx AS anomaly_start_idx, n_lines, CAST(floor(start_idx * n_lines / 60) AS BIGINT) AS log_start FROM st JOIN "
      "(SELECT regexp_extract(session_id, '([0-9]+)', 1) AS sample_id, count(*) AS n_lines FROM records GROUP BY 1) USING (sample_id)"),
)
def log_position(spark, sf):
    pts = v.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sample_id"))
    return sr.log_position(starts(pts), pts)


@query(
    "A21_label_correlation",
    W("records session_labels", "WITH g AS (SELECT session_id, label, event_id FROM session_labels, (SELECT DISTINCT event_id FROM records)), "
      "c AS (SELECT session_id, event_id, count(*) AS n FROM records GROUP BY 1, 2) "
      "SELECT event_id, round(corr(coalesce(n, 0), label), 6) AS corr FROM g LEFT JOIN c USING (session_id, event_id) GROUP BY 1"),
)
def label_correlation(spark, sf):
    counts = ss.count_events(v.records(spark, sf), ["session_id"])
    return rounded(ft.label_correlation(counts, v.session_labels(spark, sf).select("session_id", "label")), "corr")


@query(
    "T2_top_and_bottom",
    W("records session_labels", "WITH g AS (SELECT session_id, label, event_id FROM session_labels, (SELECT DISTINCT event_id FROM records)), "
      "c AS (SELECT session_id, event_id, count(*) AS n FROM records GROUP BY 1, 2), "
      "k AS (SELECT event_id, corr(coalesce(n, 0), label) AS corr FROM g LEFT JOIN c USING (session_id, event_id) GROUP BY 1), "
      "r AS (SELECT event_id, corr, row_number() OVER (ORDER BY corr DESC, event_id) AS up, row_number() OVER (ORDER BY corr, event_id DESC) AS down FROM k) "
      "SELECT event_id, round(corr, 6) AS corr, 'top' AS side, CAST(up AS INTEGER) AS rank FROM r WHERE up <= 2 UNION ALL SELECT event_id, round(corr, 6), 'bottom', CAST(down AS INTEGER) FROM r WHERE down <= 2"),
)
def top_and_bottom(spark, sf):
    counts = ss.count_events(v.records(spark, sf), ["session_id"])
    corr = ft.label_correlation(counts, v.session_labels(spark, sf).select("session_id", "label"))
    return rounded(pf.top_and_bottom(corr, "corr", "event_id", 4), "corr")


@query("X1_contamination", W("session_labels", "SELECT round(least(greatest(sum(label) / count(*), 0.01), 0.5), 6) AS contamination FROM session_labels"))
def contamination(spark, sf):
    return rounded(ft.contamination(v.session_labels(spark, sf)), "contamination")


# Joins over time and across modalities ------------------------------------------------------------


def error_times(spark, sf):
    return v.table(spark, sf, "events").where("event_type = 'error'").select("user_id", "ts", "event_id")


def metric_anomalies(spark, sf):
    pts = ft.deviation(profiled(spark, sf)).where((F.abs("z") > 3) & (F.col("metric") != "latency_ms"))
    return pts.select(F.col("sample_id").cast("long").alias("user_id"), "ts")


_ALIGN = (
    "e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'), a AS (SELECT CAST(sample_id AS BIGINT) AS user_id, ts AS metric_ts FROM profiled WHERE abs(z) > 3 AND metric <> 'latency_ms'), "
    "al AS (SELECT e.user_id, e.ts, e.event_id, a.metric_ts, epoch_us(e.ts - a.metric_ts) / 1e6 AS delta_s FROM e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts >= a.metric_ts)"
)


@query(
    "J8_time_alignment",
    W("profiled", f"WITH {_ALIGN} SELECT event_id, round(delta_s, 6) AS delta_s, CASE WHEN delta_s IS NULL THEN 'none' WHEN delta_s <= 60 THEN 'strong' WHEN delta_s <= 300 THEN 'moderate' ELSE 'weak' END AS alignment FROM al"),
)
def time_alignment(spark, sf):
    out = fu.align_in_time(error_times(spark, sf), metric_anomalies(spark, sf), "user_id")
    return out.select("event_id", r6("delta_s").alias("delta_s"), "alignment")


@query(
    "J5_multimodal_join",
    W("manifest profiled records", "WITH mf AS (SELECT 'S' || lpad(sample_id, 9, '0') AS sample_id, max(abs(z)) AS peak, count(*) AS points FROM profiled GROUP BY 1), "
      "lf AS (SELECT 'S' || lpad(regexp_extract(session_id, '([0-9]+)', 1), 9, '0') AS sample_id, count(*) AS lines, count(*) FILTER (level = 'ERROR') AS errors FROM records GROUP BY 1) "
      "SELECT sample_id, layer, is_anomaly, lines, errors, points, round(peak, 6) AS peak FROM manifest JOIN lf USING (sample_id) JOIN mf USING (sample_id)"),
)
def multimodal_join(spark, sf):
    sample = lambda c: F.concat(F.lit("S"), F.lpad(c, 9, "0")).alias("sample_id")
    mf = ft.deviation(profiled(spark, sf)).groupBy(sample(F.col("sample_id"))).agg(F.max(F.abs("z")).alias("peak"), F.count("*").alias("points"))
    lf = v.records(spark, sf).groupBy(sample(F.regexp_extract("session_id", r"(\d+)", 1))).agg(F.count("*").alias("lines"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    m = v.manifest(spark, sf).select("sample_id", "layer", "is_anomaly")
    return rounded(m.join(lf, "sample_id").join(mf, "sample_id"), "peak")


@query(
    "J10_calls_with_resources",
    W("calls", "WITH l AS (SELECT dminstanceid AS msinstanceid, timestamp // 3600000 AS slot, count(*) AS calls, avg(rt) AS avg_rt, max(rt) AS max_rt FROM calls GROUP BY 1, 2), "
      "u AS (SELECT event_type || '-' || (user_id % 10) AS msinstanceid, epoch_ms(ts) // 3600000 AS slot, avg(value / 5) AS cpu, avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)) AS memory FROM events GROUP BY 1, 2) "
      "SELECT msinstanceid, slot, calls, round(avg_rt, 6) AS avg_rt, max_rt, round(cpu, 6) AS cpu, round(memory, 6) AS memory FROM l JOIN u USING (msinstanceid, slot)"),
)
def calls_with_resources(spark, sf):
    res = v.table(spark, sf, "events").select(
        F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("msinstanceid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), (F.col("value") / 5).alias("cpu_utilization"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("memory_utilization"),
    )
    return rounded(tr.calls_with_resources(v.calls(spark, sf), res, 3_600_000), "avg_rt", "cpu", "memory")


# Template mining --------------------------------------------------------------------------------

_TEMPLATE = (
    "CASE event_type WHEN 'click' THEN 'Served block <*> in <*> ms' WHEN 'view' THEN 'Served index page to <*>' WHEN 'purchase' THEN 'Receiving block <*> src: <*> dest: <*>' "
    "WHEN 'signup' THEN 'allocateBlock: <*> <*>' ELSE 'writeBlock <*> received exception java.io.IOException code <*>' END"
)
_MINED = (
    f"WITH t AS (SELECT {_TEMPLATE} AS template, count(*) AS count, min(event_id) AS first_line FROM evm WHERE event_id % 97 <> 0 GROUP BY 1), "
    "m AS (SELECT CAST(row_number() OVER (ORDER BY first_line) AS INTEGER) AS event_id, template, count, first_line FROM t) "
)


def contents(spark, sf):
    return v.parsed(spark, sf).select("line_no", "content", "block_id")


@query("D1_mined_templates", W("evm", _MINED + "SELECT event_id, template, count, first_line FROM m"))
def mined_templates(spark, sf):
    return tp.mine(contents(spark, sf)).catalogue


_WORD_VARIANTS = (
    "SELECT CASE WHEN event_type = 'click' THEN 'host <*> is now reachable' ELSE 'user <*> left the <*> queue today' END AS template, "
    "count(*) AS count, min(event_id) AS first_line FROM events GROUP BY 1"
)


@query(
    "D1_word_variants",
    _WORD_VARIANTS,
)
def word_variants(spark, sf):
    """Variable parts are words, so shapes differ and only the clustering step can merge them."""
    return tp.mine(v.worded(v.table(spark, sf, "events"))).catalogue.select("template", "count", "first_line")


@query("D1_split_leaves", _WORD_VARIANTS)
def split_leaves(spark, sf):
    """The same messages with leaves cut into units of similar shapes and into parts of at most 100, whose catalogues are merged."""
    return tp.mine(v.worded(v.table(spark, sf, "events")), most=100).catalogue.select("template", "count", "first_line")


@query("D1_mined_documents")
def mined_documents(spark, sf):
    """Mining free prose: every document is one message, most shapes are unique."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("content"))
    return tp.mine(docs).catalogue.select("event_id", "count", "first_line", F.length("template").alias("template_length"))


@query("D1_document_totals", "SELECT count(*) AS messages, min(doc_id) AS first_line FROM documents WHERE text IS NOT NULL")
def document_totals(spark, sf):
    """However prose is clustered, every message is counted once and the first one opens a template."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("content"))
    return tp.mine(docs).catalogue.agg(F.sum("count").alias("messages"), F.min("first_line").alias("first_line"))


@query("D2_assigned_events", W("evm", _MINED + f", e AS (SELECT event_id AS line_no, {_TEMPLATE} AS template FROM evm WHERE event_id % 97 <> 0) SELECT line_no, m.event_id FROM e JOIN m USING (template)"))
def assigned_events(spark, sf):
    rows = contents(spark, sf).where("content IS NOT NULL")
    return tp.assign(rows, tp.mine(rows)).select("line_no", "event_id")


@query("J7_event_templates", W("evm", f"SELECT event_id AS line_no, {_TEMPLATE} AS template FROM evm WHERE event_id % 97 <> 0"))
def event_templates(spark, sf):
    rows = contents(spark, sf).where("content IS NOT NULL")
    model = tp.mine(rows)
    return tp.with_template(tp.assign(rows, model), model.catalogue).select("line_no", "template")


@query("A7_template_summary", W("evm", _MINED + "SELECT CAST(sum(count) AS BIGINT) AS messages, count(*) AS templates, round(sum(count) / count(*), 6) AS messages_per_template FROM m"))
def template_summary(spark, sf):
    return rounded(pf.template_summary(tp.mine(contents(spark, sf)).catalogue), "messages_per_template")


@query("A8_template_catalogue", W("evm", _MINED + "SELECT event_id, template, count FROM m"))
def template_catalogue(spark, sf):
    rows = contents(spark, sf).where("content IS NOT NULL")
    model = tp.mine(rows)
    return tp.catalogue_of(tp.with_template(tp.assign(rows, model), model.catalogue))


_KNOWN = [
    (1, "Served block <*> in <*> ms"), (2, "Served index page to <*>"), (3, "Receiving block <*> src: <*> dest: <*>"),
    (4, "<*> <*> <*> <*> <*>"), (5, "writeBlock <*> received exception java.io.IOException code <*>"), (6, "<*> block <*> in <*> ms"),
]


@query("D3_match_catalogue", W("evm", "SELECT event_id AS line_no, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 5 END AS INTEGER) AS event_id FROM evm"))
def match_catalogue(spark, sf):
    known = spark.createDataFrame(_KNOWN, "event_id int, template string")
    rows = v.records(spark, sf).select("line_no", "content")
    return tp.match_catalogue(rows, known).select("line_no", "event_id")


@query(
    "D5_token_merge",
    W("evm", "WITH t AS (SELECT event_id AS line_no, string_split(msg, ' ') AS a, list_transform(string_split(msg, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS b FROM evm) "
      "SELECT line_no, array_to_string(b, ' ') AS merged, round(len(list_filter(b, lambda x: x <> '<*>')) / len(b), 6) AS sim FROM t"),
)
def token_merge(spark, sf):
    rows = v.records(spark, sf).select("line_no", tp.tokens(F.col("content")).alias("a")).withColumn("b", tp.masked(F.col("a")))
    return rows.select("line_no", F.array_join(tp.merge_tokens(F.col("a"), F.col("b")), " ").alias("merged"), r6(tp.similarity(F.col("b"), F.col("a"))).alias("sim"))
