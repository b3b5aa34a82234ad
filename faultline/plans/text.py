"""Session texts, prompts, answers, verdicts and fused incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import answers as an
from faultline.operators import evaluate as ev
from faultline.operators import features as ft
from faultline.operators import fusion as fu
from faultline.operators import prompts as pr
from faultline.operators import series as sr
from faultline.operators import sessions as ss
from faultline.plans import features as fq
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.sources import catalogue as cat
from faultline.sources.values import PROMPTS

W = v.with_views
r6 = lambda c: F.round(c, 6)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _session_sql(source: str, n: int = 50) -> str:
    """(session_id, n_events, session_text) of a records-like view."""
    return (
        f"SELECT session_id, any_value(t) AS n_events, '[SESSION_START] Block: ' || session_id || chr(10) || 'Total events: ' || any_value(t) || ', Showing: ' || least(any_value(t), {n}) "
        "|| chr(10) || '---' || chr(10) || string_agg(printf('[E%03d] [%-5s] [%s] %s', r, level, component, CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END), chr(10) ORDER BY r) "
        "|| chr(10) || '---' || chr(10) || '[SESSION_END] Total: ' || any_value(t) || ' events' AS session_text FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r, count(*) OVER (PARTITION BY session_id) AS t FROM {source}) WHERE r <= {n} GROUP BY session_id"
    )


def _user_sql(kind: str, slots: dict[str, str]) -> str:
    text = _quote(PROMPTS[kind][1].replace("{{", "{").replace("}}", "}"))
    for name, value in slots.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


@query("R1_session_text", W("records", _session_sql("records")))
def session_text(spark, sf):
    return pr.session_text(v.records(spark, sf))


@query("R1_conversation_text", W("turns", _session_sql("turns")))
def conversation_text(spark, sf):
    return pr.session_text(v.turns(spark, sf))


@query(
    "R2_classification_prompt",
    W("records", f"WITH s AS ({_session_sql('records')}) SELECT session_id, {_quote(PROMPTS['anomaly_classification'][0])} AS system, {_user_sql('anomaly_classification', {'session_text': 'session_text'})} AS user FROM s"),
)
def classification_prompt(spark, sf):
    out = pr.classification_prompts(pr.session_text(v.records(spark, sf)), cat.prompt_templates(spark))
    return out.select("session_id", "prompt.system", "prompt.user")


_COMPONENTS = "cc AS (SELECT event_id, component AS template, count(*) AS count FROM records GROUP BY 1, 2)"
_INFO = "ti AS (SELECT session_id, string_agg(event_id || ' ' || count || ' ' || template, chr(10) ORDER BY event_id) AS template_info FROM (SELECT DISTINCT session_id, event_id FROM records) JOIN cc USING (event_id) GROUP BY 1)"


def component_catalogue(records):
    return records.groupBy("event_id", F.col("component").alias("template")).agg(F.count("*").alias("count"))


@query("J2_template_info", W("records", f"WITH {_COMPONENTS}, {_INFO} SELECT session_id, template_info FROM ti"))
def template_info(spark, sf):
    rec = v.records(spark, sf)
    return pr.template_info(rec, component_catalogue(rec))


@query(
    "R3_root_cause_prompt",
    W("records", f"WITH s AS ({_session_sql('records')}), {_COMPONENTS}, {_INFO} SELECT session_id, {_user_sql('root_cause_analysis', {'session_text': 'session_text', 'template_info': 'template_info'})} AS user FROM s JOIN ti USING (session_id)"),
)
def root_cause_prompt(spark, sf):
    rec = v.records(spark, sf)
    out = pr.root_cause_prompts(pr.session_text(rec), pr.template_info(rec, component_catalogue(rec)), cat.prompt_templates(spark))
    return out.select("session_id", "prompt.user")


@query(
    "R3_prompt_without_templates",
    W("turns", f"WITH s AS ({_session_sql('turns')}) SELECT session_id, {_user_sql('root_cause_analysis', {'session_text': 'session_text', 'template_info': _quote('Not available')})} AS user FROM s"),
)
def prompt_without_templates(spark, sf):
    out = pr.root_cause_prompts(pr.session_text(v.turns(spark, sf)), None, cat.prompt_templates(spark))
    return out.select("session_id", "prompt.user")


_PAIRS = "p AS (SELECT length(session_id) AS width, min(CASE WHEN label = 0 THEN session_id END) AS normal_id, min(CASE WHEN label = 1 THEN session_id END) AS anomaly_id FROM session_labels GROUP BY 1)"


@query(
    "R4_comparative_prompt",
    W("records session_labels", f"WITH s AS ({_session_sql('records')}), {_PAIRS} SELECT anomaly_id AS session_id, {_user_sql('comparative_analysis', {'normal_session': 'n.session_text', 'anomaly_session': 'a.session_text'})} AS user "
      "FROM p JOIN s n ON n.session_id = normal_id JOIN s a ON a.session_id = anomaly_id"),
)
def comparative_prompt(spark, sf):
    labels = v.session_labels(spark, sf).withColumn("width", F.length("session_id"))
    pairs = ss.pair_sessions(labels, "width").drop("width")
    return pr.comparative_prompts(pairs, pr.session_text(v.records(spark, sf)), cat.prompt_templates(spark)).select("session_id", "prompt.user")


@query("R5_prompt_metadata", W("records", "SELECT session_id, count(*) AS n_events, 'anomaly_classification' AS prompt_type, '2024-02-01T00:00:00' AS timestamp FROM records GROUP BY 1"))
def prompt_metadata(spark, sf):
    out = pr.classification_prompts(pr.session_text(v.records(spark, sf)), cat.prompt_templates(spark), timestamp="2024-02-01T00:00:00")
    meta = F.col("prompt.metadata")
    return out.select("session_id", meta["n_events"].alias("n_events"), meta["prompt_type"].alias("prompt_type"), meta["timestamp"].alias("timestamp"))


@query("S12_prompt_sizes", W("turns", f"WITH s AS ({_session_sql('turns')}) SELECT t.name, count(*) AS sessions, CAST(sum(length(session_text) + t.chars) AS BIGINT) AS chars FROM s, "
       "(VALUES " + ", ".join(f"('{k}', {len(u)})" for k, (_, u) in PROMPTS.items()) + ") t(name, chars) GROUP BY 1"))
def prompt_sizes(spark, sf):
    texts = pr.session_text(v.turns(spark, sf)).agg(F.count("*").alias("sessions"), F.sum(F.length("session_text")).alias("len"))
    sizes = cat.prompt_templates(spark).select("name", F.length("user").alias("chars"))
    n, total = texts.select("sessions").scalar(), texts.select("len").scalar()
    return sizes.select("name", n.alias("sessions"), (total + n * F.col("chars")).alias("chars"))


# The three places of JSON in order, then prose.
_CAND = (
    "c AS (SELECT *, trim(raw, ' ' || chr(10)) AS t FROM answers), "
    "d AS (SELECT *, CASE WHEN contains(t, '```json') THEN trim(string_split(string_split(t, '```json')[2], '```')[1], ' ' || chr(10)) END AS c1, "
    "CASE WHEN contains(t, '```') THEN trim(string_split(t, '```')[2], ' ' || chr(10)) END AS c2, "
    "CASE WHEN contains(t, '{') AND contains(t, '}') THEN substring(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) END AS c3 FROM c), "
    "j AS (SELECT *, coalesce(TRY_CAST(c1 AS JSON), TRY_CAST(c2 AS JSON), TRY_CAST(c3 AS JSON)) AS doc, upper(t) AS u, "
    "greatest(instr(upper(t), 'CLASSIFY'), instr(upper(t), 'CLASSIFICATION')) AS cue FROM d), "
    "k AS (SELECT *, instr(u[greatest(cue, 1):], 'ANOMALY') AS aa, instr(u[greatest(cue, 1):], 'NORMAL') AS nn FROM j), "
    "m AS (SELECT *, CASE WHEN contains(u, 'ANOMALY') AND contains(u, 'NORMAL') THEN CASE WHEN cue = 0 THEN 'ANOMALY' WHEN aa > 0 AND (nn = 0 OR aa < nn) THEN 'ANOMALY' ELSE 'NORMAL' END "
    "WHEN contains(u, 'ANOMALY') THEN 'ANOMALY' WHEN contains(u, 'NORMAL') THEN 'NORMAL' END AS word, "
    r"TRY_CAST(nullif(regexp_extract(lower(t), 'confidence[:\s]+(?:level\s+)?(?:of\s+)?(?:\()?(0\.\d+)', 1), '') AS DOUBLE) AS conf, "
    r"trim(nullif(regexp_extract(t, '(?i)root\s*cause[:\s]+(.+?)(?:\n|$)', 1), '')) AS cause FROM k), "
    "a AS (SELECT session_id, label, CASE WHEN doc IS NOT NULL THEN 'json' WHEN coalesce(word, CAST(conf AS VARCHAR), cause) IS NOT NULL THEN 'text' ELSE 'none' END AS source, "
    "CASE WHEN doc IS NOT NULL THEN json_extract_string(doc, '$.classification') WHEN coalesce(word, CAST(conf AS VARCHAR), cause) IS NOT NULL THEN word ELSE 'UNKNOWN' END AS classification, "
    "CASE WHEN doc IS NOT NULL THEN CAST(json_extract_string(doc, '$.confidence') AS DOUBLE) ELSE conf END AS confidence, "
    "CASE WHEN doc IS NOT NULL THEN json_extract_string(doc, '$.root_cause') ELSE cause END AS root_cause, "
    "CASE WHEN doc IS NOT NULL THEN json_extract_string(doc, '$.reasoning') WHEN coalesce(word, CAST(conf AS VARCHAR), cause) IS NOT NULL THEN t[1:500] END AS reasoning FROM m)"
)


@query("R6_answer_json", W("answers", f"WITH {_CAND} SELECT session_id, source, classification, confidence, root_cause, reasoning FROM a WHERE source = 'json'"))
def answer_json(spark, sf):
    return an.parse_answers(v.answers(spark, sf).select("session_id", "raw")).where("source = 'json'").drop("document", "raw")


@query("R7_answer_prose", W("answers", f"WITH {_CAND} SELECT session_id, source, classification, confidence, root_cause, reasoning FROM a WHERE source <> 'json'"))
def answer_prose(spark, sf):
    return an.parse_answers(v.answers(spark, sf).select("session_id", "raw")).where("source <> 'json'").drop("document", "raw")


@query(
    "R7_parse_documents",
    f"WITH {_CAND.replace('FROM answers', 'FROM (SELECT doc_id AS session_id, text AS raw, 0 AS label FROM documents)')} SELECT session_id AS doc_id, source, classification, confidence, root_cause, reasoning FROM a",
)
def parse_documents(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    return an.parse_answers(docs).drop("document", "raw")


@query("R8_verdicts", W("answers", f"WITH {_CAND} SELECT label, CAST(coalesce(upper(classification) = 'ANOMALY', false) AS INTEGER) AS prediction, count(*) AS n FROM a GROUP BY 1, 2"))
def verdicts(spark, sf):
    out = an.parse_answers(v.answers(spark, sf)).select("label", an.verdict().alias("prediction"))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def rule_scorer(system: str, user: str) -> str:
    """A deterministic stand-in for a model: three or more error lines make an anomaly."""
    errors = user.count("[ERROR]")
    word = "ANOMALY" if errors >= 8 else "NORMAL"
    return '```json\n{"classification": "%s", "confidence": 0.%d}\n```' % (word, min(errors, 9))


_ASKED = "q AS (SELECT session_id, CASE WHEN (length(session_text) - length(replace(session_text, '[ERROR]', ''))) // 7 >= 8 THEN 'ANOMALY' ELSE 'NORMAL' END AS classification, (length(session_text) - length(replace(session_text, '[ERROR]', ''))) // 7 AS errors FROM s)"


@query("G1_scored_prompts", W("records", f"WITH s AS ({_session_sql('records')}), {_ASKED} SELECT session_id, classification, CAST('0.' || least(errors, 9) AS DOUBLE) AS confidence FROM q"))
def scored_prompts(spark, sf):
    asked = pr.ask(pr.classification_prompts(pr.session_text(v.records(spark, sf)), cat.prompt_templates(spark)), rule_scorer)
    return an.parse_answers(asked).select("session_id", "classification", "confidence")


def failing_scorer(system: str, user: str) -> str:
    """The same stand-in, which fails on every prompt with three error lines."""
    if user.count("[ERROR]") == 3:
        raise RuntimeError("three errors")
    return rule_scorer(system, user)


@query(
    "G1_failing_prompts",
    W("records", f"WITH s AS ({_session_sql('records')}), {_ASKED} SELECT session_id, CASE WHEN errors <> 3 THEN classification END AS classification, "
      "CASE WHEN errors = 3 THEN 'RuntimeError: three errors' END AS error, CASE WHEN errors = 3 THEN 4 ELSE 1 END AS attempts FROM q"),
)
def failing_prompts(spark, sf):
    """Answers of a scorer that fails on known prompts: their rows stay, with the error after four attempts."""
    asked = pr.ask(pr.classification_prompts(pr.session_text(v.records(spark, sf)), cat.prompt_templates(spark)), failing_scorer, attempts=4, wait=0)
    parsed = an.parse_answers(asked)
    return parsed.select("session_id", F.when(F.col("raw").isNotNull(), F.col("classification")).alias("classification"), "error", "attempts")


@query(
    "R10_batch_evaluation",
    W("records session_labels", f"WITH ch AS (SELECT session_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY line_no) AS r FROM session_labels) WHERE r <= 20), "
      f"rr AS (SELECT records.* FROM records JOIN ch USING (session_id)), s AS ({_session_sql('rr', 30)}), {_ASKED}, "
      "x AS (SELECT label, classification = 'ANOMALY' AS p FROM q JOIN ch USING (session_id)), c AS (SELECT count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND NOT p) AS tn FROM x) "
      "SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c"),
)
def batch_evaluation(spark, sf):
    labels = v.session_labels(spark, sf)
    chosen = ss.first_per_class(labels, 20, "line_no").select("session_id", "label")
    rows = ss.rows_of(v.records(spark, sf), chosen)
    asked = pr.ask(pr.classification_prompts(pr.session_text(rows, n=30), cat.prompt_templates(spark)), rule_scorer)
    scored = an.parse_answers(asked).select("session_id", an.verdict().alias("prediction")).join(chosen, "session_id")
    out = ev.binary_metrics(scored)
    return out.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "W11_error_evidence",
    W("records", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r FROM records), h AS (SELECT *, min(CASE WHEN level IN ('ERROR','FATAL','CRITICAL') THEN r END) OVER (PARTITION BY session_id) AS f FROM n), "
      "g AS (SELECT session_id, f, component, min(r) AS r0, max(CASE WHEN r = f THEN content END) AS txt FROM h WHERE r >= f GROUP BY 1, 2, 3) "
      "SELECT session_id, CAST(f AS INTEGER) AS first_pos, max(txt) AS first_error, string_agg(component, '>' ORDER BY r0) AS propagation FROM g GROUP BY 1, 2"),
)
def error_evidence(spark, sf):
    return pr.error_evidence(v.records(spark, sf)).withColumn("propagation", F.array_join("propagation", ">"))


def incident_frames(spark, sf):
    """Evidence of each user as one incident: log verdict, metric findings, first aligned pair, catalogue action."""
    rec = v.records(spark, sf)
    number = F.regexp_extract("session_id", r"(\d+)", 1)
    evidence = pr.error_evidence(rec).select(
        number.alias("incident_id"), F.lit("ANOMALY").alias("classification"),
        F.try_divide(F.lit(1.0), F.col("first_pos")).alias("confidence"), F.col("first_error").alias("root_cause"),
        F.col("first_error").alias("error_chain"), F.col("propagation").alias("affected_components"),
    )
    findings = sr.observations(fq.before_after_frame(spark, sf)).select(F.col("sample_id").alias("incident_id"), F.struct("metric", "finding").alias("o"))
    # One entry per metric of an incident: bounded by the metric catalogue.
    grouped = findings.groupBy("incident_id").agg(F.array_sort(F.collect_list("o")).alias("observations"))
    peak = ft.deviation(fq.profiled(spark, sf)).groupBy(F.col("sample_id").alias("incident_id")).agg(
        F.least(F.max(F.abs("z")) / 100, F.lit(1.0)).alias("score")
    )
    aligned = fu.align_in_time(fq.error_times(spark, sf), fq.metric_anomalies(spark, sf), "user_id")
    timing = aligned.groupBy(F.col("user_id").cast("string").alias("incident_id")).agg(
        F.min_by(F.struct("ts", "metric_ts", "delta_s"), F.struct(F.coalesce("delta_s", F.lit(1e12)), "event_id")).alias("t")
    )
    stamp = lambda c: F.date_format(c, "HH:mm:ss")
    timing = timing.select("incident_id", stamp("t.ts").alias("log_error_time"), stamp("t.metric_ts").alias("metric_anomaly_time"), "t.delta_s")
    ids = F.array(*[F.lit(i) for i in v.SCENARIO_IDS])
    action = evidence.select("incident_id", F.get(ids, (F.col("incident_id").cast("long") % len(v.SCENARIO_IDS)).cast("int")).alias("scenario_id"))
    action = cat.remediation_for(action, cat.scenarios(spark)).select("incident_id", F.col("info_severity").alias("severity"), "actions")
    return evidence, grouped.join(peak, "incident_id"), timing, action


_IDS_SQL = "[" + ", ".join(f"'{i}'" for i in v.SCENARIO_IDS) + "]"


@query(
    "R11_fused_incidents",
    W("records profiled catalogue", f"WITH {fq._ALIGN}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS r FROM records), fe AS (SELECT regexp_extract(session_id, '([0-9]+)', 1) AS incident_id, min(r) AS first_pos, arg_min(content, r) AS cause FROM n WHERE level IN ('ERROR','FATAL','CRITICAL') GROUP BY 1), "
      "pk AS (SELECT sample_id AS incident_id, least(max(abs(z)) / 100, 1.0) AS score FROM profiled GROUP BY 1), tm AS (SELECT CAST(user_id AS VARCHAR) AS incident_id, ts, metric_ts, delta_s FROM al QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY coalesce(delta_s, 1e12), event_id) = 1) "
      "SELECT incident_id, cause AS final_root_cause, round((1.0 / first_pos + score) / 2, 6) AS combined_confidence, strftime(ts, '%H:%M:%S') AS log_error_time, strftime(metric_ts, '%H:%M:%S') AS metric_anomaly_time, "
      "CASE WHEN delta_s IS NOT NULL THEN CASE WHEN delta_s <= 60 THEN 'strong' WHEN delta_s <= 300 THEN 'moderate' ELSE 'weak' END || ' (' || CAST(round(delta_s) AS BIGINT) || 's delta)' END AS temporal_alignment, upper(severity) AS severity, action1 || '|' || action2 AS remediation "
      f"FROM fe JOIN pk USING (incident_id) JOIN tm USING (incident_id) JOIN catalogue ON scenario_id = {_IDS_SQL}[CAST(incident_id AS BIGINT) % {len(v.SCENARIO_IDS)} + 1]"),
)
def fused_incidents(spark, sf):
    out = fu.fuse(*incident_frames(spark, sf)).select("incident_id", "multimodal_fusion.*")
    link = F.col("cross_modal_correlation")
    return out.select(
        "incident_id", "final_root_cause", r6("combined_confidence").alias("combined_confidence"), link["log_error_time"].alias("log_error_time"),
        link["metric_anomaly_time"].alias("metric_anomaly_time"), link["temporal_alignment"].alias("temporal_alignment"), "severity", F.array_join("remediation", "|").alias("remediation"),
    )
