import json
import math

import pytest
from pyspark.sql import functions as F

from faultline.functions.numbers import steady_avg
from faultline.operators import answers as an
from faultline.operators import evaluate as ev
from faultline.operators import features as ft
from faultline.operators import fusion as fu
from faultline.operators import prompts as pr
from faultline.operators import series as sr
from faultline.operators import sessions as ss
from faultline.sources import catalogue as cat
from faultline.sources import samples as sm

ANSWERS = [
    ('```json\n{"classification": "ANOMALY", "confidence": 0.9}\n```', "json", "ANOMALY", 0.9),
    ('ok\n```\n{"classification": "normal"}\n```', "json", "normal", None),
    ('The answer is {"classification": "NORMAL"} indeed', "json", "NORMAL", None),
    ("```json\n{broken\n``` classification: ANOMALY", "text", "ANOMALY", None),
    ("I classify it as NORMAL, not ANOMALY", "text", "NORMAL", None),
    ("Classification - anomaly rather than normal", "text", "ANOMALY", None),
    ("an abnormal ANOMALY", "text", "ANOMALY", None),
    ("all normal. Confidence level of 0.85", "text", "NORMAL", 0.85),
    ("Root Cause:  disk full \nmore", "text", None, None),
    ("nothing here", "none", "UNKNOWN", None),
    ("", "none", "UNKNOWN", None),
    (None, "none", "UNKNOWN", None),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "id int, raw string")
    got = {r.id: r for r in an.parse_answers(df).drop("document").collect()}
    for i, (_, source, word, conf) in enumerate(ANSWERS):
        assert (got[i].source, got[i].classification, got[i].confidence) == (source, word, conf), i
    assert got[8].root_cause == "disk full"
    verdicts = {r.id: r.p for r in an.parse_answers(df).select("id", an.verdict().alias("p")).collect()}
    assert [verdicts[i] for i in range(12)] == [1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0]


@pytest.fixture(scope="module")
def records(spark):
    rows = [("s1", i, "INFO" if i != 3 else "ERROR", f"c{i % 2}", "m" * (250 if i == 2 else 5), i % 3) for i in range(1, 61)]
    rows += [("s2", 100, "WARN", "c9", "{braces} {{kept}}", 7), (None, 101, "INFO", "c", "x", 1)]
    return spark.createDataFrame(rows, "session_id string, line_no long, level string, component string, content string, event_id int")


def test_session_text(records):
    text = {r.session_id: r.session_text for r in pr.session_text(records).collect()}
    lines = text["s1"].split("\n")
    assert lines[:4] == ["[SESSION_START] Block: s1", "Total events: 60, Showing: 50", "---", "[E001] [INFO ] [c1] mmmmm"]
    assert lines[4].endswith("m" * 200 + "...") and lines[-1] == "[SESSION_END] Total: 60 events" and len(lines) == 55
    assert set(text) == {"s1", "s2"}


def test_braces_of_values_survive(spark, records):
    texts = pr.session_text(records)
    user = {r.session_id: r.prompt.user for r in pr.classification_prompts(texts, cat.prompt_templates(spark)).collect()}
    assert "{braces} {{kept}}" in user["s2"] and '{"classification"' in user["s2"]
    raw = pr.classification_prompts(texts, cat.prompt_templates(spark), unescape_braces=False).where("session_id = 's2'").first().prompt.user
    assert '{{"classification"' in raw


def test_sequences_and_matrix(records):
    seq = {r.session_id: r.sequence for r in ss.padded_sequences(records).collect()}
    assert len(seq["s1"]) == 50 and seq["s2"] == [7] + [-1] * 49
    wide = {r.session_id: r for r in ss.count_matrix(records, [0, 1, 99]).collect()}
    assert (wide["s1"].E0, wide["s1"].E1, wide["s1"].E99, wide["s2"].E1) == (20, 20, 0, 0)
    lists = ss.event_lists(records, ["session_id"], segment=25).where("session_id = 's1'").orderBy("segment").collect()
    assert [len(r.events) for r in lists] == [25, 25, 10]
    assert [e for r in lists for e in r.events] == [i % 3 for i in range(1, 61)]


def test_bad_window_times_are_dropped(spark):
    df = spark.createDataFrame([("2024-01-01 00:07:00", 1, 1), ("nonsense", 2, 2)], "event_ts string, event_id int, line_no long")
    assert [(r.window_id, r.events) for r in ss.window_lists(df).collect()] == [("2024-01-01 00:05:00", [1])]


def test_error_evidence(records):
    r = pr.error_evidence(records).where("session_id = 's1'").first()
    assert r.first_pos == 3 and r.first_error == "mmmmm" and r.propagation == ["c1", "c0"]


def test_late_error_is_evidence(spark):
    rows = [("s", i, "ERROR" if i == 61 else "INFO", "disk" if i > 70 else "net", f"m{i}") for i in range(1, 90)] + [("calm", 1, "INFO", "x", "y")]
    df = spark.createDataFrame(rows, "session_id string, line_no long, level string, component string, content string")
    assert [tuple(r) for r in pr.error_evidence(df).collect()] == [("s", 61, "m61", ["net", "disk"])]


def test_auc_agrees_with_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = [(i % 3 == 0, ((i * 37) % 11) / 10 + (0.3 if i % 3 == 0 else 0)) for i in range(300)]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in rows], "label int, score double")
    want = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ev.roc_auc(df).first().auc == pytest.approx(want, abs=1e-6)


def test_empty_and_one_sided_predictions(spark):
    empty = spark.createDataFrame([], "label int, prediction int, score double")
    assert ev.binary_metrics(empty).first().asDict() == {"tp": 0, "fp": 0, "fn": 0, "tn": 0, "precision": 0, "recall": 0, "f1": 0, "accuracy": 0}
    assert ev.confusion(empty, [0, 1]).agg(F.sum("n")).first()[0] == 0
    never = spark.createDataFrame([(1, 0), (0, 0), (2, 2)], "label int, prediction int")
    report = {r["class"]: r for r in ev.classification_report(never).collect()}
    assert report["1"].precision == 0 and report["1"].support == 1 and report["accuracy"].f1 == pytest.approx(2 / 3)


def test_best_model_is_strict(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.2)], "model string, score double")
    assert ev.best_model(df).first().model == "a"
    assert ev.best_model(df, 0.5).count() == 0


def test_alignment_of_the_documented_pair(spark):
    e = spark.createDataFrame([("i", "2026-01-01 14:23:15")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    m = spark.createDataFrame([("i", "2026-01-01 14:23:00"), ("i", "2026-01-01 14:24:00")], "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    r = fu.align_in_time(e, m, "k").first()
    assert r.delta_s == 15 and r.alignment == "strong"


def test_catalogue_values(spark):
    rows = cat.scenarios(spark).collect()
    assert len(rows) == 22 and cat.layers(spark).count() == 11 and cat.profiles(spark).count() == 38
    count = lambda f: {k: sum(getattr(r, f) == k for r in rows) for k in {getattr(r, f) for r in rows}}
    assert count("severity") == {"high": 13, "critical": 6, "medium": 3}
    assert count("root_cause_category") == {"network": 6, "resource": 6, "software": 5, "hardware": 3, "config": 2}


def test_scenario_file_and_unknown_ids(spark, tmp_path):
    doc = {"layers": {"web": {"name": "Web", "metrics": ["m"], "scenarios": [
        {"id": "W1", "name": "Slow", "severity": "high", "root_cause": "x", "remediation": ["r1", "r2"], "detection_params": ["m"],
         "affected_metrics": {"m": {"additive": [1, 2], "pattern": "oscillation"}}}]}}}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(doc))
    _, scen = cat.read_scenarios(spark, str(path))
    assert scen.first().affected["m"].kind == "additive"
    ids = spark.createDataFrame([("W1",), ("nope",)], "scenario_id string")
    got = {r.scenario_id: (r.info_name, r.actions) for r in cat.remediation_for(ids, scen).collect()}
    assert got == {"W1": ("Slow", ["r1", "r2"]), "nope": ("?", [])}


def test_prompt_file(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"anomaly_classification": {"system": "S", "user": "U {session_text}"}}))
    assert [tuple(r) for r in cat.read_prompt_templates(spark, str(path)).collect()] == [("anomaly_classification", "S", "U {session_text}")]


def test_sample_files(spark, tmp_path):
    for d in ("m", "l", "d"):
        (tmp_path / d).mkdir()
    (tmp_path / "m" / "a.csv").write_text("timestamp,cpu,mem\n2026-01-01 00:00:00,1.5,2\n2026-01-01 00:01:00,3,\n")
    (tmp_path / "m" / "b.csv").write_text("timestamp,iops\n2026-01-01 00:00:00,7\n")
    got = {(r.sample_id, r.idx, r.metric): r.value for r in sm.read_metric_series(spark, str(tmp_path / "m")).collect()}
    assert got == {("a", 0, "cpu"): 1.5, ("a", 0, "mem"): 2.0, ("a", 1, "cpu"): 3.0, ("a", 1, "mem"): None, ("b", 0, "iops"): 7.0}
    (tmp_path / "l" / "a.txt").write_text("x\ny\n")
    assert [(r.sample_id, r.line_no) for r in sm.read_sample_logs(spark, str(tmp_path / "l")).orderBy("line_no").collect()] == [("a", 1), ("a", 2)]
    (tmp_path / "d" / "a.json").write_text('{\n "sample_id": "a",\n "anomaly_start_idx": null\n}')
    (tmp_path / "d" / "b.json").write_text('{"sample_id": "b"}')
    (tmp_path / "d" / "c.json").write_text('{"sample_id": "c", "anomaly_start_idx": 12}')
    got = {r.sample_id: r.anomaly_start_idx for r in sm.read_label_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {"a": None, "b": 30, "c": 12}


def prompts_of(spark, n):
    return spark.range(n).select(F.col("id").alias("session_id"), F.struct(F.lit("s").alias("system"), F.concat(F.lit("u"), "id").alias("user")).alias("prompt"))


def test_failing_prompts_keep_their_rows(spark):
    from faultline.operators import prompts as pr

    def scorer(system, user):
        if user == "u3":
            raise ValueError("no")
        return {"error": "429 quota"} if user == "u4" else user + "!"

    got = {r.session_id: (r.raw, r.error, r["attempts"]) for r in pr.ask(prompts_of(spark, 20), scorer, attempts=3, wait=0, longest_wait=0).collect()}
    assert len(got) == 20 and got[0] == ("u0!", None, 1)
    assert got[3] == (None, "ValueError: no", 3) and got[4][0] is None and "429" in got[4][1]


def test_a_passing_failure_is_tried_again_after_growing_waits(spark):
    import time

    from faultline.operators import prompts as pr

    calls = []

    def scorer(system, user):
        calls.append(time.monotonic())
        if len(calls) < 4:
            raise OSError("busy")
        return "waited %.2f %.2f %.2f" % tuple(b - a for a, b in zip(calls, calls[1:], strict=False))

    row = pr.ask(prompts_of(spark, 1), scorer, wait=0.1, longest_wait=0.2).first()
    waits = [float(w) for w in row.raw.split()[1:]]
    assert row["attempts"] == 4 and row.error is None and waits[0] >= 0.1 and waits[1] >= 0.2 and 0.2 <= waits[2] < 0.4


def test_calls_are_paced_within_a_task(spark):
    import time

    from faultline.operators import prompts as pr

    rows = pr.ask(prompts_of(spark, 4).coalesce(1), lambda s, u: repr(time.monotonic()), per_minute=600).collect()
    at = sorted(float(r.raw) for r in rows)
    assert all(b - a >= 0.099 for a, b in zip(at, at[1:], strict=False))


def test_answers_already_written_are_not_asked_again(spark, tmp_path):
    from faultline.operators import prompts as pr

    def broken(system, user):
        if int(user[1:]) % 4 == 0:
            raise RuntimeError("down")
        return "first"

    first = pr.ask_into(prompts_of(spark, 12), broken, str(tmp_path / "answers"), rounds=3, attempts=1)
    assert first.where("error IS NULL").count() == 9
    again = {r.session_id: r.raw for r in pr.ask_into(prompts_of(spark, 14), lambda s, u: "second", str(tmp_path / "answers"), rounds=3).collect()}
    assert again == {i: "second" if i % 4 == 0 or i > 11 else "first" for i in range(14)}
    kept = pr.ask(prompts_of(spark, 14), lambda s, u: "third", answered=first)
    assert sorted(r.raw for r in kept.collect()) == ["first"] * 9 + ["third"] * 5


def test_observations_after_a_mean_of_zero(spark):
    """As in SQL, x / 0.0 is infinite and 0.0 / 0.0 is NaN, which is above every limit."""
    rows = [("1", "m", 0, 0.0, 1), ("1", "m", 1, 3.0, 1), ("2", "m", 0, 0.0, 1), ("2", "m", 1, 0.0, 1), ("3", "m", 0, 2.0, 1), ("3", "m", 1, 2.0, 1), ("4", "m", 0, 0.0, 1)]
    points = spark.createDataFrame(rows, "sample_id string, metric string, idx int, value double, start_idx int")
    told = {r.sample_id: (r.ratio, r.finding) for r in sr.observations(ft.before_after(points)).collect()}
    assert told["1"] == (float("inf"), "spike") and math.isnan(told["2"][0]) and told["2"][1] == "spike"
    assert told["3"] == (1.0, "normal") and told["4"] == (None, "no window")


def test_averages_do_not_depend_on_the_order_of_rows(spark):
    """0.1 ten times after 1e6, or before it, and shares that a plain sum gets wrong in the last digit."""
    values = [1e6 + 0.01, *[0.1] * 500, 1e-9, -3.3]
    exact = math.fsum(values) / len(values)
    for order in (values, values[::-1]):
        rows = spark.createDataFrame([(x,) for x in [*order, None]], "x double").coalesce(1)
        assert rows.agg(steady_avg(F.col("x"))).first()[0] == exact
    odd = spark.createDataFrame([("a", float("inf")), ("a", 1.0), ("b", float("nan")), ("c", None), ("d", 1e300), ("d", 3e300)], "k string, x double")
    told = {r.k: r.v for r in odd.groupBy("k").agg(steady_avg(F.col("x")).alias("v")).collect()}
    assert told["a"] == float("inf") and math.isnan(told["b"]) and told["c"] is None and told["d"] == 2e300
