import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultline.operators import models as md
from faultline.plans import models as mq
from faultline.plans import views as v
from faultline.session import materialize
from tests.oracle_check import TABLES, compare

FAST = ("P1_parse_hdfs", "A4_dataset_comparison", "A19_five_numbers", "F1_sessions_in_segments", "F4_tfidf", "F5_padded_sequences",
        "J8_time_alignment", "R6_answer_json", "R7_parse_documents", "R11_fused_incidents", "S1_numbered_lines", "S8_metric_series",
        "X14_classification_report", "X16_roc_auc", "P18_display_name", "D1_word_variants", "W11_error_evidence", "F11_feature_cells", "S2_dataset_lines", "S11_read_scenarios",
        "S12_read_prompts", "S13_node_table")
JVM_ONLY = ("P1_parse_hdfs", "F1_sessions", "F3_count_matrix", "F4_tfidf", "F5_padded_sequences", "J8_time_alignment", "R1_session_text",
            "R6_answer_json", "D3_match_catalogue", "X16_roc_curve")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


def test_entry(spark):
    assert entry.entry(spark).columns == ["level", "n"]


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, con, small, name):
    assert compare(spark, con, name, small)[2] == "ok"


@pytest.mark.parametrize("name", JVM_ONLY)
def test_plans_stay_in_the_jvm_without_cross_joins(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in plan


@pytest.mark.parametrize("name", ("F5_padded_sequences", "R1_session_text", "W3_first_per_class"))
def test_heads_are_limited_before_the_shuffle(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_reads_only_needed_columns(spark, small):
    plan = entry.queries()["F3_event_counts"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_split_is_stratified_repeatable_and_disjoint(spark, small):
    vec = v.vectors(spark, small)
    one = md.stratified_split(vec, "label", "id").select("id", "label", "is_test").collect()
    two = md.stratified_split(vec.repartition(5), "label", "id").select("id", "label", "is_test").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    for c in {r.label for r in one}:
        rows = [r.is_test for r in one if r.label == c]
        assert sum(rows) == int(len(rows) * 0.2 + 0.5)


def test_classifiers_learn(spark, small):
    """The table's labels are unrelated to its vectors, so the target here is the sign of one dimension."""
    vec = v.vectors(spark, small).withColumn("label", (F.col("features")[0] > 0).cast("int"))
    split = md.stratified_split(vec, "label", "id")
    frame = materialize(split.select("id", "label", "is_test", md.to_vector("features").alias("features")))
    models = {"rf": md.random_forest(20, 6), "lr": md.logistic_regression(rows=400), "gbt": md.gradient_boosting(5, 3)}
    held = md.evaluate_each(models, frame, "id")
    got = {r.model: r.accuracy for r in mq.ev.binary_metrics(held, ["model"]).collect()}
    assert set(got) == {"rf", "lr", "gbt"} and min(got.values()) > 0.7


def test_multiclass_booster_is_of_full_size(spark, monkeypatch):
    """One booster per class, each with the rounds and depth of the two-class one."""
    class Frame:
        where = select = lambda self, *_: self

    monkeypatch.setattr(mq, "sample_frame", lambda spark, sf: Frame())
    monkeypatch.setattr(mq, "fit_and_report", lambda frame, estimator, binary: estimator)
    booster = mq.boosting_multiclass(None, None).getClassifier()
    assert (booster.getMaxIter(), booster.getMaxDepth()) == (100, 5) == (md.gradient_boosting().getMaxIter(), md.gradient_boosting().getMaxDepth())
