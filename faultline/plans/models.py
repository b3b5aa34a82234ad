"""Detectors, classifiers and their evaluation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faultline.operators import evaluate as ev
from faultline.operators import features as ft
from faultline.operators import isolation as iso
from faultline.operators import models as md
from faultline.operators import neighbours as nb
from faultline.operators import sessions as ss
from faultline.plans import features as fp
from faultline.plans import views as v
from faultline.plans.registry import query
from faultline.session import materialize

W = v.with_views
r6 = lambda c: F.round(c, 6)
DIMS = 64


def rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


# Neighbours and detectors -------------------------------------------------------------------------

_NEAR = (
    "np AS (SELECT a.id AS id, b.id AS neighbour, list_distance(a.features, b.features) AS dist FROM vectors a JOIN vectors b ON a.id <> b.id), "
    "nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS rank FROM np)"
)


@query("J9_nearest_neighbours", W("vectors", f"WITH {_NEAR} SELECT id, neighbour, round(dist, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM nr WHERE rank <= 5"))
def nearest(spark, sf):
    return rounded(nb.nearest_neighbours(v.vectors(spark, sf), k=5), "dist")


@query("J9_approximate_recall")
def approximate_recall(spark, sf):
    """Five neighbours by narrow slabs, with the recall measured on a sample; what is missing is not made up for."""
    return rounded(nb.approximate_neighbours(v.vectors(spark, sf), k=5, width=0.5, tables=8, projections=3), "dist", "recall")


_LOF = (
    f"{_NEAR}, u AS (SELECT * FROM nr WHERE rank <= 20), kd AS (SELECT id, max(dist) AS kdist FROM u GROUP BY 1), "
    "lr AS (SELECT u.id, 1 / (avg(greatest(u.dist, kd.kdist)) + 1e-10) AS lrd FROM u JOIN kd ON kd.id = u.neighbour GROUP BY 1), "
    "lf AS (SELECT u.id, avg(n.lrd) / any_value(o.lrd) AS lof FROM u JOIN lr n ON n.id = u.neighbour JOIN lr o ON o.id = u.id GROUP BY 1)"
)


@query("X3_local_outlier_factor", W("vectors", f"WITH {_LOF} SELECT id, round(lof, 6) AS lof FROM lf"))
def local_outlier_factor(spark, sf):
    return rounded(nb.local_outlier_factor(v.vectors(spark, sf)), "lof")


@query("X3_lof_flags", W("vectors", f"WITH {_LOF}, q AS (SELECT quantile_cont(lof, 0.9) AS cut FROM lf) SELECT id, CAST(lof > cut AS INTEGER) AS prediction FROM lf, q"))
def lof_flags(spark, sf):
    return nb.flag_share(nb.local_outlier_factor(v.vectors(spark, sf)), 0.1, "lof").select("id", "prediction")


def session_vectors(spark, sf):
    """Standardised event counts of every session with its label; copies are frequent."""
    counts = ss.count_matrix(v.records(spark, sf), [1, 2, 3, 4, 5])
    labelled = ss.align_labels(counts, v.session_labels(spark, sf).select("session_id", "label"))
    scaled = ft.standardize(labelled, [f"E{i}" for i in range(1, 6)])
    number = F.abs(F.regexp_extract("session_id", r"(\d+)", 1).cast("long"))
    return materialize(scaled.select(number.alias("id"), F.array(*[f"E{i}" for i in range(1, 6)]).alias("features"), "label"), "sessions")


@query("X3_lof_on_sessions")
def lof_on_sessions(spark, sf):
    vec = session_vectors(spark, sf)
    share = ft.contamination(vec).first()[0]
    flagged = nb.flag_share(nb.local_outlier_factor(vec), share, "lof")
    return rounded(ev.binary_metrics(flagged.join(vec.select("id", "label"), "id")), "precision", "recall", "f1", "accuracy")


@query("X2_isolation_forest")
def isolation_forest(spark, sf):
    vec = v.vectors(spark, sf)
    flagged = nb.flag_share(iso.isolation_scores(vec), 0.1, "score")
    return rounded(flagged, "score")


@query("X2_forest_on_sessions")
def forest_on_sessions(spark, sf):
    vec = session_vectors(spark, sf)
    share = ft.contamination(vec).first()[0]
    flagged = nb.flag_share(iso.isolation_scores(vec), share, "score")
    return rounded(ev.binary_metrics(flagged.join(vec.select("id", "label"), "id")), "precision", "recall", "f1", "accuracy")


@query("X2_flagged_share", W("vectors", "SELECT count(*) AS rows, count(*) - CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) - 1 AS flagged FROM vectors"))
def flagged_share(spark, sf):
    flagged = nb.flag_share(iso.isolation_scores(v.vectors(spark, sf)), 0.1, "score")
    return flagged.agg(F.count("*").alias("rows"), F.sum("prediction").alias("flagged"))


@query(
    "X7_knn_classifier",
    W("vectors", f"WITH {_NEAR}, vt AS (SELECT nr.id, o.label, count(*) AS n FROM nr JOIN vectors o ON o.id = nr.neighbour WHERE rank <= 5 GROUP BY 1, 2) "
      "SELECT id, label AS prediction FROM vt QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1"),
)
def knn_classifier(spark, sf):
    return nb.knn_classify(v.vectors(spark, sf), None, 5)


# Splits and models --------------------------------------------------------------------------------


@query("X9_stratified_split", W("vectors", "SELECT label, t AS is_test, CASE WHEN t THEN CAST(floor(n * 0.2 + 0.5) AS BIGINT) ELSE n - CAST(floor(n * 0.2 + 0.5) AS BIGINT) END AS n FROM (SELECT label, count(*) AS n FROM vectors GROUP BY 1), (VALUES (true), (false)) x(t)"))
def stratified_split(spark, sf):
    return md.stratified_split(v.vectors(spark, sf), "label", "id").groupBy("label", "is_test").agg(F.count("*").alias("n"))


@query("X10_stratified_folds", W("vectors", "SELECT label, f AS fold, (n + 4 - f) // 5 AS n FROM (SELECT label, count(*) AS n FROM vectors GROUP BY 1), (VALUES (0), (1), (2), (3), (4)) x(f)"))
def stratified_folds(spark, sf):
    return md.stratified_folds(v.vectors(spark, sf), "label", "id").groupBy("label", "fold").agg(F.count("*").alias("n"))


def split_vectors(spark, sf, binary: bool = False):
    vec = v.vectors(spark, sf)
    if binary:
        vec = vec.withColumn("label", (F.col("label") >= 5).cast("int"))
    split = md.stratified_split(vec, "label", "id")
    return materialize(split.select("id", "label", "is_test", md.to_vector("features").alias("features")), "split")


def fit_and_report(frame, estimator, binary: bool):
    model = estimator.fit(frame.where("NOT is_test"))
    held = materialize(md.predict(model, frame.where("is_test"), ["id"]), "held")  # read several times
    if binary:
        return rounded(ev.binary_metrics(held), "precision", "recall", "f1", "accuracy")
    return rounded(ev.classification_report(held), "precision", "recall", "f1")


@query("X4_random_forest")
def random_forest(spark, sf):
    return fit_and_report(split_vectors(spark, sf, True), md.random_forest(), True)


@query("X4_random_forest_multiclass")
def random_forest_multiclass(spark, sf):
    return fit_and_report(split_vectors(spark, sf), md.random_forest(), False)


@query("X5_gradient_boosting")
def gradient_boosting(spark, sf):
    return fit_and_report(split_vectors(spark, sf, True), md.gradient_boosting(), True)


@query("X6_logistic_regression")
def logistic_regression(spark, sf):
    frame = split_vectors(spark, sf)
    return fit_and_report(frame, md.logistic_regression(rows=frame.count()), False)


@query("X8_perceptron")
def perceptron(spark, sf):
    return fit_and_report(split_vectors(spark, sf), md.perceptron(DIMS, 10), False)


@query("X10_cross_validation")
def cross_validation(spark, sf):
    vec = v.vectors(spark, sf).withColumn("label", (F.col("label") >= 5).cast("int"))
    folds = md.stratified_folds(vec, "label", "id").select("id", "label", "fold", md.to_vector("features").alias("features"))
    folds = materialize(folds, "folds")
    return rounded(md.fold_summary(md.cross_validate(md.logistic_regression(rows=folds.count()), folds, 5, "id")), "mean_f1", "std_f1")


_N_TEST = "CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT)"
_LABELLED = (
    "lb AS (SELECT regexp_extract(session_id, '([0-9]+)', 1) AS sample_id, CAST(count(*) FILTER (level = 'ERROR') / count(*) > 0.2 AS INTEGER) AS label FROM records GROUP BY 1), "
    "sm AS (SELECT * FROM lb WHERE sample_id IN (SELECT sample_id FROM profiled)), ts AS (SELECT label, "
    f"{_N_TEST} AS held, count(*) AS n FROM sm GROUP BY 1)"
)


def labelled_samples(spark, sf):
    """(table, feature names): the feature matrix with label 1 where errors are more than a fifth of a sample's lines."""
    matrix, names = fp.sample_matrix(spark, sf)
    error_share = F.get("features", F.lit(names.index("log_error_share")))
    labelled = matrix.withColumn("label", (error_share > 0.2).cast("int"))
    scaled = ft.standardize_array(labelled, ["sample_id", "label"], "features").where("sample_id IS NOT NULL")
    rows = ft.packed_vectors(scaled.withColumn("id", F.col("sample_id").cast("long")), "features", len(names))
    return materialize(md.stratified_split(rows, "label", "id").select("id", "label", "is_test", "features"), "labelled-samples"), names


def held_properties(held):
    """What must hold for any sound model: as many rows as the split holds out, known labels, and a better F1 than always saying the larger class."""
    held = materialize(held, "held")
    scores = ev.weighted_f1(held).first()[0]
    majority = held.groupBy("label").count().orderBy(F.desc("count"), "label").first().label
    floor = ev.weighted_f1(held.withColumn("prediction", F.lit(majority))).first()[0]
    return held.agg(F.count("*").alias("rows"), F.every(F.col("prediction").isin(0, 1)).alias("known_labels")).withColumn("beats_majority", F.lit(bool(scores > floor)))


_HELD = W("records profiled", f"WITH {_LABELLED} SELECT CAST(sum(held) AS BIGINT) AS rows, true AS known_labels, true AS beats_majority FROM ts")


def on_samples(spark, sf, make):
    frame, names = labelled_samples(spark, sf)
    fitted = make(len(names), frame).fit(frame.where("NOT is_test"))
    return held_properties(md.predict(fitted, frame.where("is_test"), ["id"]))


@query("X4_forest_on_samples", _HELD)
def forest_on_samples(spark, sf):
    return on_samples(spark, sf, lambda dims, frame: md.random_forest())


@query("X5_boosting_on_samples", _HELD)
def boosting_on_samples(spark, sf):
    return on_samples(spark, sf, lambda dims, frame: md.gradient_boosting())


@query("X6_regression_on_samples", _HELD)
def regression_on_samples(spark, sf):
    return on_samples(spark, sf, lambda dims, frame: md.logistic_regression(rows=frame.count()))


@query("X7_neighbours_on_samples", _HELD)
def neighbours_on_samples(spark, sf):
    frame, _ = labelled_samples(spark, sf)
    return held_properties(nearest_label(frame.where("is_test"), frame.where("NOT is_test")))


def nearest_label(held, train):
    """(id, label, prediction) by the five nearest training rows."""
    listed = lambda rows: rows.withColumn("features", vector_to_array("features"))
    found = nb.knn_classify(listed(held), listed(train), 5)
    return held.select("id", "label").join(found, "id")


@query("X8_perceptron_on_samples", _HELD)
def perceptron_on_samples(spark, sf):
    return on_samples(spark, sf, lambda dims, frame: md.perceptron(dims, 2))


@query("X5_boosting_multiclass")
def boosting_multiclass(spark, sf):
    """One booster per class on the severity of a sample."""
    frame = sample_frame(spark, sf).where("is_anomaly = 1").select(F.col("sample_id").alias("id"), F.col("severity_index").cast("int").alias("label"), "is_test", "features")
    return fit_and_report(frame, md.gradient_boosting(classes=3), False)


def five_models(dims, rows):
    """The models that are compared; the nearest-neighbour rule is a join and has its own path."""
    return md.detectors(dims, 2, rows)


@query("X10_five_models", W("records profiled", "SELECT m AS model, true AS better_than_chance, CAST(5 AS BIGINT) AS folds FROM (SELECT unnest(['gradient_boosting', 'k_nearest', 'logistic_regression', 'perceptron', 'random_forest']) AS m), (SELECT count(*) FROM records)"))
def five_model_validation(spark, sf):
    """Mean and deviation of F1 over five folds for all five models, stated as what must hold for them."""
    return model_scores(spark, sf).select("model", (F.col("mean_f1") > 0.5).alias("better_than_chance"), "folds")


def model_scores(spark, sf):
    frame, names = labelled_samples(spark, sf)
    folds = md.stratified_folds(frame.drop("is_test"), "label", "id")
    folds = materialize(folds, "folds")
    scores = None
    for name, estimator in five_models(len(names), folds.count()).items():
        one = md.cross_validate(estimator, folds, 5, "id").withColumn("model", F.lit(name))
        scores = one if scores is None else scores.unionByName(one)
    for f in range(5):
        held = nearest_label(folds.where(F.col("fold") == f), folds.where(F.col("fold") != f))
        one = ev.binary_metrics(held).select("f1", F.lit(f).alias("fold"), F.lit("k_nearest").alias("model"))
        scores = scores.unionByName(one)
    summary = scores.groupBy("model").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"), F.count("*").alias("folds"))
    return materialize(summary, "model-scores")


@query("G4_model_dictionary")
def model_dictionary(spark, sf):
    """Every model of the dictionary on the same split."""
    frame, names = labelled_samples(spark, sf)
    held = md.evaluate_each(five_models(len(names), frame.count()), frame, "id")
    return rounded(ev.binary_metrics(held, ["model"]), "precision", "recall", "f1", "accuracy")


TARGETS = ("layer", "root_cause_category", "severity", "scenario_id")


def sample_frame(spark, sf):
    """Samples of the manifest with the feature matrix of the user of the same number."""
    matrix, names = fp.sample_matrix(spark, sf)
    m = v.manifest(spark, sf)
    for target in TARGETS:
        m, _ = ft.encode_labels(m, target, f"{target}_index")
    wide = ft.packed_vectors(matrix, "features", len(names)).withColumnRenamed("sample_id", "number")
    joined = m.withColumn("number", F.expr("cast(cast(substring(sample_id, 2) as bigint) as string)")).join(wide, "number")
    return materialize(md.stratified_split(joined, "is_anomaly", "sample_id"), "samples")


@query("X11_four_targets")
def four_targets(spark, sf):
    """Accuracy and weighted F1 per target, with the whole matrix and full-size forests."""
    held = materialize(md.train_targets(md.random_forest, sample_frame(spark, sf), [f"{t}_index" for t in TARGETS], "sample_id"), "target-predictions")
    accuracy = held.groupBy("target").agg(F.count("*").alias("rows"), r6(F.avg((F.col("label") == F.col("prediction")).cast("double"))).alias("accuracy"))
    f1 = None
    for t in TARGETS:
        one = ev.weighted_f1(held.where(F.col("target") == f"{t}_index")).select(F.lit(f"{t}_index").alias("target"), r6("weighted_f1").alias("weighted_f1"))
        f1 = one if f1 is None else f1.unionByName(one)
    return accuracy.join(f1, "target")


def importance_table(spark, sf):
    frame, names = labelled_samples(spark, sf)
    return md.importances(md.random_forest().fit(frame.where("NOT is_test")), names, spark)


@query("X18_feature_importance")
def feature_importance(spark, sf):
    return importance_table(spark, sf).groupBy("modality").agg(F.count("*").alias("features"), r6(F.sum("importance")).alias("importance"))


@query("T3_top_importances")
def top_importances(spark, sf):
    return rounded(importance_table(spark, sf).orderBy(F.desc("importance"), "feature").limit(20), "importance")


@query("F7_projection")
def projection(spark, sf):
    vec = v.vectors(spark, sf).select("id", md.to_vector("features").alias("features"))
    return rounded(ft.project_2d(vec, vector="features").select("id", "x", "y"), "x", "y")


# Evaluation ---------------------------------------------------------------------------------------

_BIN = "c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn FROM predictions)"
_SCORES = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"


@query("X12_confusion_binary", W("predictions", "SELECT l AS label, p AS prediction, count(id) AS n FROM (VALUES (0), (1)) a(l), (VALUES (0), (1)) b(p) LEFT JOIN predictions ON label = l AND prediction = p GROUP BY 1, 2"))
def confusion_binary(spark, sf):
    return ev.confusion(v.predictions(spark, sf), [0, 1])


def class_predictions(spark, sf):
    """Priority digit against a price band: band 6 is no label, and rare bands are seldom right."""
    o = v.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("label"),
        F.least(F.floor(F.col("o_totalprice") / 90000) + 1, F.lit(6)).cast("int").alias("prediction"),
    )


_CLS = "cp AS (SELECT o_orderkey AS id, CAST(o_orderpriority[1] AS INTEGER) AS label, CAST(least(floor(o_totalprice / 90000) + 1, 6) AS INTEGER) AS prediction FROM orders)"


@query("X12_confusion_multiclass", f"WITH {_CLS} SELECT l AS label, p AS prediction, count(id) AS n FROM (SELECT unnest(range(1, 7))::INTEGER AS l) a, (SELECT unnest(range(1, 7))::INTEGER AS p) b LEFT JOIN cp ON label = l AND prediction = p GROUP BY 1, 2")
def confusion_multiclass(spark, sf):
    return ev.confusion(class_predictions(spark, sf), [1, 2, 3, 4, 5, 6])


@query("X13_binary_metrics", W("predictions", f"WITH {_BIN} SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM (SELECT *, {_SCORES} FROM c)"))
def binary_metrics(spark, sf):
    return rounded(ev.binary_metrics(v.predictions(spark, sf)), "precision", "recall", "f1", "accuracy")


_REPORT = (
    f"{_CLS}, k AS (SELECT DISTINCT c FROM (SELECT label AS c FROM cp UNION SELECT prediction FROM cp)), "
    "s AS (SELECT c, (SELECT count(*) FROM cp WHERE label = c AND prediction = c) AS tp, (SELECT count(*) FROM cp WHERE prediction = c) AS pred, (SELECT count(*) FROM cp WHERE label = c) AS support FROM k), "
    "m AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(tp / nullif(pred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(pred + support, 0), 0) AS f1, support, tp FROM s), "
    "rep AS (SELECT class, precision, recall, f1, support FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m "
    "UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM m)"
)


@query("X14_classification_report", f"WITH {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def classification_report(spark, sf):
    return rounded(ev.classification_report(class_predictions(spark, sf)), "precision", "recall", "f1")


@query("X15_weighted_f1", f"WITH {_REPORT} SELECT round(f1, 6) AS weighted_f1 FROM rep WHERE class = 'weighted avg'")
def weighted_f1(spark, sf):
    return rounded(ev.weighted_f1(class_predictions(spark, sf)), "weighted_f1")


_CURVE = (
    "g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM predictions GROUP BY 1), "
    "t AS (SELECT score, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"
)


@query("X16_roc_curve", W("predictions", f"WITH {_CURVE} SELECT score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM t"))
def roc_curve(spark, sf):
    return rounded(ev.roc_curve(v.predictions(spark, sf)), "fpr", "tpr")


@query("X16_roc_auc", W("predictions", f"WITH {_CURVE} SELECT round(sum(q * (tp - p / 2)) / any_value(pos * neg), 6) AS auc FROM t"))
def roc_auc(spark, sf):
    return rounded(ev.roc_auc(v.predictions(spark, sf)), "auc")


@query("X17_precision_recall", W("predictions", f"WITH {_CURVE} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM t"))
def precision_recall(spark, sf):
    return rounded(ev.precision_recall_curve(v.predictions(spark, sf)), "precision", "recall")


@query(
    "X19_gain_over_baseline",
    W("predictions", f"WITH {_BIN}, m AS (SELECT {_SCORES} FROM c) SELECT metric, baseline, round(value, 6) AS value, round((value - baseline) * 100, 6) AS gain_points FROM "
      "(SELECT 'precision' AS metric, 0.48::DOUBLE AS baseline, precision AS value FROM m UNION ALL SELECT 'recall', 0.41, recall FROM m UNION ALL SELECT 'f1', 0.44, f1 FROM m)"),
)
def gain_over_baseline(spark, sf):
    return rounded(ev.gain_over_baseline(ev.binary_metrics(v.predictions(spark, sf))), "value", "gain_points")


def rule_scores(spark, sf):
    """F1 of two rules per order priority."""
    p = v.predictions(spark, sf).withColumn("target", F.concat(F.lit("p"), F.col("model_no").cast("string")))
    price = p.withColumn("model", F.lit("price"))
    even = p.withColumn("prediction", (F.col("score") % 2 == 0).cast("int")).withColumn("model", F.lit("even"))
    return ev.binary_metrics(price.unionByName(even), ["target", "model"]).select("target", "model", F.col("f1").alias("score"))


_RULES = (
    "u AS (SELECT 'p' || model_no AS target, 'price' AS model, label, prediction FROM predictions UNION ALL SELECT 'p' || model_no, 'even', label, CAST(score % 2 = 0 AS INTEGER) FROM predictions), "
    "f AS (SELECT target, model, 2 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)) AS score FROM u GROUP BY 1, 2)"
)


@query("X20_compare_models", W("predictions", f"WITH {_RULES} SELECT target, round(max(score) FILTER (model = 'price'), 6) AS price, round(max(score) FILTER (model = 'even'), 6) AS even FROM f GROUP BY 1"))
def compare_models(spark, sf):
    return rounded(ev.compare_models(rule_scores(spark, sf), ["price", "even"]), "price", "even")


@query("T4_best_model", W("predictions", f"WITH {_RULES} SELECT model, round(score, 6) AS score FROM (SELECT model, avg(score) AS score FROM f GROUP BY 1) WHERE score > 0.3 ORDER BY score DESC, model LIMIT 1"))
def best_model(spark, sf):
    mean = rule_scores(spark, sf).groupBy("model").agg(F.avg("score").alias("score"))
    return rounded(ev.best_model(mean, 0.3), "score")
