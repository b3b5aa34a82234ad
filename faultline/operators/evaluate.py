"""Evaluation of predictions (id, label, prediction, score) as few-row frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import ratio
from faultline.functions.ordered import attach, edges, running_sum, value_bucket


def confusion(df: DataFrame, classes: list | None = None) -> DataFrame:
    """(label, prediction, n); with ``classes`` every cell of the grid is present."""
    cells = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    if classes is None:
        return cells
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "label int, prediction int")
    return F.broadcast(grid).join(cells, ["label", "prediction"], "left").fillna(0, ["n"])


def binary_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1 (0 where undefined) and accuracy."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *(by or []), "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def classification_report(df: DataFrame) -> DataFrame:
    """Per class precision/recall/F1/support with macro and weighted averages and accuracy."""
    cells = confusion(df)
    sides = cells.select(F.col("label").alias("c"), F.col("n").alias("sup"), F.lit(0).alias("pred"),
                         F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(cells.select(F.col("prediction").alias("c"), F.lit(0).alias("sup"),
                                           F.col("n").alias("pred"), F.lit(0).alias("tp")))
    per = sides.groupBy("c").agg(F.sum("sup").alias("support"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    per = per.select(
        F.col("c").cast("string").alias("class"),
        ratio(F.col("tp"), F.col("pred")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("pred") + F.col("support")).alias("f1"),
        "support", "tp",
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = per.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in scores], total.alias("support"))
    weighted = per.agg(*[ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in scores], total.alias("support"))
    acc = per.agg(*[ratio(F.sum("tp"), total).alias(c) for c in scores], total.alias("support"))
    out = per.drop("tp")
    for name, frame in (("macro avg", macro), ("weighted avg", weighted), ("accuracy", acc)):
        out = out.unionByName(frame.withColumn("class", F.lit(name)).select(*out.columns))
    return out


def weighted_f1(df: DataFrame) -> DataFrame:
    return classification_report(df).where("class = 'weighted avg'").select(F.col("f1").alias("weighted_f1"))


def threshold_counts(df: DataFrame) -> DataFrame:
    """Cumulative true and false positives per distinct score, highest first (ties are one threshold).

    Rows are aggregated per score before any ordering, then summed over score ranges.
    """
    per = df.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q")
    ).withColumn("o", -F.col("score"))
    placed = attach(per, per.agg(edges(F.col("o")).alias("_cuts")), [])
    spot = value_bucket(F.col("o"), F.col("_cuts"))
    totals = df.agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    cum = running_sum(placed, [], ["o"], spot, {"tp": F.col("p"), "fp": F.col("q")})
    return attach(cum.select("score", "p", "q", "tp", "fp"), totals, [])


def roc_curve(df: DataFrame) -> DataFrame:
    return threshold_counts(df).select(
        "score", ratio(F.col("fp"), F.col("neg")).alias("fpr"), ratio(F.col("tp"), F.col("pos")).alias("tpr")
    )


def roc_auc(df: DataFrame) -> DataFrame:
    """Area by trapezoids: each threshold adds its negatives times the mean of true positives around it."""
    t = threshold_counts(df)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    return t.agg(ratio(area, F.max("pos") * F.max("neg")).alias("auc"))


def precision_recall_curve(df: DataFrame) -> DataFrame:
    return threshold_counts(df).select(
        "score",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("pos")).alias("recall"),
    )


def gain_over_baseline(metrics: DataFrame, precision: float = 0.48, recall: float = 0.41, f1: float = 0.44) -> DataFrame:
    """Each metric beside its baseline value and the difference in points."""
    base = {"precision": precision, "recall": recall, "f1": f1}
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(b)).alias("baseline"), F.col(m).alias("value"))
                     for m, b in base.items()])
    return metrics.select(F.explode(rows).alias("r")).select(
        "r.metric", "r.baseline", "r.value", ((F.col("r.value") - F.col("r.baseline")) * 100).alias("gain_points")
    )


def compare_models(scores: DataFrame, models: list[str], by: str = "target", score: str = "score") -> DataFrame:
    """Targets as rows, models as columns."""
    return scores.groupBy(by).pivot("model", models).agg(F.first(score))


def best_model(scores: DataFrame, baseline: float = float("-inf"), score: str = "score") -> DataFrame:
    """The model with the highest score that beats the baseline (ties: first name)."""
    ahead = scores.where(F.col(score) > F.lit(baseline))
    return ahead.agg(
        F.min_by("model", F.struct(-F.col(score), "model")).alias("model"), F.max(score).alias("score")
    ).where("model IS NOT NULL")
