"""Forests that are fitted in parts."""

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from faultline.operators import models as md


def _rows(spark, n, slices=8):
    """Four features, three classes; the class follows the first two features in nine of ten rows."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    rows = spark.range(0, n, 1, slices).withColumn("x", F.array(*[unit(k) for k in range(4)]))
    kind = F.when(unit(9) < 0.1, F.floor(unit(10) * 3)).when(F.get("x", F.lit(0)) > 0.5, 2).otherwise((F.get("x", F.lit(1)) > 0.5).cast("int"))
    return rows.select("id", md.to_vector("x").alias("features"), kind.cast("double").alias("label"))


def _read_by(monkeypatch):
    """Numbers of tasks in which MLlib's fits read their rows."""
    seen, fit = [], RandomForestClassifier._fit

    def counted(self, dataset):
        seen.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(RandomForestClassifier, "_fit", counted)
    return seen


def test_a_large_forest_does_not_send_statistics_from_every_partition(spark, monkeypatch):
    """Every partition sent the statistics of every open node: 8 x the nodes of all trees here, and more with more cores."""
    rows = _rows(spark, 6000)
    seen = _read_by(monkeypatch)
    model = md.random_forest(trees=17, depth=5).fit(rows)
    assert seen == [1, 1, 1] and sorted(part.getNumTrees for part in model.parts) == [5, 6, 6]
    seen.clear()
    monkeypatch.setattr(md, "TASK_CELLS", 6000)
    md.random_forest(trees=10, depth=2).fit(rows)
    assert seen == [4, 4]  # tasks follow rows x features


def test_parts_of_wide_rows_have_more_trees(spark, monkeypatch):
    """A part finds the thresholds of all features anew: twenty parts over 521 features took five times as long as one fit."""
    unit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000)) / 10_000
    wide = F.transform(F.sequence(F.lit(0), F.lit(127)), unit)
    rows = spark.range(0, 4200, 1, 4).withColumn("x", wide).select("id", md.to_vector("x").alias("features"), (unit(200) < 0.5).cast("double").alias("label"))
    seen = _read_by(monkeypatch)
    model = md.random_forest(trees=20, depth=2).fit(rows)
    assert len(seen) == 2 and [part.getNumTrees for part in model.parts] == [10, 10] and len(model.trees) == 20
    seen.clear()
    assert len(md.random_forest(trees=19, depth=2).fit(rows).trees) == 19 and len(seen) == 1


def test_the_parts_are_one_forest(spark):
    rows = _rows(spark, 6000)
    model = md.random_forest(trees=13, depth=5).fit(rows)
    assert len(model.trees) == 13 and len({tree.toDebugString.partition("\n")[2] for tree in model.trees}) == 13
    some = rows.where("id % 60 = 0")
    out = model.transform(some).orderBy("id")
    assert out.columns == ["id", "features", "label", "rawPrediction", "probability", "prediction"]
    got = out.select("features", "prediction", vector_to_array("probability").alias("p"), vector_to_array("rawPrediction").alias("raw")).collect()
    for r in got[::10]:
        votes = np.array([tree.predictProbability(r.features).toArray() for tree in model.trees])
        assert np.allclose(r.raw, votes.sum(0)) and np.allclose(r.p, votes.mean(0)) and r.prediction == votes.sum(0).argmax()
    weights = np.mean([tree.featureImportances.toArray() for tree in model.trees], 0)
    assert np.allclose(model.featureImportances.toArray(), weights) and weights[:2].sum() > 0.8
    held = md.predict(model, rows, ["id"])
    assert held.columns == ["id", "label", "prediction", "score"] and held.where("label = prediction").count() > 0.85 * 6000


def test_a_small_forest_is_one_fit_as_before(spark):
    rows = _rows(spark, 300)
    now, plain = md.random_forest(trees=12, depth=4).fit(rows), RandomForestClassifier(numTrees=12, maxDepth=4, seed=42).fit(rows)
    assert isinstance(now, RandomForestClassificationModel)
    assert now.toDebugString.partition("\n")[2] == plain.toDebugString.partition("\n")[2]
