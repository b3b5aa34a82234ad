"""Splits, folds and MLlib classifiers with the parameters of the pipelines they stand for."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.ordered import attach, number_rows
from faultline.operators.evaluate import binary_metrics, weighted_f1


def _class_position(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Position of each row inside its class in hash order; hash ranges keep big classes spread out."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    return number_rows(hashed, [label], ["_h", key], F.shiftright("_h", 52), "_pos")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: the same share (rounded half up) of every class, repeatable; rows without a label are a class."""
    size = df.groupBy(label).agg(F.count("*").alias("_n"))
    placed = attach(_class_position(df, label, key, seed), size, [label])
    return placed.select(*df.columns, (F.col("_pos") <= F.floor(F.col("_n") * test + 0.5)).alias("is_test"))


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    placed = _class_position(df, label, key, seed)
    return placed.select(*df.columns, F.pmod(F.col("_pos") - 1, F.lit(folds)).cast("int").alias("fold"))


def to_vector(c: str) -> Column:
    return array_to_vector(F.col(c).cast("array<double>"))


#: Up to so many rows a forest is one fit; the parts' jobs would take longer than the trees.
ONE_FIT = 4096
#: Trees of a part for rows of up to so many features, and numbers (rows x features) that one task of a part reads.
PART_TREES, PART_FEATURES, TASK_CELLS = 5, 64, 1 << 24


class Forest(RandomForestClassifier):
    """Random forest whose trees are fitted a few at a time, side by side.

    MLlib sends the statistics of every open node from every partition, kilobytes even for a node of two rows. So
    each part reads the rows in as few tasks as their size allows, and the parts fill the cluster, not the partitions.
    Every part also finds the thresholds of every feature anew, so parts of wider rows have more trees.
    Every part reads ``dataset`` anew: it should be a stored table.
    """

    def _fit(self, dataset):
        rows, trees = dataset.count(), self.getNumTrees()
        if rows <= ONE_FIT or trees < 2 * PART_TREES:
            return super()._fit(dataset)
        features = dataset.select(self.getFeaturesCol()).first()[0].size
        each = max(PART_TREES, -(-PART_TREES * features // PART_FEATURES))
        if trees < 2 * each:
            return super()._fit(dataset)
        tasks = -(-rows * features // TASK_CELLS)
        few = dataset.coalesce(tasks)
        parts = trees // each
        # A partition draws its bags by seed + its number, so the parts' seeds are far apart.
        makes = [self.copy({self.numTrees: trees // parts + (i < trees % parts), self.seed: self.getSeed() + 1_000_003 * i}) for i in range(parts)]
        # Twice the cores: a part waits for the driver between two levels.
        with ThreadPoolExecutor(max_workers=min(parts, -(-2 * dataset.sparkSession.sparkContext.defaultParallelism // tasks))) as pool:
            return ForestModel(list(pool.map(lambda make: RandomForestClassifier._fit(make, few), makes)))


class ForestModel(Model):
    """The parts of a ``Forest`` as one model: their votes add up."""

    def __init__(self, parts: list):
        super().__init__()
        self.parts = parts

    @property
    def trees(self) -> list:
        return [tree for part in self.parts for tree in part.trees]

    @property
    def featureImportances(self) -> DenseVector:
        total = sum(tree.featureImportances.toArray() for tree in self.trees)
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset):
        out, votes = dataset, [f"_votes_{i}" for i in range(len(self.parts))]
        for part, name in zip(self.parts, votes, strict=True):
            out = part.transform(out, {part.rawPredictionCol: name, part.probabilityCol: "", part.predictionCol: ""})
        total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [vector_to_array(name) for name in votes])
        one, trees = self.parts[0], sum(part.getNumTrees for part in self.parts)
        share = F.transform("_votes", lambda x: x / trees)
        return out.select(*dataset.columns, total.alias("_votes")).select(
            *dataset.columns, array_to_vector("_votes").alias(one.getRawPredictionCol()), array_to_vector(share).alias(one.getProbabilityCol()),
            (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double").alias(one.getPredictionCol()),
        )


def random_forest(trees: int = 100, depth: int = 15, seed: int = 42) -> Estimator:
    return Forest(numTrees=trees, maxDepth=depth, seed=seed)


def gradient_boosting(rounds: int = 100, depth: int = 5, seed: int = 42, classes: int = 2) -> Estimator:
    booster = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed)
    # The classes' jobs fill the cluster together.
    return booster if classes == 2 else OneVsRest(classifier=booster, parallelism=classes)


def logistic_regression(iterations: int = 1000, rows: int | None = None, strength: float = 1.0) -> Estimator:
    """L2-penalised as sum of losses times ``strength`` plus half the squared weights; needs the number
    of training rows, without it there is no penalty."""
    penalty = 0.0 if rows is None else 1.0 / (strength * max(rows, 1))
    return LogisticRegression(maxIter=iterations, family="auto", regParam=penalty, standardization=False)


def perceptron(inputs: int, classes: int, hidden: tuple[int, ...] = (128, 64), iterations: int = 300, seed: int = 42) -> Estimator:
    return MultilayerPerceptronClassifier(layers=[inputs, *hidden, classes], maxIter=iterations, seed=seed)


def detectors(inputs: int, classes: int, rows: int | None = None) -> dict[str, Estimator]:
    """Classifiers to compare; callers may add any ``pyspark.ml`` estimator under a name."""
    return {
        "random_forest": random_forest(),
        "gradient_boosting": gradient_boosting(classes=classes),
        "logistic_regression": logistic_regression(rows=rows),
        "perceptron": perceptron(inputs, classes),
    }


def predict(model, df: DataFrame, keep: list[str], label: str = "label") -> DataFrame:
    """(keep, label, prediction, score of class 1 where the model gives one)."""
    out = model.transform(df)
    has_probability = "probability" in out.columns
    score = F.get(vector_to_array("probability"), F.lit(1)) if has_probability else F.col("prediction")
    return out.select(
        *keep, F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
        score.cast("double").alias("score"),
    )


def evaluate_each(models: dict[str, Estimator], df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Fit every estimator on the training rows and predict the test rows: (key, label, prediction, score, model)."""
    train, test = df.where("NOT is_test"), df.where("is_test")
    frames = []
    for name, estimator in models.items():
        fitted = estimator.copy({}) if not hasattr(estimator, "setLabelCol") else estimator.setLabelCol(label)
        frames.append(predict(fitted.fit(train), test, [key], label).withColumn("model", F.lit(name)))
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def cross_validate(estimator: Estimator, df: DataFrame, folds: int, key: str, label: str = "label", binary: bool = True) -> DataFrame:
    """F1 of every fold (class 1, or weighted for several classes); ``df`` carries ``fold``."""

    def score(f: int) -> DataFrame:
        model = estimator.copy().fit(df.where(F.col("fold") != f))
        held = predict(model, df.where(F.col("fold") == f), [key], label)
        metric = binary_metrics(held).select(F.col("f1")) if binary else weighted_f1(held).withColumnRenamed("weighted_f1", "f1")
        return metric.withColumn("fold", F.lit(f))

    with ThreadPoolExecutor(max_workers=folds) as pool:  # the folds' jobs fill the cluster together
        scores = list(pool.map(score, range(folds)))
    out = scores[0]
    for other in scores[1:]:
        out = out.unionByName(other)
    return out


def fold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))


def train_targets(make, df: DataFrame, targets: list[str], key: str) -> DataFrame:
    """One model per target on anomalous rows: (key, label, prediction, score, target).

    ``df`` has ``is_anomaly``, ``is_test``, ``features`` and index columns for the targets.
    """
    anomalous = df.where("is_anomaly = 1")
    out = None
    for target in targets:
        frame = anomalous.select(key, "is_test", "features", F.col(target).cast("double").alias("label"))
        model = make().fit(frame.where("NOT is_test"))
        held = predict(model, frame.where("is_test"), [key]).withColumn("target", F.lit(target))
        out = held if out is None else out.unionByName(held)
    return out


def importances(model, names: list[str], spark) -> DataFrame:
    """Feature importances with the modality each feature belongs to."""
    tree = model.stages[-1] if isinstance(model, PipelineModel) else model
    values = tree.featureImportances.toArray()
    table = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    kind = F.when(F.startswith("feature", F.lit("log_")), "log").when(F.startswith("feature", F.lit("tfidf")), "text")
    return table.withColumn("modality", kind.otherwise("metric"))
