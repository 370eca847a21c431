"""Searches over settings, a registry of models, and the built-in learners, whose splits are binned, as a quicker choice than exact ones."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrymill.operators import trees
from sentrymill.sources.tables import small_rows


def assembled(df: DataFrame, columns: Sequence[str], label: str, key: str) -> DataFrame:
    """key, label, features: numeric columns as one vector, nulls as 0; rows without a label are left out."""
    filled = df.where(F.col(label).isNotNull()).select(key, F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(filled).select(key, "label", "features")


def from_arrays(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    return df.select(key, F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


ESTIMATORS = {
    "decision_tree": lambda: DecisionTreeClassifier(maxDepth=10, maxBins=128, seed=42),
    "decision_tree_regressor": lambda: DecisionTreeRegressor(maxDepth=10, maxBins=128, seed=42),
    "random_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, featureSubsetStrategy="all", seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=10, maxDepth=3, seed=42),
    "perceptron": lambda: MultilayerPerceptronClassifier(layers=[64, 16, 2], maxIter=60, seed=42),
}


def fitted(name: str, train: DataFrame):
    return Pipeline(stages=[ESTIMATORS[name]()]).fit(train)


def saved(model: PipelineModel, folder: str) -> PipelineModel:
    """Writes a fitted model and returns it as it is read again."""
    model.write().overwrite().save(folder)
    return PipelineModel.load(folder)


def predictions(model, rows: DataFrame, key: str) -> DataFrame:
    return model.transform(rows).select(key, "label", "prediction")


def importances(model, names: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double")


def grid(**values: Sequence) -> list[dict]:
    """Every combination of the values, the last name running fastest."""
    return [dict(zip(values, own)) for own in product(*values.values())]


def drawn(values: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """``n`` settings with each value drawn by itself."""
    rng = random.Random(seed)
    return [{name: rng.choice(list(own)) for name, own in values.items()} for _ in range(n)]


def searched(rows: DataFrame, features: str, label: str, key: str, settings: Sequence[dict], k: int = 3, seed: int = 42) -> tuple[dict, list[tuple[dict, float]]]:
    """(best settings, mean accuracy of each): exact trees over k folds of rows shuffled by a hash of their key; the first of equal settings wins."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    fold = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint") % k
    folded = rows.where(F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"), fold.alias("fold")).persist()
    try:
        scores = []
        for own in settings:
            each = []
            for i in range(k):
                model = trees.fit_classifier(folded.where(F.col("fold") != i), "x", "y", **own)
                each.append(folded.where(F.col("fold") == i).agg(F.avg((model.column(F.col("x")) == F.col("y")).cast("double"))).first()[0] or 0.0)
            scores.append((own, sum(each) / k))
        return max(scores, key=lambda s: s[1])[0], scores
    finally:
        folded.unpersist()


def save_registry(spark: SparkSession, folder: str, models: dict[str, trees.Tree], scaler: dict[str, tuple[float, float]], metadata: dict) -> None:
    """Named models, the scaler's mean and deviation of each feature and metadata, as one JSON row each."""
    rows = [("model", n, m.to_json()) for n, m in models.items()] + [("scaler", n, json.dumps(v)) for n, v in scaler.items()] + [("metadata", n, json.dumps(v)) for n, v in metadata.items()]
    numbered = [(i, *r) for i, r in enumerate(rows)]
    spark.createDataFrame(numbered, "pos int, kind string, name string, body string").coalesce(1).write.mode("overwrite").json(folder)


def load_registry(spark: SparkSession, folder: str, bound: int = 100_000) -> tuple[dict[str, trees.Tree], dict[str, tuple[float, float]], dict]:
    rows = sorted(small_rows(spark.read.schema("pos int, kind string, name string, body string").json(folder), bound))
    of = lambda kind, read: {name: read(body) for _, k, name, body in rows if k == kind}
    return of("model", trees.Tree.from_json), of("scaler", lambda b: tuple(json.loads(b))), of("metadata", json.loads)


def area(model, rows: DataFrame) -> float:
    return BinaryClassificationEvaluator().evaluate(model.transform(rows))


def f1_weights(models: dict[str, Column], rows: DataFrame, label: str) -> dict[str, float]:
    """F1 of each model's predictions (columns of 0 and 1) over labelled rows, from one aggregation; 0 where nothing is found."""
    y = F.col(label) > 0.5
    counts = [F.struct(F.count_if(y & (c > 0.5)).alias("tp"), F.count_if(~y & (c > 0.5)).alias("fp"), F.count_if(y & ~(c > 0.5)).alias("fn")).alias(n) for n, c in models.items()]
    row = rows.where(F.col(label).isNotNull()).agg(*counts).first()
    return {n: 2 * row[n].tp / d if (d := 2 * row[n].tp + row[n].fp + row[n].fn) else 0.0 for n in models}


class Estimator:
    """A learner with settings: ``fit`` and ``score`` on rows (features, label); ``set_params`` gives a new one."""

    FITS = {
        "tree": lambda rows, own: trees.fit_classifier(rows, "x", "y", **own),
        "regressor": lambda rows, own: trees.fit_regressor(rows, "x", "y", **own),
        "forest": lambda rows, own: trees.fit_forest(rows, "x", "y", "key", **own),
        "boosted": lambda rows, own: trees.fit_boosted(rows, "x", "y", **own),
    }

    def __init__(self, kind: str, **params):
        if kind not in self.FITS:
            raise ValueError(f"no learner {kind}")
        self.kind, self.params, self.model = kind, params, None

    def set_params(self, **params) -> Estimator:
        return Estimator(self.kind, **(self.params | params))

    def fit(self, rows: DataFrame) -> Estimator:
        """``rows`` has x, y and, for forests, key."""
        self.model = self.FITS[self.kind](rows, self.params)
        return self

    def score(self, rows: DataFrame) -> float:
        """Accuracy; of a regressor the share of variance explained. 0 without rows."""
        if self.model is None:
            raise ValueError("fit first")
        kept = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("y").cast("double").alias("y"), self.model.column(F.col("x")).alias("p"))
        if self.kind == "regressor":
            out = kept.agg((1 - F.try_divide(F.sum((F.col("y") - F.col("p")) ** 2), F.count("*") * F.var_pop("y"))).alias("s"))
        else:
            out = kept.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("s"))
        return out.first()["s"] or 0.0
