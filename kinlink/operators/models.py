"""Gradient-boosted match models: cross-fitted training, out-of-fold scores, blends of fold models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Settings by stage: trees, depth, learning rate, share of rows and of features of a tree.  Stage 2 averages two
#: models of different regularity.
STAGES = {
    1: {"maxIter": 20, "maxDepth": 5, "stepSize": 0.15},
    2: [
        {"maxIter": 30, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.8"},
        {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6", "minInstancesPerNode": 5},
    ],
    3: {"maxIter": 30, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.7},
    4: {"maxIter": 30, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.7},
}


def fold_of(key: Column, folds: int = 2) -> Column:
    """The fold of a query, from its id alone."""
    return F.pmod(key, F.lit(folds)).cast("int")


def sampled(key: Column, share: float) -> Column:
    """A sample of queries that is the same for every partitioning."""
    return F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)


def nominal(name: str, values: int) -> Column:
    """The column, marked for the trees as one of so many categories (0 up) and not as a number."""
    return F.col(name).cast("double").alias(name, metadata={"ml_attr": {"type": "nominal", "name": name, "vals": [str(i) for i in range(values)]}})


def train(d: DataFrame, features: list[str], label: str, settings: dict, seed: int = 0, categories: dict[str, int] | None = None) -> PipelineModel:
    """``categories``: number of categories of the features that aren't numbers."""
    d = d.withColumns({c: nominal(c, n) for c, n in (categories or {}).items()})
    assemble = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=label, featuresCol="__x", seed=seed, predictionCol="__y", **settings).setRawPredictionCol("__r").setProbabilityCol("__p")
    return Pipeline(stages=[assemble, gbt]).fit(d.withColumn(label, F.col(label).cast("double")))


def predict(model: PipelineModel, d: DataFrame, out: str) -> DataFrame:
    return model.transform(d).withColumn(out, vector_to_array("__p")[1]).drop("__x", "__r", "__p", "__y")


def cross_fit(d: DataFrame, features: list[str], label: str, settings: dict | list[dict], key: str = "qi", folds: int = 2, share: float = 1.0, categories: dict[str, int] | None = None) -> list[list[PipelineModel]]:
    """Models by fold, one for each of ``settings``; those of fold k are trained without it."""
    several = settings if isinstance(settings, list) else [settings]
    part = d.filter(sampled(F.col(key), share)) if share < 1 else d
    return [[train(part.filter(fold_of(F.col(key), folds) != k), features, label, s, seed=k * 10 + i, categories=categories) for i, s in enumerate(several)] for k in range(folds)]


def out_of_fold(models: list[list[PipelineModel]], d: DataFrame, out: str, key: str = "qi") -> DataFrame:
    """Scores of each row by the models that didn't see its fold (their mean)."""
    parts = [_mean(m, d.filter(fold_of(F.col(key), len(models)) == k), out) for k, m in enumerate(models)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _mean(models: list[PipelineModel], d: DataFrame, out: str) -> DataFrame:
    names = [f"__m{i}" for i in range(len(models))]
    for m, n in zip(models, names):
        d = predict(m, d, n)
    return d.withColumn(out, sum((F.col(n) for n in names), F.lit(0.0)) / len(names)).drop(*names)


def mean_of_all(models: list[list[PipelineModel]], d: DataFrame, out: str) -> DataFrame:
    """Scores of new rows: the mean over all folds' models."""
    return _mean([m for fold in models for m in fold], d, out)


def importances(model: PipelineModel, features: list[str]) -> dict[str, float]:
    values = model.stages[-1].featureImportances.toArray()
    return dict(sorted(zip(features, map(float, values)), key=lambda x: -x[1]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
