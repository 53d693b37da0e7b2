"""Clusters, components and classes of band vectors with Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame


def _vectors(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(bands), outputCol="__bands", handleInvalid="skip").transform(df)


def principal_components(df: DataFrame, bands: Sequence[str], count: int) -> DataFrame:
    """component array for each row whose bands are all known."""
    v = _vectors(df, bands)
    out = PCA(k=count, inputCol="__bands", outputCol="__pca").fit(v).transform(v)
    return out.withColumn("components", vector_to_array("__pca")).drop("__bands", "__pca")


def k_means(df: DataFrame, bands: Sequence[str], clusters: int = 14, iterations: int = 30, seed: int = 31415) -> DataFrame:
    v = _vectors(df, bands)
    return KMeans(k=clusters, maxIter=iterations, seed=seed, featuresCol="__bands", predictionCol="cluster").fit(v).transform(v).drop("__bands")


def gaussian_mixture(df: DataFrame, bands: Sequence[str], clusters: int = 14, iterations: int = 30, seed: int = 31415) -> DataFrame:
    v = _vectors(df, bands)
    out = GaussianMixture(k=clusters, maxIter=iterations, seed=seed, featuresCol="__bands", predictionCol="cluster", probabilityCol="__p").fit(v).transform(v)
    return out.drop("__bands", "__p")


def random_forest(train: DataFrame, df: DataFrame, bands: Sequence[str], label: str, trees: int = 10, seed: int = 0) -> DataFrame:
    model = RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="__bands", labelCol=label, predictionCol="class").fit(_vectors(train, bands))
    return model.transform(_vectors(df, bands)).drop("__bands", "rawPrediction", "probability")


def decision_tree(train: DataFrame, df: DataFrame, bands: Sequence[str], label: str, depth: int = 5, seed: int = 0) -> DataFrame:
    model = DecisionTreeClassifier(maxDepth=depth, seed=seed, featuresCol="__bands", labelCol=label, predictionCol="class").fit(_vectors(train, bands))
    return model.transform(_vectors(df, bands)).drop("__bands", "rawPrediction", "probability")
