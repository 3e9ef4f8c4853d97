"""Learned baselines on link features with Spark's own estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balance(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` so that both classes weigh the same."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(n, label).withColumn("weight", 1.0 / F.col("__n")).drop("__n")


def fit_and_score(train: DataFrame, test: DataFrame, features: Sequence[str], kind: str = "logistic", seed: int = 7) -> DataFrame:
    """``test`` with ``score``; features are scaled by the training part only."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="error")
    scale = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(assemble.transform(train))
    prep = lambda df: scale.transform(assemble.transform(df))
    if kind == "logistic":
        model = LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01).fit(prep(balance(train)))
    elif kind == "boosted":
        model = GBTClassifier(maxIter=10, maxDepth=3, seed=seed).fit(prep(train))
    elif kind == "perceptron":
        model = MultilayerPerceptronClassifier(layers=[len(features), 8, 2], maxIter=50, seed=seed).fit(prep(train))
    else:
        raise ValueError(f"unknown model {kind}")
    return model.transform(prep(test)).withColumn("score", vector_to_array("probability")[1]).drop("__raw", "features", "rawPrediction", "probability", "prediction")
