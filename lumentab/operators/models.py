"""Models fitted by Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def linear_fit(df: DataFrame, label: str, penalty: float = 0.0):
    """Least squares with penalty * |w|^2 / 2 on the mean half squared error.

    The normal-equation solver needs one pass. It divides its parameter by the label's
    deviation, which is undone here, so that ``penalty`` means the same at any label scale.
    """
    if penalty:
        penalty *= df.agg(F.stddev_pop(label)).first()[0]
    return LinearRegression(featuresCol="features", labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal").fit(df)


def one_feature_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def softmax_regression(vectors: DataFrame, iterations: int = 30):
    """Multinomial logistic regression on ``v`` (array) and ``label``."""
    data = vectors.select("label", array_to_vector("v").alias("features"))
    return LogisticRegression(family="multinomial", maxIter=iterations).fit(data), data


def perceptron(vectors: DataFrame, inputs: int, hidden: int, classes: int, iterations: int = 30, seed: int = 42):
    data = vectors.select("label", array_to_vector("v").alias("features"))
    return MultilayerPerceptronClassifier(layers=[inputs, hidden, classes], maxIter=iterations, seed=seed).fit(data), data


def accuracy(model, data: DataFrame) -> DataFrame:
    scored = model.transform(data)
    return scored.agg(F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
