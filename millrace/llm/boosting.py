"""Gradient-boosted trees over named numeric columns, with a fallback where labels cannot train any."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_margin(train: DataFrame, features: list[str], label: str = "label", rounds: int = 12, depth: int = 3, seed: int = 11):
    """A function that adds the column `margin` (higher: label 1 likelier) to a frame with `features`.

    `train` is a bounded sample, already cut. Without rows of both labels the margin is 0 for every row.
    """
    seen = {r[0] for r in train.select(F.col(label).cast("int")).distinct().collect()}
    if not {0, 1} <= seen:
        return lambda df: df.withColumn("margin", F.lit(0.0))
    assemble = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed)
    model = trees.fit(assemble.transform(train.withColumn("_label", F.col(label).cast("double"))))

    def add(df: DataFrame) -> DataFrame:
        out = model.transform(assemble.transform(df))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("_features", "rawPrediction", "probability", "prediction")

    return add
