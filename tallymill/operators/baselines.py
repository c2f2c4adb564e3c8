"""Linear and constant baselines for text classes."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_prior(train: DataFrame, y: str, classes: int) -> DataFrame:
    """(p): one row, each class's share of the training rows; no rows give equal shares. Null labels are left out."""
    n = train.where(F.col(y).isNotNull()).agg(*[F.count_if(F.col(y) == k).alias(f"n{k}") for k in range(classes)], F.count("*").alias("n"))
    return n.select(F.array(*[F.when(F.col("n") > 0, F.col(f"n{k}") / F.nullif(F.col("n"), F.lit(0))).otherwise(1 / classes) for k in range(classes)]).alias("p"))


def with_prior(df: DataFrame, prior: DataFrame) -> DataFrame:
    """df with the same class probabilities in every row, as a constant baseline predicts."""
    return df.crossJoin(F.broadcast(prior))  # one row


def fit_text_classifier(train: DataFrame, text: str, y: str, *, features: int = 1 << 16, regularise: float = 1e-3, rounds: int = 30) -> PipelineModel:
    """Hashed word counts with inverse document frequencies under multinomial logistic regression. Null texts are empty; null labels are
    left out. Needs rows of two classes or more for a model that separates any."""
    rows = train.where(F.col(y).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(y).cast("double").alias("label"))
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(family="multinomial", regParam=regularise, maxIter=rounds),
    ]
    return Pipeline(stages=steps).fit(rows)


def text_probabilities(df: DataFrame, model: PipelineModel, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, and p: class probabilities in order of class."""
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return model.transform(rows).select(*keep, vector_to_array("probability").alias("p"))
