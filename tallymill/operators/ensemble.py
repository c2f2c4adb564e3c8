"""Means of several heads' class probabilities, and what they disagree on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions import vectors as V


def mean_probabilities(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, members, expected_entropy, predictive_entropy, mutual_information) over the rows of each key.

    Class values are averaged as rows with partial sums before the shuffle; p is scaled to sum to one.
    """
    long = df.select(*keys, V.entropy(F.col("p")).alias("own"), F.posexplode("p").alias("k", "x"))
    each = long.groupBy(*keys, "k").agg(F.avg("x").alias("x"), F.avg("own").alias("own"), F.count("*").alias("members"))
    joined = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"), F.first("own").alias("expected_entropy"), F.first("members").alias("members"))
    out = joined.withColumn("p", V.normalised(F.transform("s", lambda s: s["x"]))).withColumn("predictive_entropy", V.entropy(F.col("p")))
    return out.select(*keys, "p", "members", "expected_entropy", "predictive_entropy", F.greatest(F.lit(0.0), F.col("predictive_entropy") - F.col("expected_entropy")).alias("mutual_information"))
