"""Thresholds on uncertainty: whole tie groups are accepted, from the most certain on.

Running counts are over distinct scores, counted first, in ranges of the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.ordered import running_sums


def needed(target: Column, n: Column) -> Column:
    """Rows that reach the target share."""
    return F.ceil(target * n - 1e-12)


def running(df: DataFrame, score: str) -> DataFrame:
    g = df.groupBy(score).agg(F.count("*").alias("n"))
    return running_sums(g, score, {"seen": "n"})


def thresholds(df: DataFrame, score: str, targets: list[float]) -> DataFrame:
    """(target, threshold, retained, coverage): for each target share the first score whose running count reaches it."""
    spark = df.sparkSession
    points = spark.createDataFrame([(t,) for t in dict.fromkeys(targets)], "target double")
    run = running(df, score)
    n = run.agg(F.sum("n").alias("rows"))
    reach = run.crossJoin(n).crossJoin(points).where(F.col("seen") >= needed(F.col("target"), F.col("rows")))
    return reach.groupBy("target", "rows").agg(F.min(score).alias("threshold"), F.min("seen").alias("retained")).select("target", "threshold", "retained", (F.col("retained") / F.col("rows")).alias("coverage"))


def risk_curve(df: DataFrame, score: str, targets: list[float]) -> DataFrame:
    """thresholds with the error rate of what they accept."""
    t = thresholds(df, score, targets)
    errors = df.groupBy(score).agg(F.sum((~F.col("correct")).cast("long")).alias("errors"))
    return t.join(errors, F.col(score) <= F.col("threshold")).groupBy("target", "threshold", "retained", "coverage").agg((F.sum("errors") / F.first("retained")).alias("risk"))


def joint_gate(df: DataFrame, gates: list[str], target: float) -> DataFrame:
    """The smallest common rank at which rows that pass every gate reach the target share, and each gate's threshold.

    A row passes a gate at rank k if at most k - 1 rows are more certain by it; its own rank is the largest over gates.
    """
    ranked = df
    for g in gates:
        s = df.groupBy(g).agg(F.count("*").alias("n"))
        upto = running_sums(s, g, {"upto": "n"})
        ranked = ranked.join(upto.select(g, (F.col("upto") - F.col("n") + 1).alias(f"rank_{g}")), g)
    top = F.greatest(*[F.col(f"rank_{g}") for g in gates]) if len(gates) > 1 else F.col(f"rank_{gates[0]}")
    ranked = ranked.withColumn("joint", top)
    run = running(ranked, "joint")
    goal = run.agg(F.sum("n").alias("rows")).withColumn("goal", needed(F.lit(target), F.col("rows")))
    k = run.crossJoin(goal).where("seen >= goal").groupBy("rows", "goal").agg(F.greatest(F.min("joint"), F.first("goal")).alias("rank"))
    cut = [F.max(F.when(F.col(f"rank_{g}") <= F.col("rank"), F.col(g))).alias(f"threshold_{g}") for g in gates]
    out = ranked.crossJoin(k).groupBy("rank", "rows").agg(*cut, F.count_if(F.col("joint") <= F.col("rank")).alias("retained"))
    return out.select("rank", (F.col("rank") / F.col("rows")).alias("quantile"), "retained", (F.col("retained") / F.col("rows")).alias("coverage"), *[f"threshold_{g}" for g in gates])


def sweep(df: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut, coverage, accuracy, manual) where any row has that confidence."""
    points = df.sparkSession.createDataFrame([(c,) for c in cuts], "cut double")
    g = df.groupBy("confidence").agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("right"))
    rows = g.agg(F.sum("n").alias("rows"))
    hit = points.join(g, F.col("confidence") >= F.col("cut")).groupBy("cut").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    return hit.crossJoin(rows).select("cut", (F.col("n") / F.col("rows")).alias("coverage"), (F.col("right") / F.col("n")).alias("accuracy"), (1 - F.col("n") / F.col("rows")).alias("manual"))
