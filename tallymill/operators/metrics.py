"""Classification, calibration and selective-risk metrics of rows (y, p): the true class and its class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import vectors as V
from tallymill.operators.ordered import running_sums


def predicted(df: DataFrame) -> DataFrame:
    """With pred, confidence and correct."""
    return df.withColumns({"pred": V.argmax(F.col("p")), "confidence": F.array_max("p")}).withColumn("correct", F.col("pred") == F.col("y"))


def class_grid(df: DataFrame, classes: int, name: str) -> DataFrame:
    return df.sparkSession.range(classes).select(F.col("id").cast("int").alias(name))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """(y, pred, n, share): every cell, and its share of its row."""
    n = df.groupBy("y", "pred").agg(F.count("*").alias("n"))
    grid = class_grid(df, classes, "y").crossJoin(class_grid(df, classes, "pred"))
    cells = grid.join(n, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    return cells.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy("y"))))


def class_report(df: DataFrame, classes: int, by: list[str] | None = None) -> DataFrame:
    """(class, precision, recall, f1, support) of every class, for each group of by."""
    by = by or []
    # One row becomes its true class and its predicted class: one shuffle of class counts, whatever the rows.
    marks = F.array(
        F.struct(F.col("y").cast("int").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("d"), (F.col("y") == F.col("pred")).cast("int").alias("tp")),
        F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("d"), F.lit(0).alias("tp")),
    )
    n = df.select(*by, F.inline(marks)).groupBy(*by, "class").agg(F.sum("t").alias("support"), F.sum("d").alias("decided"), F.sum("tp").alias("tp"))
    grid = class_grid(df, classes, "class")
    if by:
        grid = df.select(*by).distinct().crossJoin(grid)
    full = grid.join(n, [*by, "class"], "left").fillna(0, ["support", "decided", "tp"])
    precision, recall = ratio(F.col("tp"), F.col("decided")), ratio(F.col("tp"), F.col("support"))
    out = full.withColumns({"precision": precision, "recall": recall})
    return out.select(*by, "class", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support", "tp")


def averages(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy and averages over classes; balanced accuracy leaves out classes that no row truly has."""
    return report.groupBy(*(by or [])).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def log_loss(clip: float = 2.220446049250313e-16) -> Column:
    true = F.element_at("p", F.col("y") + 1)
    return F.avg(-F.ln(F.greatest(F.lit(clip), F.least(F.lit(1 - clip), true))))


def brier(classes: int) -> Column:
    return F.avg(V.squared_error(F.col("p"), F.col("y"), classes))


def bin_of(x: Column, bins: int, closed: bool = True) -> Column:
    """Equal-width bin of a value in [0, 1]; closed: the last bin holds 1 too, else 1 has none."""
    at = F.floor(x * bins)
    # The edges decide, as floor can be off by one beside them.
    at = F.when(x < at / bins, at - 1).when(x >= (at + 1) / bins, at + 1).otherwise(at)
    return F.when(at < bins, at).when(F.lit(closed) & (x <= 1), bins - 1).cast("int")


def reliability(df: DataFrame, bins: int, closed: bool = True) -> DataFrame:
    """(bin, low, high, n, confidence, accuracy) of every bin; empty bins have null means."""
    n = df.groupBy(bin_of(F.col("confidence"), bins, closed).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    grid = class_grid(df, bins, "bin")
    return grid.join(n, "bin", "left").select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected calibration error from a reliability table."""
    return table.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def rank_auc(df: DataFrame, score: str, positive: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve for each group, ties at average rank; null where a class is absent.

    Rows are counted by distinct score first, then added up in ranges of the score.
    """
    by = by or []
    s = df.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("pos"))
    g = running_sums(s, score, {"upto": "n"}, by).withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).groupBy(*by).agg(F.sum("pos").alias("np"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    pos, neg = F.col("np"), F.col("n") - F.col("np")
    return g.select(*by, F.when((pos > 0) & (neg > 0), (F.col("ranks") - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"))


def macro_auc(df: DataFrame, classes: int) -> DataFrame:
    """Mean one-against-rest area; null unless every class has rows and others."""
    long = df.select("y", F.posexplode("p").alias("class", "score")).withColumn("positive", F.col("y") == F.col("class"))
    each = rank_auc(long, "score", "positive", ["class"])
    return each.agg(F.when(F.count("auc") == classes, F.avg("auc")).alias("macro_auc"))


def tie_groups(df: DataFrame, score: str) -> DataFrame:
    """(score, n, errors, seen, wrong): counts by distinct score, running from the smallest."""
    g = df.groupBy(score).agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("errors"))
    return running_sums(g, score, {"seen": "n", "wrong": "errors"})


def area_under_risk(df: DataFrame, score: str) -> DataFrame:
    """Mean over rows of the error rate among rows as certain or more, ties whole."""
    return tie_groups(df, score).agg((F.sum(F.col("n") * F.col("wrong") / F.col("seen")) / F.sum("n")).alias("aurc"))


def average_precision(df: DataFrame, score: str) -> DataFrame:
    """Average precision of errors ranked by descending score, ties whole; null without errors."""
    g = df.groupBy(score).agg(F.count("*").alias("n"), F.sum((~F.col("correct")).cast("long")).alias("errors"))
    t = running_sums(g, score, {"seen": "n", "found": "errors"}, descending=True)
    return t.agg((F.sum(F.col("errors") * F.col("found") / F.col("seen")) / F.nullif(F.sum("errors"), F.lit(0))).alias("average_precision"))


def accepted_risk(df: DataFrame, accept: Column, classes: int) -> DataFrame:
    """Coverage, error rate and macro F1 of accepted rows; without any, rates are not numbers."""
    counts = df.agg(F.count("*").alias("rows"), F.count_if(accept).alias("retained"), F.count_if(accept & ~F.col("correct")).alias("errors"))
    f1 = averages(class_report(df.where(accept), classes)).select("macro_f1")
    nan = F.lit(float("nan"))
    return counts.crossJoin(f1).select(
        "retained",
        (F.col("retained") / F.col("rows")).alias("coverage"),
        F.when(F.col("retained") == 0, nan).otherwise(F.col("errors") / F.nullif(F.col("retained"), F.lit(0))).alias("risk"),
        F.when(F.col("retained") == 0, nan).otherwise(F.col("macro_f1")).alias("macro_f1"),
    )
