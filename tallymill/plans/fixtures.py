"""The driver's tables read as the records of this library: probability heads, paired systems, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import vectors as V
from tallymill.operators.ensemble import mean_probabilities
from tallymill.operators.metrics import predicted
from tallymill.plans.registry import table

CLASSES, HEADS = 10, 5


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, h, p): five heads of ten class probabilities for each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("y"), "embedding")
    parts = F.array(*[F.struct(F.lit(h).alias("h"), F.slice("embedding", 10 * h + 1, 10).alias("z")) for h in range(HEADS)])
    return e.select("id", "y", F.inline(parts)).select("id", "y", "h", V.softmax(F.transform("z", lambda x: 8 * x.cast("double"))).alias("p"))


def head(spark: SparkSession, sf_dir: str, h: int = 0) -> DataFrame:
    return predicted(heads(spark, sf_dir).where(F.col("h") == h).drop("h"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All heads' mean, with its uncertainties."""
    return predicted(mean_probabilities(heads(spark, sf_dir), ["id", "y"]))


HEADS_CTE = """heads AS (
  SELECT id, y, h, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
    SELECT id, y, h, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM (
      SELECT vec_id AS id, label AS y, CAST(t.h AS INTEGER) AS h, list_transform(embedding[10 * t.h + 1:10 * t.h + 10], lambda x: 8 * CAST(x AS DOUBLE)) AS z
      FROM embeddings, range(0, 5) t(h))))"""

_MARKED = "list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 = y AS correct"
PRED_CTE = f"{HEADS_CTE}, pred AS (SELECT id, y, p, {_MARKED} FROM heads WHERE h = 0)"
_ENTROPY = "-list_sum(list_transform({0}, lambda x: x * ln(greatest(x, 1e-12))))"
ENSEMBLE_CTE = f"""{HEADS_CTE},
own AS (SELECT id, avg({_ENTROPY.format('p')}) AS expected_entropy, count(*) AS members FROM heads GROUP BY id),
cells AS (SELECT id, y, k, avg(p[k]) AS x FROM heads, range(1, 11) c(k) GROUP BY id, y, k),
means AS (SELECT id, y, list_transform(q, lambda v: v / list_sum(q)) AS p FROM (SELECT id, y, list(x ORDER BY k) AS q FROM cells GROUP BY id, y)),
ens AS (
  SELECT id, y, p, members, expected_entropy, {_ENTROPY.format('p')} AS predictive_entropy,
         greatest(0.0, {_ENTROPY.format('p')} - expected_entropy) AS mutual_information, {_MARKED}
  FROM means JOIN own USING (id))"""
