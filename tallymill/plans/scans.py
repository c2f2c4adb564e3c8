"""Queries through the readers and writers, and the metric registry."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.functions import vectors as V
from tallymill.operators import metrics as M
from tallymill.operators.components import checkpoint_dir
from tallymill.operators.radius import RadiusIndex
from tallymill.operators.tables import temporal_split
from tallymill.plans.fixtures import CLASSES, PRED_CTE, head
from tallymill.plans.records import _CODES, _REPORT, codes, printed_report
from tallymill.plans.metrics import report_sql
from tallymill.plans.registry import query, table
from tallymill.sources import files as S
from tallymill.sources import layout


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_typed_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", "l_quantity")
def typed_scan(spark, sf):
    path = _folder(spark, "typed")
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").write.option("header", True).csv(path)
    rules = {"key": F.col("l_orderkey").isNotNull(), "quantity": F.col("l_quantity") >= 0}
    return S.typed_csv(spark, path, "l_orderkey long, l_linenumber int, l_quantity double", "l_orderkey", rules)


@query("s3_metric_scan", f"WITH {_REPORT} SELECT label, printf('%d.%04d', p // 10000, p % 10000) AS precision, s AS support FROM rep")
def metric_scan(spark, sf):
    path = _folder(spark, "report")
    printed_report(spark, sf).write.option("header", True).csv(path)
    return S.metric_report(spark, path).select("label", "precision", "support")


@query("s5_embedding_scan", "SELECT vec_id, len(embedding) AS width FROM embeddings")
def embedding_scan(spark, sf):
    return S.embeddings(spark, f"{sf}/embeddings.parquet").select("vec_id", F.size("embedding").cast("long").alias("width"))


@query("s8_seed_scan", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 0")
def seed_scan(spark, sf):
    # The 25 nations stand for a registry's seed file, one JSON array.
    path, k = _folder(spark, "seed"), F.col("n_nationkey")
    site = F.struct(k.alias("id"), F.col("n_name").alias("name"), F.lit("x").alias("category"), F.when(k % 4 == 0, 99.0).otherwise(-6.0).alias("latitude"), F.lit(106.0).alias("longitude"), F.lit(True).alias("is_active"))
    table(spark, sf, "nation").agg(F.to_json(F.collect_list(site)).alias("value")).write.text(path)
    return S.seed_agencies(spark, path).select(F.col("id").cast("int").alias("id"), "name")


@query("s13_split_sink", "SELECT split, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n, CASE WHEN max(l_shipdate) < TIMESTAMP '1995-06-01' THEN 'train' WHEN min(l_shipdate) >= TIMESTAMP '1995-06-01' AND max(l_shipdate) < TIMESTAMP '1996-06-01' THEN 'val' WHEN min(l_shipdate) >= TIMESTAMP '1996-06-01' THEN 'test' ELSE 'quarantine' END AS split FROM lineitem GROUP BY l_orderkey) GROUP BY split")
def split_sink(spark, sf):
    path = _folder(spark, "splits")
    rows = table(spark, sf, "lineitem")
    S.write_splits(rows.join(temporal_split(rows, "l_orderkey", "l_shipdate", "1995-06-01", "1996-06-01").select("l_orderkey", "split"), "l_orderkey"), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"))


@query("f13_ordered_digest", "SELECT label, sha256('[' || string_agg('\"' || vec_id || '\"', ',' ORDER BY vec_id) || ']') AS digest FROM embeddings GROUP BY label")
def ordered_digest(spark, sf):
    ids = F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string"))
    return table(spark, sf, "embeddings").groupBy("label").agg(F.sha2(F.to_json(ids), 256).alias("digest"))


@query("c3_radius_query", f"WITH {_CODES} SELECT id FROM codes WHERE bit_count(xor(code, 2654435761)) <= 12")
def radius_query(spark, sf):
    # One code against all: a filter needs no index.
    return codes(spark, sf).where(T.hamming(F.col("code"), F.lit(2654435761)) <= 12).select("id")


@query("c3_radius_index", f"WITH {_CODES}, q AS (SELECT id AS query, code AS c FROM codes WHERE id % 50 = 0) SELECT query, id, CAST(bit_count(xor(code, c)) AS INTEGER) AS distance FROM q JOIN codes ON bit_count(xor(code, c)) <= 5")
def radius_index(spark, sf):
    # Every 50th order's code against all, by the stored index.
    c = codes(spark, sf)
    return RadiusIndex(spark, _folder(spark, "index")).build(c, "id", "code").matches(c.where("id % 50 = 0"), "id", "code", 5)


@query("q15_data_skipping", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 14 AND l_extendedprice BETWEEN 20000 AND 60000 AND l_shipdate <= TIMESTAMP '1997-01-01'")
def data_skipping(spark, sf):
    path = _folder(spark, "clustered")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    layout.write_clustered(rows, path, ["l_quantity", "l_extendedprice", "l_shipdate"], files=32)
    within = {"l_quantity": (10, 14), "l_extendedprice": (20000, 60000), "l_shipdate": (None, datetime.datetime(1997, 1, 1))}
    return layout.read_within(spark, path, within).select("l_orderkey", "l_linenumber")


METRICS = {
    "accuracy": lambda df: df.agg(F.avg(F.col("correct").cast("double")).alias("value")),
    "macro_f1": lambda df: M.averages(M.class_report(df, CLASSES)).select(F.col("macro_f1").alias("value")),
    "brier": lambda df: df.agg(F.avg(V.squared_error(F.col("p"), F.col("y"), CLASSES)).alias("value")),
}


@query("x4_metrics", f"WITH {PRED_CTE} SELECT 'accuracy' AS metric, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS value FROM pred UNION ALL SELECT 'macro_f1', avg(f1) FROM ({report_sql('pred')}) UNION ALL SELECT 'brier', avg(list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i - 1 = y THEN 1 ELSE 0 END) * (x - CASE WHEN i - 1 = y THEN 1 ELSE 0 END)))) FROM pred", "value")
def every_metric(spark, sf):
    """Every metric of the registry, by its name."""
    values = [f(head(spark, sf)).select(F.lit(name).alias("metric"), "value") for name, f in METRICS.items()]
    return values[0].unionByName(values[1]).unionByName(values[2])


@query("x4_metric_by_name", f"WITH {PRED_CTE} SELECT avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS value FROM pred", "value")
def metric_by_name(spark, sf):
    return METRICS["accuracy"](head(spark, sf))
