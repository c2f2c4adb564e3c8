"""Queries through array files and paged registries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallymill.functions import images as I
from tallymill.functions import text as T
from tallymill.operators.ordered import running_sums
from tallymill.plans.registry import query, table
from tallymill.plans.scans import _folder
from tallymill.plans.store import _AG, agencies
from tallymill.sources import files as S
from tallymill.sources import npy, paged


def indexed(df, key: str):
    """Rows with their place in the order of a unique key, from 0."""
    return running_sums(df.withColumn("one", F.lit(1).cast("long")), key, {"place": "one"}).withColumn("place", F.col("place") - 1).drop("one")


@query("s5_npy_scan", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS embedding_index, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings", arrays="vector")
def npy_scan(spark, sf):
    path = _folder(spark, "vectors")
    npy.write_npy(indexed(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id"), path, "place", "embedding", rows=4096)
    return npy.read_npy(spark, path, rows=1024).select("embedding_index", F.col("vector").cast("array<double>").alias("vector"))


@query("s5_npy_range", "SELECT i AS embedding_index, CAST(embedding[1] AS DOUBLE) AS head FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding FROM embeddings) WHERE i >= 70 AND i < 300", "head")
def npy_range(spark, sf):
    # The comparison prunes ranges before any is read.
    path = _folder(spark, "vectors")
    npy.write_npy(indexed(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id"), path, "place", "embedding", rows=64)
    return npy.read_npy(spark, path, rows=64).where("embedding_index >= 70 and embedding_index < 300").select("embedding_index", F.get("vector", F.lit(0)).cast("double").alias("head"))


@query("s4_npy_ids", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_name AS id FROM customer")
def npy_ids(spark, sf):
    path = _folder(spark, "ids")
    npy.write_npy(indexed(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey"), path, "place", "c_name")
    return npy.read_ids(spark, path)


@query("s18_resumed_sink", "SELECT i // 100 AS part, count(*) AS rows, i // 100 % 2 = 1 AS written FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) GROUP BY ALL")
def resumed_sink(spark, sf):
    # A run that stopped after every other part, and the one that goes on from there.
    path, rows = _folder(spark, "resumed"), indexed(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    npy.write_npy(rows.where("place div 100 % 2 = 0"), path, "place", "embedding", rows=100)
    return npy.write_npy(rows, path, "place", "embedding", rows=100)


@query("s7_paged_scan", f"WITH {_AG} SELECT CAST(agency_id AS VARCHAR) AS id, name, category, latitude, active OR agency_id % 4 = 0 AS is_active FROM ag WHERE agency_id % 11 <> 0 AND latitude > -6.3", "latitude")
def paged_scan(spark, sf):
    a = agencies(spark, sf)
    k = F.col("agency_id")
    rows = a.select(k.cast("string").alias("id"), "name", "category", F.when(k % 11 != 0, F.col("latitude")).alias("latitude"), "longitude", F.when(k % 4 != 0, F.col("active")).alias("is_active"))
    path = _folder(spark, "registry")
    paged.write_pages(rows, path, ["latitude", "id"], rows=50)
    return paged.agencies(spark, path, T.SLUGS).where("latitude > -6.3").select("id", "name", "category", "latitude", "is_active")


_PIX = "list_transform(list_concat(embedding, list_slice(embedding, 1, 8)), lambda x: greatest(0, least(255, CAST(floor(CAST(x AS DOUBLE) * 64) AS INTEGER) + 128)))"


def pictures(spark, sf):
    """Vectors as PNG files of 9 x 8 grey pixels, every row by another filter; every seventh file is damaged, every eleventh is none."""

    def run(it):
        for pdf in it:
            files = []
            for k, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                data = I.encode_png(np.clip(np.floor(np.asarray(v, dtype="f8") * 64).astype(int) + 128, 0, 255).reshape(8, 9, 1), [k % 5, 4, 3, 1, 2])
                files.append(None if k % 11 == 0 else data[:-20] if k % 7 == 0 else data)
            yield pdf[["vec_id"]].assign(content=files)

    e = table(spark, sf, "embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 8)).alias("v"))
    return e.mapInPandas(run, "vec_id long, content binary")


@query("v20_png_codes", f"""SELECT vec_id, CASE WHEN vec_id % 11 <> 0 AND vec_id % 7 <> 0 THEN list_reduce(list_transform(range(0, 64), lambda k: CASE WHEN g[k // 8 * 9 + k % 8 + 2] > g[k // 8 * 9 + k % 8 + 1] THEN CASE WHEN k = 63 THEN -9223372036854775808 ELSE 1::BIGINT << k END ELSE 0::BIGINT END), lambda a, b: a | b) END AS code,
CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'unreadable' END AS problem FROM (SELECT vec_id, {_PIX} AS g FROM embeddings)""")
def png_codes(spark, sf):
    return S.image_facts(pictures(spark, sf), "content", ["vec_id"]).select("vec_id", "code", "problem")
