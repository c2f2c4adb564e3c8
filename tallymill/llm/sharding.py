"""Sharding by jump consistent hashing: a key's shard follows from the key and the number of shards alone, and one more shard
takes rows only into itself.

Null ids go where the lowest 64-bit key goes. Slots count up from 0 in each shard in order of id (null first), text CRC and
size; repeated rows get a slot each. A null text has no bytes; a text of any length counts whole. An empty table gives no rows. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.llm.ranges import bounds, order_key, range_of
from tallymill.llm.runtime import partitions

U = np.uint64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: its last jump below the number of shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(U)
    shard = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    target = np.zeros(len(key), dtype=np.int64)
    while len(live):
        shard[live] = target[live]
        key[live] = key[live] * U(2862933555777941757) + U(1)
        target[live] = ((shard[live] + 1) * (float(1 << 31) / ((key[live] >> U(33)) + U(1)).astype(np.float64))).astype(np.int64)
        live = live[target[live] < shards]
    return shard


def shard_of(shards: int):
    @F.pandas_udf("int")
    def f(key: pd.Series) -> pd.Series:
        return pd.Series(jump(key.to_numpy(dtype=np.int64).view(U), shards).astype(np.int32))

    return f


def shard_rows(docs: DataFrame, *, shards: int = 24, id_column: str = "doc_id", text_column: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) for each row; size is the text's UTF-8 bytes and the overhead."""
    body = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    keys = docs.select(order_key(F.col(id_column)).alias("key"))
    part = range_of(bounds(keys, F.col("key"), 4 * partitions(docs.sparkSession)))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), order_key(F.col(id_column)).alias("key"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.select("*", shard_of(shards)("key").alias("shard"), shard_of(shards + 1)("key").alias("grown_shard"), part("key").alias("part"))
    # A slot is the rank in the shard's part of the key's range, after the rows of lower ranges.
    count = keys.select(shard_of(shards)("key").alias("shard"), part("key").alias("part")).groupBy("shard", "part").count()
    below = count.select("shard", "part", F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("key", "text_crc32", "size"))
    out = rows.withColumn("rank", rank).join(below, ["shard", "part"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("below") + F.col("rank") - 1).alias("slot"), "grown_shard")
