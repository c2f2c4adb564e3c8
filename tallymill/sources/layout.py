"""Tables laid out so that filters on several columns read few files.

Rows are ordered along a Z-curve: each column's value becomes its rank among equal parts of the column, the ranks' bits are interleaved, and
the table is written in ranges of that number. A zone map holds each file's least and greatest values; a read with ranges of
columns opens only the files whose zones meet them. Nulls stand in a zone of their own and are counted, so a file of nulls alone is
opened only for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.ordered import cuts_below

#: Bits of a column's rank.
BITS = 8
ZONES = "_zones"


def z_value(ranks: list[Column], bits: int = BITS) -> Column:
    """The bits of several ranks, interleaved, the first column's first."""
    out = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for r in ranks:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(r.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")))
    return out


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int) -> None:
    """Writes df in `files` files along the Z-curve of the columns (numbers, dates or times), with its zone map."""
    if not 1 <= len(columns) * BITS <= 63:
        raise ValueError(f"{len(columns)} columns do not fit a curve of {BITS} bits each")
    parts = 1 << BITS
    cuts = df.agg(*[F.percentile_approx(c, [i / parts for i in range(1, parts)], 10 * parts).alias(f"cuts_{i}") for i, c in enumerate(columns)])
    ranks = [F.when(F.col(c).isNull(), 0).otherwise(cuts_below(F.col(f"cuts_{i}"), F.col(c))) for i, c in enumerate(columns)]
    placed = df.join(F.broadcast(cuts)).withColumn("z_order", z_value(ranks)).drop(*cuts.columns)  # cuts: one row
    placed.repartitionByRange(files, "z_order", *columns).sortWithinPartitions("z_order").drop("z_order").write.mode("errorifexists").parquet(path)
    zones = [F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(c) for c in columns]
    spark = df.sparkSession
    spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *zones).coalesce(1).write.parquet(f"{path}/{ZONES}")


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, a struct low, high, nulls for each column): as many rows as files."""
    return spark.read.parquet(f"{path}/{ZONES}")


def files_within(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """The files that can hold rows whose columns all lie in their ranges (low, high), ends included; None is no end."""
    z = zone_map(spark, path)
    for c, (low, high) in ranges.items():
        if low is not None:
            z = z.where(F.col(c)["high"] >= F.lit(low))
        if high is not None:
            z = z.where(F.col(c)["low"] <= F.lit(high))
    return sorted(r.file for r in z.select("file").collect())


def read_within(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows whose columns all lie in their ranges, from those files alone."""
    files = files_within(spark, path, ranges)
    whole = spark.read.parquet(path)
    df = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    for c, (low, high) in ranges.items():
        if low is not None:
            df = df.where(F.col(c) >= F.lit(low))
        if high is not None:
            df = df.where(F.col(c) <= F.lit(high))
    return df
