"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _round(x: Column, digits: int) -> Column:
    """Rounded half away from zero as SQL does, which keeps the sign of what becomes zero; Spark's round alone gives 0.0 for it."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, as results are compared by value."""
    return df.select(*[_round(F.col(c), digits).alias(c) if kind == "double" else F.transform(c, lambda x: _round(x, digits)).alias(c) if kind == "array<double>" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = "", arrays: str = ""):
    """Registers a query; doubles and arrays: columns of the SQL that are rounded like the query's."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            swaps = [f"round({c}, 6) AS {c}" for c in doubles.split()] + [f"list_transform({c}, lambda x: round(x, 6)) AS {c}" for c in arrays.split()]
            SQL[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql})" if swaps else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
