"""Even ranges of a 64-bit key, for orders over a whole table without one task that sees all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A null key orders before every other.
LOWEST = -(1 << 63)


def order_key(column: F.Column) -> F.Column:
    return F.coalesce(column.cast("long"), F.lit(LOWEST))


def bounds(df: DataFrame, key: F.Column, ranges: int) -> list[int]:
    """Up to ranges - 1 ascending keys that cut the rows into near-equal parts; as many values as ranges, whatever the rows."""
    if ranges < 2:
        return []
    cuts = df.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("p")).first().p
    return sorted(set(cuts or []))


def range_of(cuts: list[int]):
    """Column function: number of bounds at or below the key."""
    edge = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def f(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edge, key.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return f
