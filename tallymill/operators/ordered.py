"""Running sums and numbers over a whole table, without a task that sees all rows.

Rows are dealt to ranges of the key (or to hash parts, where any order will do); each part's sum of what lies before it is added to a
window inside the part. The only window over all parts has a row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.operators.components import checkpoint_dir

#: Hash parts of numbered: fixed, so that numbers do not depend on the session's shuffle width.
PARTS = 1024


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of other, one row for each key; null keys meet."""
    there = other.select(*[F.col(k).alias(f"there_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"there_{k}")) for k in keys]
    return df.join(there, on).drop(*[f"there_{k}" for k in keys])


def cuts_below(cuts: Column, key: Column) -> Column:
    """How many of the ascending values in the array are at or below the key, by halving: as many steps as the array's size has bits."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(cuts).cast("long"))))

    def halve(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        at = F.get(cuts, mid) <= key
        return F.struct(F.when(at & (a["lo"] < a["hi"]), mid + 1).otherwise(a["lo"]).alias("lo"), F.when(~at & (a["lo"] < a["hi"]), mid).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve, lambda a: a["lo"])


def running_sums(df: DataFrame, key: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df, of one row for each key within by, with a column for each of sums: the named column's sum from the first key to this one.

    key: a number, a date or a time. Nulls come first, and last when descending. An empty table stays empty. df is read for the bounds of
    the ranges, for their sums and for the windows, so it is checkpointed first.
    """
    by = list(by or [])
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts).alias("running_cuts"))
    part = F.when(F.col(key).isNull(), -1).otherwise(cuts_below(F.col("running_cuts"), F.col(key)))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("running_part", part).drop("running_cuts")  # cuts: one row
    turn = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    earlier = W.partitionBy(*by).orderBy(turn("running_part")).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(*by, "running_part").agg(*[F.sum(c).alias(f"part_{new}") for new, c in sums.items()])
    before = totals.select(*by, "running_part", *[F.coalesce(F.sum(f"part_{new}").over(earlier), F.lit(0)).alias(f"before_{new}") for new in sums])
    inside = W.partitionBy(*by, "running_part").orderBy(turn(key)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _beside(placed, before, [*by, "running_part"])
    return out.withColumns({new: F.col(f"before_{new}") + F.sum(c).over(inside) for new, c in sums.items()}).drop("running_part", *[f"before_{new}" for new in sums])


def numbered(df: DataFrame, by: str, order: str, name: str = "number") -> DataFrame:
    """df with numbers from 0 without gaps within by, in an order that depends on the distinct values of order alone."""
    placed = df.withColumn("number_part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    earlier = W.partitionBy(by).orderBy("number_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy(by, "number_part").agg(F.count("*").alias("n")).select(by, "number_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(by, "number_part").orderBy(order))
    return _beside(placed.withColumn("inside", inside), before, [by, "number_part"]).withColumn(name, (F.col("before") + F.col("inside") - 1).cast("long")).drop("number_part", "inside", "before")
