"""Verified pairs of many rows that share few sets, against a plain comparison."""

import random

from pyspark.sql import functions as F

from tallymill.operators import tables
from tallymill.plans import QUERIES


def test_pairs_against_all_sets(spark):
    r = random.Random(6)
    kinds = [sorted({r.choice("abcdefgh") for _ in range(r.randrange(7))}) for _ in range(12)] + [["a"], []]
    sets = [(i, r.choice(kinds) if i % 17 else None) for i in range(120)] + [(5, ["z"]), (None, ["a"])]
    pairs = [(r.randrange(125), r.randrange(125)) for _ in range(600)] + [(None, 1), (3, None)]
    like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 1.0
    got = tables.verified_pairs(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sets, "id long, s array<string>"), "id", "s", 0.4)
    want = [(a, b, v) for a, b in pairs for i, x in sets for k, y in sets if a is not None and a == i and b is not None and b == k and x is not None and y is not None and (v := like(x, y)) >= 0.4]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["a", "b", "likeness"]


def test_sets_are_not_broadcast(spark):
    """The parts' sets take many times the room of their file, by whose size Spark would broadcast them."""
    plan = QUERIES["j6_verified"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x]
    assert all("BroadcastHashJoin [ha#" in x for x in joins) and plan.count("SortMergeJoin") >= 6  # pairs of codes may be few


def test_equal_sets_are_verified_once(spark, monkeypatch):
    met = spark.sparkContext.accumulator(0)

    def counted(a, b, plain=tables.T.jaccard):
        def one(x):
            met.add(1)
            return x

        return F.udf(one, "double")(plain(a, b))

    monkeypatch.setattr(tables.T, "jaccard", counted)
    sets = spark.range(400).select("id", F.array(F.lit("x"), (F.col("id") % 2).cast("string")).alias("s"))
    pairs = spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert tables.verified_pairs(pairs, sets, "id", "s", 0.2).count() == 399 and 0 < met.value <= 8
