"""Rounded results equal those of SQL to the last bit, the sign of a zero too."""

import math
import random
import struct

import duckdb
import pytest

from tallymill.plans import QUERIES, SQL
from tallymill.plans.registry import rounded


def bits(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else struct.pack(">d", v)
    return [bits(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_signs_of_zeros_and_odd_values(spark):
    some = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, -4.9e-7, 0.0078125, -0.0078125, 123456.7890125, -1e300, math.inf, -math.inf, math.nan, None]
    got = rounded(spark.createDataFrame([(i, x, [x, None]) for i, x in enumerate(some)], "i int, x double, v array<double>")).orderBy("i").collect()
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in some]
    assert [bits(r.x) for r in got] == [bits(x) for x in want] and [bits(r.v) for r in got] == [[bits(x), None] for x in want]


@pytest.mark.parametrize("name", ["s5_npy_scan", "v2_early_fusion", "v4_mean_pool", "j3_two_gathers"])
def test_vectors_with_tiny_negative_values(spark, tmp_path, name):
    r = random.Random(5)
    rows = [(i, [r.choice([r.gauss(0, 0.1), -1e-7, -2.5e-7, 1e-7]) for _ in range(64)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cur = con.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(bits([r[c] for c in have]) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(bits(x) for x in map(list, cur.fetchall()))
