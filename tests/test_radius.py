"""The stored radius index over codes that use few of their bits."""

import random

from tallymill.operators.radius import RadiusIndex, dealt


def test_bits_that_are_all_alike_make_no_band(spark, tmp_path):
    """Codes of 40 bits: the upper 24 are zero, so a band of those alone would hold every code at one value."""
    r = random.Random(3)
    codes = sorted({r.getrandbits(40) for _ in range(20_000)})
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    index = RadiusIndex(spark, f"{tmp_path}/i").build(df, "id", "code")
    queries = spark.createDataFrame([(i, c ^ 0b1001 << 38) for i, c in enumerate(codes[:200])], "id long, code long")  # one bit beyond those of the codes
    assert index.candidates(queries, "id", "code", 5).count() < 200 * len(codes) / 10
    got = sorted(map(tuple, RadiusIndex(spark, f"{tmp_path}/i").matches(queries, "id", "code", 5).collect()))  # opened again
    assert got == sorted((q, i, d) for q, a in enumerate(codes[:200]) for i, c in enumerate(codes) if (d := (a ^ 0b1001 << 38 ^ c).bit_count()) <= 5) and len(got) >= 200


def test_queries_and_rows_of_one_code(spark, tmp_path):
    df = spark.createDataFrame([(i, 7) for i in range(30)] + [(99, 6), (100, 1 << 40 | 0b11000)], "id long, code long")
    index = RadiusIndex(spark, f"{tmp_path}/i").build(df, "id", "code")
    assert index.matches(df.where("code = 7"), "id", "code", 5).count() == 30 * 31


def test_no_codes_and_one_code(spark, tmp_path):
    empty = RadiusIndex(spark, f"{tmp_path}/e").build(spark.createDataFrame([], "id long, code long"), "id", "code")
    one = RadiusIndex(spark, f"{tmp_path}/o").build(spark.createDataFrame([(1, -1)], "id long, code long"), "id", "code")
    queries = spark.createDataFrame([(1, -1), (2, -4), (3, 0)], "id long, code long")
    assert empty.matches(queries, "id", "code", 5).count() == 0
    assert sorted(map(tuple, one.matches(queries, "id", "code", 5).collect())) == [(1, 1, 0), (2, 1, 2)]


def test_bands_tell_alike():
    masks = dealt([0.5] * 51 + [0.0] * 13, 3_302_100)
    assert [m.bit_count() for m in masks] == [17, 17, 17] and sum(masks) == (1 << 51) - 1
    assert len(dealt([0.5] * 64, 20_000)) == 4 and len(dealt([0.5] * 20 + [0.0] * 44, 10**9)) == 2
