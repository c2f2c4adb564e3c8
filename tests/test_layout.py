"""Layouts that skip files, indexes that skip codes, markers that are set once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators.ordered import cuts_below
from tallymill.operators.radius import RadiusIndex
from tallymill.sources import files as S
from tallymill.sources import layout


def test_few_files_are_read(spark, tmp_path):
    r = random.Random(2)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, r.random() * 100 if r.random() > 0.02 else None, r.randrange(1000), start + datetime.timedelta(hours=r.randrange(5000))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, x double, n int, at timestamp")
    path = f"{tmp_path}/t"
    layout.write_clustered(df, path, ["x", "n", "at"], files=64)
    zones = layout.zone_map(spark, path).collect()
    assert sum(z.rows for z in zones) == 6000 and 50 <= len(zones) <= 64 and spark.read.parquet(path).count() == 6000
    for ranges in ({"x": (10, 20)}, {"n": (None, 50)}, {"x": (90, None), "n": (500, 560)}, {"at": (start, start + datetime.timedelta(days=10)), "x": (0, 30)}, {"x": (7.5, 7.5)}, {"x": (1000, None)}):
        got = layout.read_within(spark, path, ranges)
        want = df
        for c, (low, high) in ranges.items():
            want = want.where(F.lit(True) if low is None else F.col(c) >= F.lit(low)).where(F.lit(True) if high is None else F.col(c) <= F.lit(high))
        assert sorted(x.id for x in got.collect()) == sorted(x.id for x in want.collect())
        read = len(got.inputFiles()) if got.inputFiles() else 0
        assert read == len(layout.files_within(spark, path, ranges)) and read <= len(zones) * 0.6
    with pytest.raises(ValueError):
        layout.write_clustered(df, f"{tmp_path}/u", ["x"] * 9, 4)


def test_every_column_skips(spark, tmp_path):
    df = spark.range(4096).select((F.col("id") % 64).alias("a"), (F.col("id") / 64).cast("int").alias("b"))
    layout.write_clustered(df, f"{tmp_path}/t", ["a", "b"], files=64)
    for c in ("a", "b"):  # an eighth of each side: never more than half of the files
        assert len(layout.files_within(spark, f"{tmp_path}/t", {c: (8, 15)})) <= 32


def test_interleaving(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("a"), F.floor(F.col("id") / 16).alias("b"))
    for r in df.select("a", "b", layout.z_value([F.col("a"), F.col("b")], 4).alias("z")).collect():
        assert r.z == sum(((r.a >> k & 1) << 2 * k + 1) | ((r.b >> k & 1) << 2 * k) for k in range(4))


def test_cuts_are_found_by_halving(spark):
    cuts = sorted(random.Random(1).sample(range(1000), 137))
    df = spark.range(-5, 1005).select("id", F.array(*[F.lit(c) for c in cuts]).alias("c"), F.array().cast("array<int>").alias("none"))
    got = df.select("id", cuts_below(F.col("c"), F.col("id")).alias("n"), cuts_below(F.col("none"), F.col("id")).alias("z")).collect()
    assert all(r.n == sum(c <= r.id for c in cuts) and r.z == 0 for r in got)


@pytest.mark.parametrize("bands,radius", [(4, 0), (4, 3), (4, 5), (8, 5), (2, 3), (4, 11)])
def test_searches_against_all_pairs(spark, tmp_path, bands, radius):
    r = random.Random(bands * 10 + radius)
    base = [r.getrandbits(64) for _ in range(60)]
    codes = base + [c ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, radius + 4))) for c in base for _ in range(3)] + base[:10] + [0, 2**64 - 1]
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(i, signed(c)) for i, c in enumerate(codes)] + [(999, None)], "id long, code long")
    queries = spark.createDataFrame([(i, signed(c)) for i, c in enumerate(base[:25] + [0, 1])] + [(77, None)], "q long, c long")
    index = RadiusIndex(spark, f"{tmp_path}/i", bands).build(df, "id", "code")
    got = sorted(map(tuple, index.matches(queries, "q", "c", radius).collect()))
    want = sorted((q, i, (a ^ c).bit_count()) for q, a in enumerate(base[:25] + [0, 1]) for i, c in enumerate(codes) if (a ^ c).bit_count() <= radius)
    assert got == want
    with pytest.raises(Exception, match="exist"):
        index.build(df, "id", "code")


def test_few_candidates_are_met(spark, tmp_path):
    r = random.Random(0)
    codes = [r.getrandbits(63) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(codes)) + [(10**6 + i, codes[0]) for i in range(5000)], "id long, code long")
    index = RadiusIndex(spark, f"{tmp_path}/i").build(df, "id", "code")
    queries = df.where("id < 200")
    assert index.postings().count() == 4 * 20_000  # one posting a band for a code, however many rows have it
    assert index.candidates(queries, "id", "code", 3).count() < 200 * 20_000 / 500
    assert index.matches(queries.where("id = 0"), "id", "code", 3).count() == 5001
    with pytest.raises(ValueError, match="bands"):
        index.matches(queries, "id", "code", 30)


def test_markers_and_files_on_any_file_system(spark, tmp_path):
    fs = spark._jvm.org.apache.hadoop.fs.Path("file:///").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/mark")
    S.create_file(fs, at, b"first")
    with pytest.raises(FileExistsError):
        S.create_file(fs, at, b"second")
    assert (tmp_path / "mark").read_bytes() == b"first"
    for text in (b"one", b"two"):
        S.replace_file(fs, at, text)
        assert (tmp_path / "mark").read_bytes() == text
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".mark.") and "crc" not in p.name]
    S.create_once(f"file:{tmp_path}/once", {"a": 1})
    with pytest.raises(FileExistsError):
        S.create_once(f"file://{tmp_path}/once", {"a": 1})
    S.write_json(f"file://{tmp_path}/j.json", [1])
    assert (tmp_path / "j.json").read_text() == "[\n  1\n]\n"
