import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.sources import npy
from tallymill.sources.files import InvalidInput


def frame(spark, n, width=8, first=0):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)).astype("f4")
    return x, spark.createDataFrame([(i + first, x[i].tolist()) for i in range(n)], "i long, v array<float>")


def back(df):
    rows = df.orderBy(df.columns[0]).collect()
    assert [r[0] for r in rows] == list(range(len(rows)))
    return np.array([r[1] for r in rows])


def test_arrays_of_numpy_are_read_in_ranges(spark, tmp_path):
    for dtype in ("f4", "f8", "i4", "i8"):
        x = (np.random.default_rng(1).normal(size=(1000, 7)) * 100).astype(dtype)
        np.save(tmp_path / f"{dtype}.npy", x)
        df = npy.read_npy(spark, str(tmp_path / f"{dtype}.npy"), rows=130)
        assert df.rdd.getNumPartitions() == 8 and (back(df) == x).all()
    np.save(tmp_path / "one.npy", np.arange(50) * 3)
    assert (back(npy.read_npy(spark, f"file:{tmp_path}/one.npy", 20)) == np.arange(50) * 3).all()
    np.save(tmp_path / "ids.npy", np.array(["b", "日本", "a"]))
    assert [tuple(r) for r in npy.read_ids(spark, f"file://{tmp_path}/ids.npy").orderBy("position").collect()] == [(0, "b"), (1, "日本"), (2, "a")]
    np.save(tmp_path / "none.npy", np.empty((0, 5), dtype="f4"))
    assert npy.read_npy(spark, str(tmp_path / "none.npy")).count() == 0


def test_filters_choose_ranges(spark, tmp_path, capsys):
    x, _ = frame(spark, 1000)
    np.save(tmp_path / "x.npy", x)
    df = npy.read_npy(spark, str(tmp_path / "x.npy"), rows=100)
    for test, want in {
        "embedding_index >= 250 and embedding_index < 460": (range(250, 460), 3),
        "embedding_index = 77": ([77], 1),
        "embedding_index > 990": (range(991, 1000), 1),
        "embedding_index <= 5": (range(6), 1),
        "embedding_index in (3, 905)": ([3, 905], 10),
        "embedding_index > 2000": ([], 1),
        "size(vector) = 8 and embedding_index > 898": (range(899, 1000), 2),
    }.items():
        got = df.where(test)
        assert sorted(r[0] for r in got.collect()) == list(want[0]) and got.rdd.getNumPartitions() == want[1]
    df.where("embedding_index > 990").explain()
    plan = capsys.readouterr().out
    assert "embedding_index" in plan and "Filter (" not in plan  # nothing is left to Spark


def test_written_arrays_equal_numpys(spark, tmp_path):
    x, df = frame(spark, 1050)
    report = npy.write_npy(df.repartition(7), f"file://{tmp_path}/out", "i", "v", rows=200)
    assert sorted(map(tuple, report.collect())) == [(p, 200 if p < 5 else 50, True) for p in range(6)]
    files = sorted(f for f in os.listdir(tmp_path / "out") if not f.startswith("."))
    assert len(files) == 6 and (np.concatenate([np.load(tmp_path / "out" / f) for f in files]) == x).all()
    assert (back(npy.read_npy(spark, f"{tmp_path}/out", rows=70)) == x).all()
    texts = spark.createDataFrame([(i, f"id {i} é") for i in range(30)], "i long, t string")
    npy.write_npy(texts, f"{tmp_path}/texts", "i", "t", rows=8)
    assert [r.id for r in npy.read_ids(spark, f"{tmp_path}/texts").orderBy("position").collect()] == [f"id {i} é" for i in range(30)]


def test_a_stopped_run_goes_on_without_doubles(spark, tmp_path):
    x, df = frame(spark, 1000)
    path = f"{tmp_path}/out"
    # The fourth part can't be written: what other tasks finished stays, nothing half written does.
    broken = df.withColumn("v", F.when(F.col("i") == 350, F.slice("v", 1, 3)).otherwise(F.col("v")))
    with pytest.raises(Exception, match="components"):
        npy.write_npy(broken, path, "i", "v", rows=100)
    left = [f for f in os.listdir(path) if f.endswith(".npy")]
    assert not any(f.startswith(("_", "rows-000000000000300")) for f in os.listdir(path))
    times = {f: os.stat(f"{path}/{f}").st_mtime_ns for f in left}
    report = {r.part: r.written for r in npy.write_npy(df, path, "i", "v", rows=100).collect()}
    assert sum(report.values()) == 10 - len(left) and report[3]
    assert {f: os.stat(f"{path}/{f}").st_mtime_ns for f in left} == times and (back(npy.read_npy(spark, path)) == x).all()
    assert not any(r.written for r in npy.write_npy(df, path, "i", "v", rows=100).collect())


def test_grown_and_damaged_parts_are_written_anew(spark, tmp_path):
    path = f"{tmp_path}/out"
    x, df = frame(spark, 250)
    npy.write_npy(df.where("i < 120"), path, "i", "v", rows=100)
    first = sorted(os.listdir(path))[0]
    with open(f"{path}/{first}", "r+b") as f:
        f.truncate(500)
    report = {r.part: r.written for r in npy.write_npy(df, path, "i", "v", rows=100).collect()}
    assert report == {0: True, 1: True, 2: True} and (back(npy.read_npy(spark, path)) == x).all()


def test_what_is_no_array_is_an_error(spark, tmp_path):
    def fails(name, match):
        with pytest.raises(Exception, match=match):
            npy.read_npy(spark, str(tmp_path / name)).collect()

    (tmp_path / "a.npy").write_bytes(b"no array at all, but long enough for a header")
    fails("a.npy", "not an array")
    np.save(tmp_path / "b.npy", np.zeros((10, 4), dtype="f4"))
    whole = (tmp_path / "b.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(whole[:-1])
    (tmp_path / "long.npy").write_bytes(whole + b"x")
    fails("short.npy", "bytes where")
    fails("long.npy", "bytes where")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.zeros((10, 4))))
    np.save(tmp_path / "c.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "d.npy", np.zeros(3, dtype=">f4"))
    np.save(tmp_path / "o.npy", np.array([{}, None], dtype=object))
    for name in ("f.npy", "c.npy", "d.npy", "o.npy"):
        fails(name, "needs one or two|not an array")
    (tmp_path / "gap").mkdir()
    np.save(tmp_path / "gap" / "rows-0-10.npy", np.zeros((10, 4), dtype="f4"))
    np.save(tmp_path / "gap" / "rows-11-12.npy", np.zeros((1, 4), dtype="f4"))
    fails("gap", "go on")
    (tmp_path / "empty").mkdir()
    fails("empty", "no part files")
    for ids in (["a", "a"], ["a", " "]):
        np.save(tmp_path / "ids.npy", np.array(ids))
        with pytest.raises(InvalidInput):
            npy.read_ids(spark, str(tmp_path / "ids.npy"))


def test_indexes_must_be_whole(spark, tmp_path):
    _, df = frame(spark, 300)
    for k, bad in enumerate((df.union(df.where("i = 5")), df.where("i != 5"), df.where("i >= 5"), df.withColumn("v", F.when(F.col("i") != 5, F.col("v"))))):
        with pytest.raises(Exception, match="repeat|null"):
            npy.write_npy(bad, f"{tmp_path}/{k}", "i", "v", rows=100)
