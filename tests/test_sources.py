import json

import pytest
from pyspark.sql import functions as F

from tallymill.sources import files as S
from tallymill.streaming.live import LiveTable, latest, of_category, of_user


def test_typed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("row_id,label_id\n1,0\n2,7\n")
    rules = {"label in range": F.col("label_id").between(0, 8)}
    assert S.typed_csv(spark, str(tmp_path / "a.csv"), "row_id long, label_id int", "row_id", rules).count() == 2
    with pytest.raises(S.InvalidInput):
        S.typed_csv(spark, str(tmp_path / "a.csv"), "row_id long, label_id int", "row_id", {"small": F.col("label_id") < 5})


def test_text_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿label,support\nx,3\n".encode())
    df = S.metric_report(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["label", "support"] and df.first().support == 3
    (tmp_path / "b.csv").write_text("label,support\n")
    with pytest.raises(S.InvalidInput):
        S.text_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("label,support\nx,3\nx,4\n")
    with pytest.raises(S.InvalidInput):
        S.metric_report(spark, str(tmp_path / "c.csv"))


def test_ordered_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\nb,1\na,2\n")
    (tmp_path / "a.json").write_text('["b", "a"]')
    (tmp_path / "a.txt").write_text("b\na\n")
    for kind in ("csv", "json", "txt"):
        assert [(r.position, r.id) for r in S.ordered_ids(spark, str(tmp_path / f"a.{kind}")).orderBy("position").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "b.txt").write_text("b\nb\n")
    with pytest.raises(S.InvalidInput):
        S.ordered_ids(spark, str(tmp_path / "b.txt"))


def test_manifest_seed_and_images(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"rows": 3, "dtype": "float32"}')
    assert S.manifest(spark, str(tmp_path / "m.json"), "rows long, dtype string").first().rows == 3
    sites = [{"id": 1, "name": "a", "category": "x", "latitude": -6.0, "longitude": 106.0, "is_active": True}, {"id": 2, "name": "b", "category": "x", "latitude": None, "longitude": 1.0, "is_active": True}]
    (tmp_path / "s.json").write_text(json.dumps(sites))
    assert [r.id for r in S.seed_agencies(spark, str(tmp_path / "s.json")).collect()] == [1]
    (tmp_path / "i.bin").write_bytes(b"abc")
    assert S.images(spark, str(tmp_path / "i.bin")).first().sha256 == S.file_record(str(tmp_path / "i.bin"))["sha256"]


def test_sinks(spark, tmp_path):
    S.write_json(str(tmp_path / "o.json"), {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": "é", "b": 1}
    S.create_once(str(tmp_path / "mark"), {"run": 1})
    with pytest.raises(FileExistsError):
        S.create_once(str(tmp_path / "mark"), {"run": 1})
    assert S.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and len(S.canonical_digest([1])) == 64
    df = spark.createDataFrame([(1, 1 / 3, "train"), (2, 0.5, "val")], "id long, p double, split string")
    S.write_predictions(df, str(tmp_path / "p"))
    assert {r.p for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()} == {"0.3333333333", "0.5"}
    S.write_splits(df, str(tmp_path / "s"))
    assert S.embeddings(spark, str(tmp_path / "s")).where("split = 'val'").count() == 1
    with pytest.raises(Exception, match="exist"):
        S.write_splits(df, str(tmp_path / "s"))


SCHEMA = "id long, sequence long, user_id string, category string, status string, created_at timestamp"


def test_live_table(spark, tmp_path):
    feed = tmp_path / "feed"

    def send(name, rows):
        spark.createDataFrame(rows, "id long, sequence long, user_id string, category string, status string, at string").withColumn("created_at", F.col("at").cast("timestamp")).drop("at").coalesce(1).write.parquet(str(feed / name))

    send("a", [(1, 1, "u", "x", "submitted", "2026-01-01"), (2, 1, "u", "x", "submitted", "2026-01-02"), (3, 1, "v", "y", "submitted", "2026-01-03")])
    live = LiveTable(spark, str(tmp_path / "state"), SCHEMA, "id", ["sequence"])
    seen = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(feed / "*"))
        q = live.follow(stream, str(tmp_path / "check"), then=lambda df: seen.append(df.count()))
        q.awaitTermination(120)

    run()
    send("b", [(1, 3, "u", "x", "rejected", "2026-01-01"), (1, 2, "u", "x", "verified", "2026-01-01"), (4, 1, "u", "x", "submitted", "2026-01-04")])
    run()
    assert [r.id for r in of_user(live.read(), "u").collect()] == [4, 2, 1]
    assert [r.id for r in of_category(live.read(), "x").collect()] == [4, 2]
    assert [r.id for r in latest(live.read(), 2).collect()] == [4, 3] and seen[-1] == 4
    before = live.read().collect()
    live.merge(live.read().limit(1), 0)
    assert live.read().collect() == before
