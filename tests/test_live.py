"""Live tables that write only what changes, and lists kept from batch to batch, against recomputation."""

import random

from pyspark.sql import functions as F

from tallymill.streaming.live import LiveTable, TopView, newest

SCHEMA = "id long, sequence long, status string, created_at timestamp"


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, sequence long, status string, at long").select("id", "sequence", "status", F.timestamp_seconds("at").alias("created_at"))


def listed(df, limit, ascending=False):
    rows = df.where("status <> 'rejected' and created_at is not null").orderBy(F.asc("created_at") if ascending else F.desc("created_at"), "id").limit(limit).collect()
    return [(r.id, r.sequence) for r in rows]


def test_lists_equal_recomputation_after_each_batch(spark, tmp_path):
    r = random.Random(5)
    live = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=4)
    view = TopView(live, f"file://{tmp_path}/view", lambda: F.col("status") != "rejected", limit=6, spare=3)
    oldest = TopView(live, f"file://{tmp_path}/oldest", lambda: F.col("status") != "rejected", limit=5, spare=2, ascending=True)
    every, n = [], 0
    for number in range(7):
        rows = []
        for _ in range(r.choice([0, 3, 12, 25])):
            n += 1
            late = r.random() < 0.2
            rows.append((r.randrange(40), n - 60 * late, r.choice(["ok", "rejected", "ok"]), None if r.random() < 0.05 else r.randrange(50)))
        if number == 6:  # the whole list goes
            rows = [(x.id, 900, "rejected", 10) for x in view.read().collect()]
        every += rows
        won = live.merge(frame(spark, rows), number)
        view.apply(won, number)
        oldest.apply(won, number)
        want = newest(frame(spark, every), "id", ["sequence"])
        assert sorted(map(tuple, live.read().collect())) == sorted(map(tuple, want.collect()))
        assert [(x.id, x.sequence) for x in view.read().collect()] == listed(want, 6)
        assert [(x.id, x.sequence) for x in oldest.read().collect()] == listed(want, 5, ascending=True)
    assert view.refills == 1


def test_only_changed_rows_are_written_and_read(spark, tmp_path):
    live = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=4)
    view = TopView(live, f"file://{tmp_path}/view", limit=20, spare=10)
    view.apply(live.merge(frame(spark, [(i, 1, "a", i) for i in range(5000)]), 0), 0)
    before = view.reads
    for number in range(1, 6):
        won = live.merge(frame(spark, [(5000 - number, 2, "b", 6000 + number), (7, 0, "late", 9999)]), number)
        assert won.count() == 1 and spark.read.parquet(f"{tmp_path}/state/batch-{number}").count() == 1
        view.apply(won, number)
    assert view.reads - before <= 5 * (30 + 1) and view.refills == 0
    assert [x.id for x in view.read().limit(3).collect()] == [4995, 4996, 4997] and live.read().count() == 5000
    # A batch that comes again changes nothing; one that the list missed is made good.
    assert live.merge(frame(spark, [(1, 9, "c", 1)]), 5) is None
    live.merge(frame(spark, [(1, 9, "c", 9000)]), 6)
    view.apply(live.merge(frame(spark, [(2, 9, "c", 9001)]), 7), 7)
    assert [x.id for x in view.read().limit(2).collect()] == [2, 1] and view.refills == 1


def test_buckets_are_compacted(spark, tmp_path):
    live = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=2)
    for number in range(8):
        live.merge(frame(spark, [(i, number, f"v{number}", 1) for i in range(10)]), number)
    files = live._pointer()["at"]
    assert all(len(f) <= 2 for f in files.values()) and {r.status for r in live.read().collect()} == {"v7"} and live.read().count() == 10


def test_views_follow_a_stream(spark, tmp_path):
    live = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=4)
    view = TopView(live, f"file://{tmp_path}/view", limit=3, spare=1)
    for k in range(3):
        frame(spark, [(i, k, "x", (i * 7 + k * 5) % 11) for i in range(k, 8)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.follow(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/check", views=[view]).awaitTermination()
        want = live.read().orderBy(F.desc("created_at"), "id").limit(3).collect()
        assert view.read().collect() == want
