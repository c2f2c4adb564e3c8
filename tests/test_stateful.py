"""Operators with state against plain versions; a query starts anew from its checkpoint for each batch."""

import datetime
import random

from pyspark.sql import functions as F

from tallymill.streaming import live
from tallymill.streaming import stateful as S


def batches(spark, tmp_path, rows_of, schema, operator):
    """What comes out of each batch, each by a query started anew."""
    out = []
    for k, rows in enumerate(rows_of):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        S.run_to_end(operator(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
        every = spark.read.parquet(f"{tmp_path}/out").collect()
        out.append([tuple(r) for r in every if tuple(r) not in {x for o in out for x in o}])
    return out


CHANGES = "id long, version long, status string, place string"


def test_changes_with_late_versions_and_nulls(spark, tmp_path):
    rows = [
        [(1, 1, "a", None), (1, 2, "a", None), (1, 3, "b", None), (2, 5, None, "x"), (None, 1, "n", None)],
        [(1, 2, "late", "late"), (1, 4, "b", "y"), (2, 5, "same", "same"), (2, 6, None, "x"), (3, 1, "c", None)],
        [(1, 9, "b", "y"), (1, 8, "c", None), (None, 2, "n", None)],
    ]
    got = batches(spark, tmp_path, rows, CHANGES, lambda s: S.changes(s, "id", ["version"], ["status", "place"]))
    # As the window over state and batch finds them.
    state = spark.createDataFrame([], CHANGES)
    for r, g in zip(rows, got, strict=True):
        batch = spark.createDataFrame(r, CHANGES)
        want = live.row_changes(state, batch, "id", ["version"], ["status", "place"]).collect()
        assert sorted(g, key=str) == sorted(map(tuple, want), key=str)
        state = live.newest(state.unionByName(batch), "id", ["version"])
    assert [x[:3] for x in got[2]] == [(1, 8, "update"), (1, 9, "update")]


def test_assignments_against_whole_histories(spark, tmp_path):
    r = random.Random(3)
    versions = [(i % 7, i, r.choice([None, " ", "a", "b", "b"])) for i in range(120)]
    parts = [versions[:50], versions[50:80], versions[80:]]
    got = batches(spark, tmp_path, parts, "report long, version long, agency string", lambda s: S.assignment_events(s, "report", "version", "agency"))
    events = spark.createDataFrame([e for g in got for e in g], "report long, version long, agency string, status string")
    now = sorted(map(tuple, S.assignment_state(events, "report", "version", "agency").collect()))
    want = []
    for report in range(7):
        before, mine = "never", []
        for _, v, a in (x for x in versions if x[0] == report):
            a = None if a is None or not a.strip() else a
            if a != before:
                mine.append([report, v, a, "superseded"])
            before = a
        if mine:
            mine[-1][3] = "active"
        want += [tuple(m) for m in mine if m[2] is not None]
    assert now == sorted(want)


def test_evidence_comes_once(spark, tmp_path):
    url = lambda x: f"https://x/storage/v1/object/public/report-images/{x}.jpg"
    rows = [[(1, url("a"), None), (1, url("b"), url("a")), (2, "no address", " ")], [(1, url("a"), url("a")), (1, url("c"), None), (3, None, url("d"))]]
    got = batches(spark, tmp_path, rows, "id long, image_url string, resolution_url string", S.evidence_events)
    path = lambda g: sorted((r[0], r[1], r[3]) for r in g)
    assert path(got[0]) == [(1, "initial", "a.jpg"), (1, "initial", "b.jpg"), (1, "resolution", "a.jpg")]
    assert path(got[1]) == [(1, "initial", "c.jpg"), (3, "resolution", "d.jpg")]


def test_lookups_expire(spark, tmp_path):
    r, start = random.Random(9), datetime.datetime(2024, 1, 1)
    at = sorted(start + datetime.timedelta(seconds=r.randrange(40_000), microseconds=r.randrange(10**6)) for _ in range(150))
    rows = [(f"u{r.randrange(4)}", t, i) for i, t in enumerate(at)]
    rows += [("edge", start, 900), ("edge", start + datetime.timedelta(seconds=3540), 901), ("edge", start + datetime.timedelta(seconds=7079, microseconds=999_999), 902)]
    rows.sort(key=lambda x: (x[1], x[2]))
    df = spark.createDataFrame(rows, "key string, at timestamp, mark long")
    got = S.in_turns(df, F.unix_micros("at"), 4, f"{tmp_path}/r", lambda s: S.expiring_lookups(s, "key", "at", "mark")).collect()
    until, want = {}, {}
    for k, t, m in rows:
        hit = k in until and until[k] > t
        if not hit:
            until[k] = t + datetime.timedelta(seconds=3540)
        want[m] = (k, t, hit, until[k])
    assert {g.mark: (g.key, g["at"], g.hit, g.expires) for g in got} == want and len(got) == len(rows)
    assert [want[m][2] for m in (900, 901, 902)] == [False, False, True]
    # Turns end inside entries that still hold, so state crossed from one query to the next.
    assert sum(g.hit for g in got) > 20
