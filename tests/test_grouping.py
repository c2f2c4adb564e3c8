"""What grouping moves: codes and digests, and the texts that have a candidate."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.functions import text as T
from tallymill.operators import tables

WORDS = "road lamp water tree park report street city river bridge night light stone wheel market garden".split()


def written(spark, run):
    """Bytes that run shuffles, by Spark's own count."""
    store = spark.sparkContext._jsc.sc().statusStore()
    ids = lambda: {s.stageId(): s.shuffleWriteBytes() for s in _stages(spark, store)}
    before = ids()
    out = run()
    return out, sum(n for i, n in ids().items() if i not in before)


def _stages(spark, store):
    jvm = spark.sparkContext._jvm
    seq = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [seq.apply(i) for i in range(seq.size())]


def test_texts_without_a_candidate_do_not_travel(spark):
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(250))) for i in range(1200)]
    df = spark.createDataFrame([*rows, (5000, rows[0][1]), (5001, rows[1][1] + " x")], "id long, text string").repartition(4).checkpoint()
    whole = sum(len(t) for _, t in rows)
    (groups, _), bytes_ = written(spark, lambda: tables.grouped(df, "id", "text"))
    assert groups.where("members > 1").count() == 4 and bytes_ < whole / 2


@pytest.mark.parametrize("sent", [0, 500_000])
def test_families_where_the_smallest_text_is_unlike(spark, monkeypatch, sent):
    """All of one code: stars to the smallest text unite nothing but its likes; the rest is verified in pairs."""
    monkeypatch.setattr(tables, "SENT_IDS", sent)
    monkeypatch.setattr(tables.T, "text_simhash64", lambda c: F.lit(5).cast("long"))
    r = random.Random(2)
    stems = [" ".join(r.choices(WORDS, k=30)) for _ in range(4)]
    rows = [(i, stems[i % 4] + f" {r.choice(WORDS)}" * (i % 3)) for i in range(1, 40)] + [(0, "zero alike to none"), (50, None), (51, "  ")]
    df = spark.createDataFrame(rows, "id long, text string")
    runs = {x.id: set(x.s) for x in df.select("id", T.char_shingles(T.normalised(F.col("text"))).alias("s")).collect() if x.s}
    parent = {i: i for i, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in runs:
        for b in runs:
            if a < b and len(runs[a] & runs[b]) >= 0.82 * len(runs[a] | runs[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for i in parent:
        want.setdefault(find(i), set()).add(i)
    found, got = tables.grouped(df, "id", "text"), {}
    for x in found[0].collect():
        got.setdefault(x.group, set()).add(x.id)
    receipt = found[1].first()
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert receipt.exact_text_edges + receipt.near_text_edges == len(rows) - len(want)


def test_stored_folders_hold_codes_instead_of_texts(spark):
    """What leakage groups keep in the shared folder while they run, of texts none of which has a candidate."""
    from pathlib import Path

    from tallymill.operators.components import checkpoint_dir

    size = lambda: sum(p.stat().st_size for p in Path(checkpoint_dir(spark).removeprefix("file://")).rglob("part-*"))
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(250))) for i in range(600)]
    df, before = spark.createDataFrame(rows, "id long, text string"), size()
    assert tables.leakage_groups(df, "id", "text").count() == 600 and size() - before < sum(len(t) for _, t in rows) / 4
