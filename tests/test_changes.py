"""Privacy findings against Python's own patterns, row changes in a stream, buckets of a live table, baselines."""

import re

import pytest

from tallymill.functions import text as T
from tallymill.operators import baselines as B
from tallymill.operators import components
from tallymill.operators import metrics as M
from tallymill.operators import tables as O
from tallymill.streaming.live import LiveTable
from pyspark.sql import functions as F

TEXTS = [
    None,
    "",
    "write a.b+c@mail.example.org, or ä@x.de now",
    "call +62 812-3456-7890 or 0812 3456 7890",
    "٠٨١٢٣٤٥٦٧٨٩ and 081234567890",
    "id 1234567890123456, not 12345678901234567",
    "see HTTPS://x.org/ä?b=1 and www.y.de.",
    "plate B 1234 XYZ, dd 12 ab, ÄB 12 C, b1c",
    "x" * 20000 + " z@z.zz " * 3,
]


def test_screens_match_as_pythons_patterns_do(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 2)), "id long, text string")
    found = {n: [re.findall(p, t or "") for t in TEXTS * 2] for n, p in T.PATTERNS.items()}
    got = {r.pattern: (r.occurrences, r.rows) for r in O.screen(df, "text").collect()}
    assert got == {n: (sum(map(len, f)), sum(map(bool, f))) for n, f in found.items()}
    salt = "sixteen letters!"
    private = sorted(tuple(r.finding_types) for r in O.private_findings(df, "text", "id", salt).collect())
    want = [tuple(sorted(n for n in found if found[n][i])) for i in range(len(df.collect()))]
    assert private == sorted(w for w in want if w)
    with pytest.raises(ValueError, match="16"):
        O.private_findings(df, "text", "id", "short")


def test_screens_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    got = {r.pattern: r.occurrences for r in O.screen(docs, "text").collect()}
    assert got == {n: sum(len(re.findall(p, t)) for t in texts) for n, p in T.PATTERNS.items()}


SCHEMA = "id long, sequence long, status string"


def test_changes_reach_a_stream_once_and_buckets_are_replaced(spark, tmp_path):
    live = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=4)
    source, seen = tmp_path / "in", []

    def act(changes, number):
        seen.append(sorted((r.id, r.sequence, r.kind, r.old_status, r.new_status) for r in changes.collect()))

    batches = [[(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None)], [(1, 2, "late"), (2, 2, None), (2, 3, "c"), (3, 1, "a")], [(3, 2, "a")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        live.follow(stream, str(tmp_path / "check"), on_changes=(["status"], act)).awaitTermination()
    assert seen == [[(1, 1, "insert", None, "a"), (1, 3, "update", "a", "b"), (2, 1, "insert", None, None)], [(2, 3, "update", None, "c"), (3, 1, "insert", None, "a")], []]
    assert sorted(tuple(r) for r in live.read().collect()) == [(1, 3, "b"), (2, 3, "c"), (3, 2, "a")]
    # One pointer, and buckets of at most two generations.
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("pointer-")]) == 1
    again = LiveTable(spark, f"file://{tmp_path}/state", SCHEMA, "id", ["sequence"], buckets=4)
    again.merge(spark.createDataFrame([(9, 1, "x")], SCHEMA), 0)
    assert again.read().count() == 3
    again.merge(spark.createDataFrame([], SCHEMA), 7)
    assert again.read().count() == 3


def test_prior_and_text_classifier(spark):
    rows = [(i, ("river bridge " if i % 3 else "lamp market ") * 5 + str(i), 1 if i % 3 else 0) for i in range(200)] + [(200, None, 1), (201, "lamp", None)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    n = sum(y == 1 for _, _, y in rows)
    assert B.class_prior(df, "y", 2).first().p == pytest.approx([1 - n / 201, n / 201])
    assert B.class_prior(df.where("false"), "y", 4).first().p == [0.25] * 4
    assert B.with_prior(df, B.class_prior(df, "y", 2)).count() == len(rows)
    model = B.fit_text_classifier(df.where("id < 150"), "text", "y")
    got = M.predicted(B.text_probabilities(df.where("id >= 150"), model, "text", ["id", "y"]))
    assert got.count() == 52 and got.where("id < 200 and not correct").count() == 0


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://there:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        components.checkpoint_dir(Session())
