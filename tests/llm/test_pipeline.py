import brute
import pytest
from conftest import ROWS

import __spark_entry__ as entry
import corpus_pipeline as P
from tallymill.llm.queries import QUERIES
from test_similar import stay


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert len({n.split("_")[0] for n in names}) == 13 and "pipeline" in entry.queries() and set(QUERIES) == set(names)


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages_take_anything(spark, tricky, empty, name, stage):
    out = stage(spark, tricky, "/root/testdata/sf0.001")
    if name != "packing":
        assert out.columns == tricky.columns and out.dtypes == tricky.dtypes
    assert out.count() > 0
    assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_stages_keep_odd_columns(spark, odd_columns, name, stage):
    out = stage(spark, odd_columns, "/root/testdata/sf0.001")
    assert out.columns == odd_columns.columns and out.dtypes == odd_columns.dtypes
    got = out.collect()
    assert got and all(r["my col"] == "b" and r["pairs"] == {"k": 1} and r["box"]["deep"][0]["z"] == 1 and r["tick`"] is True for r in got)


def test_near_dedup_keeps_one_of_each_group(spark, tricky):
    kept = [r.doc_id for r in P.near_dedup(spark, tricky, None).collect()]
    assert sorted(d for d in kept if d is not None) == stay([(d, t) for d, t in ROWS if d is not None]) and kept.count(None) == 2


def test_later_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    cut = {r.doc_id: r for r in P.cut_repeats(spark, docs, sf).collect()}
    for (d, n, gone, text), (_, before) in zip(brute.kept(rows), rows, strict=True):
        assert brute.words(cut[d].text) == text.split(" ") * bool(text) and (gone or cut[d].text == before)
        assert not gone or cut[d].n_chars == len(cut[d].text)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {d for d, n, h, _ in brute.hits(rows, items) if not (h and 20 * h >= n)}
    assert {r.doc_id for r in P.decontaminate(spark, docs, sf).collect()} == clean


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001").collect()
    assert len(out) > 50 and all(r.n_words <= 2048 for r in out)
