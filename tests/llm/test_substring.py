import brute
import pytest
from conftest import ROWS

from tallymill.llm import substring
from tallymill.llm.substring import COVERS, plan_for, remove_repeats


def result(df, **kw):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, join_words=" ", **kw).collect()), key=str)


@pytest.mark.parametrize("period", COVERS)
def test_covers_have_every_difference(period):
    assert {(a - b) % period for a in COVERS[period] for b in COVERS[period]} == set(range(period))


@pytest.mark.parametrize("window", [3, 8, 13, 50])
def test_against_brute_force(spark, tricky, window):
    assert result(tricky, window=window) == sorted(brute.kept(ROWS, window), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(docs) == sorted(brute.kept(rows), key=str)


def test_white_space_and_columns_stay(spark, tricky):
    out = {r.rest.id: r for r in remove_repeats(tricky, keep_columns=True).collect()}
    assert len(out) == len(ROWS)
    assert all(r.kept_text == (ROWS[i][1] or "") for i, r in out.items() if not r.n_removed)
    assert out[8].n_removed == 55 and out[8].kept_text == ROWS[8][1].split("\t")[1]
    assert {i for i, r in out.items() if r.no_text} == {1, 2}


def test_empty_table(empty):
    assert result(empty) == []


def test_long_words_and_periods():
    assert plan_for(13, 1).period == 7 and plan_for(13, 1).anchor == 7
    assert plan_for(50, 1).period == 21
    assert substring.plan_for(1, 1).anchor == 1
