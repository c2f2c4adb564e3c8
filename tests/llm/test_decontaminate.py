import brute
import pytest
from conftest import ROWS, prose

from tallymill.llm import decontaminate
from tallymill.llm.decontaminate import contamination

ITEMS = [(1, prose(4, 30)), (2, None), (3, " .. "), (4, "tree3"), (None, prose(6, 20)), (5, prose(2, 14).replace(" ", ", ")), (5, prose(2, 14)), (6, "Word word word")]


def bench(spark, rows=None):
    return spark.createDataFrame(ITEMS if rows is None else rows, "item_id long, text string")


def rows(df):
    return sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_against_brute_force(spark, tricky, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    assert rows(contamination(tricky, bench(spark))) == sorted(brute.hits(ROWS, ITEMS), key=str)


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_columns_stay(spark, tricky, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    out = contamination(tricky, bench(spark), keep_columns=True).select("rest.*")
    assert out.columns == tricky.columns and sorted(out.collect(), key=str) == sorted(tricky.collect(), key=str)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(contamination(docs, items)) == sorted(want, key=str)


def test_empty_tables(spark, tricky, empty):
    assert rows(contamination(empty, bench(spark))) == []
    assert all(r[2] == 0 and r[3] == [] for r in rows(contamination(tricky, bench(spark, []))))


def test_spans(spark, tricky):
    spans = {r.id: r.spans for r in contamination(tricky, bench(spark, [(1, prose(7, 12))])).collect()}
    assert [(s["first"], s["size"]) for s in spans[10]] == [(0, 12)]


def test_rows_of_one_id_and_length_stay_apart_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    docs = [(1, prose(4, 30)), (1, prose(31, 30)), (1, prose(6, 30)), (None, prose(6, 30)), (None, prose(32, 30)), (None, prose(32, 30))]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench(spark))
    assert rows(got) == sorted(brute.hits(docs, ITEMS), key=str)


@pytest.mark.parametrize("keep", [False, True])
def test_one_block_at_a_time_is_held(spark, tricky, monkeypatch, keep):
    """Blocks are made one by one, and only after the hits of the one before are written."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    made, saved = [], []
    blocks, save = decontaminate._blocks, decontaminate.Scratch.save

    def counted(*args):
        for b in blocks(*args):
            made.append(len(saved))
            yield b

    def noted(self, df):
        saved.append(df)
        return save(self, df)

    monkeypatch.setattr(decontaminate, "_blocks", counted)
    monkeypatch.setattr(decontaminate.Scratch, "save", noted)
    got = contamination(tricky, bench(spark), keep_columns=keep)
    assert rows(got) == sorted(brute.hits(ROWS, ITEMS), key=str)
    # Two to know that there are several, then one for each that was done.
    assert len(made) >= 4 and made[:2] == [0, 0] and all(later >= n - 2 for n, later in enumerate(made))
