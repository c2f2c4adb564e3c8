import brute
import numpy as np
import pytest
import xxhash
from conftest import ROWS
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymill.llm import simhash
from tallymill.llm.simhash import GrayIndex, fingerprints, gray_rank, near_groups, near_links
from tallymill.llm.xxh64 import xxh64_slices


def rows(df):
    return sorted(((r.id, r.code % 2**64, r.component) for r in near_groups(df).collect()), key=str)


def test_against_brute_force(tricky):
    codes = [(d, brute.fingerprint(t)) for d, t in ROWS]
    assert rows(tricky) == sorted(brute.components(codes), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    codes = [(r.doc_id, brute.fingerprint(r.text)) for r in docs.collect()]
    assert rows(docs) == sorted(brute.components(codes), key=str)


def test_empty_table(empty):
    assert rows(empty) == []


@given(st.binary(max_size=300), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_xxh64(data, seed):
    ends = np.arange(len(data) + 1)
    got = xxh64_slices(data, np.zeros(len(ends), dtype=np.int64), ends, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[:e], seed=seed) for e in ends]


def test_gray_rank_inverts():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def clustered(seed, n, bases=4, flips=5):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 2**63, bases, dtype=np.uint64)[rng.integers(0, bases, n)]
    for _ in range(flips):
        c = c ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(c)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_every_link(seed, monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 64)
    c = clustered(seed, 400)
    b = np.random.default_rng(seed).integers(0, 3, len(c))
    index = GrayIndex(b, c)
    label, own = index.links(3), b[index.order]
    # Buckets are told apart by so many bits that no link crosses them.
    codes = [(i, ((1 << 8 * int(own[i])) - 1) << 64 | int(index.codes[i])) for i in range(len(c))]
    assert [x[2] for x in brute.components(codes)] == label.tolist()


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_routes_and_heavy_buckets(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    c = clustered(9, 300, bases=2, flips=4)
    df = spark.createDataFrame([(i, int(x.astype(np.int64))) for i, x in enumerate(c)], "rep long, code long")
    found = {(r.a, r.b) for r in near_links(df, 3).collect()}
    want = brute.components([(i, int(x)) for i, x in enumerate(c)])
    parent = list(range(len(c)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert [find(i) for i in range(len(c))] == [w[2] for w in want]
    assert len(found) < 12 * len(c)


def test_case_and_short_texts():
    a, b, none, one = fingerprints([b"One Two  three four", b"one two three\nfour", b" ", b"one"])
    assert a == b and none == 0 and one == xxhash.xxh64_intdigest(b"one", seed=42)


def test_rows_without_an_id_link(spark, monkeypatch):
    """A fingerprint that only null ids have bridges two others, and takes the component of those near it."""
    codes = {b"a": 0, b"b": 0b111, b"c": 0b111111, b"d": 1 << 40 | 0xFF << 50}
    monkeypatch.setattr(simhash, "_fingerprint_batches", coded(codes))
    df = spark.createDataFrame([(5, "a"), (None, "b"), (9, "c"), (None, "d")], "doc_id long, text string")
    assert rows(df) == sorted(brute.components([(5, 0), (None, 0b111), (9, 0b111111), (None, codes[b"d"])]), key=str)


def coded(codes):
    def batches(it, words):
        import pyarrow as pa

        for batch in it:
            yield pa.record_batch([batch.column("id"), pa.array([codes[t] for t in batch.column("text").to_pylist()], type=pa.int64())], names=["id", "code"])

    return batches
